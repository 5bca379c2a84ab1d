"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import synthetic, text as T, vectors as V
from ..operators import hashed, metrics, negatives, ordering, pairs, passages, retrieve, stats, table, train, vector_index
from ..operators.layout import broadcast_within, computed_once, spread
from ..session import materialize, scratch_path
from ..sources import corpus_ranges, files, models
from . import jobs
from .profiles import DUPLICATES, LABELED, Profile, effective_threshold

SEED = 42
# No registered query cuts a text at a sequence length.
WHOLE_TEXT = None
MODEL = table.ModelConfig(vocab_size=256, embedding_dim=16, max_seq_len=WHOLE_TEXT)
WIDE_VOCAB = table.ModelConfig(vocab_size=8192, embedding_dim=16, max_seq_len=WHOLE_TEXT)
TRAINING = train.TrainOptions(epochs=2, learning_rate=0.06, margin=0.2, batch_size=1 << 40, seed=SEED)
MIN_CHARS, MIN_WORDS = T.DEFAULT_MIN_CHARS, T.DEFAULT_MIN_WORDS
DISALLOW = ("removed by reddit", "removed", "deleted")
LABELED_PROFILE = Profile(
    "labeled_documents", LABELED, columns={"left": "left", "right": "right", "label": "label"},
    filters={"min_chars": MIN_CHARS, "min_words": MIN_WORDS, "disallow_values": list(DISALLOW)}, options={"positive_label": 1},
)
DUPLICATE_PROFILE = Profile(
    "document_duplicates", DUPLICATES, columns={"text": "text"},
    filters={"min_chars": MIN_CHARS, "min_words": MIN_WORDS, "disallow_values": list(DISALLOW)},
)
PREPARE = jobs.PrepareOptions(seed=SEED)
LANGUAGES = ["de", "en", "es", "fr"]
HASH_DIM = hashed.DEFAULT_DIM
WIDE_DIM = 8
QUERY_COUNT = 48
BATCH_ROWS = 64
POOL_WORDS = 30
LOSS_BATCH = 16
SAMPLE_ROWS = 100
REPEATS = 5

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c, name: str):
    return V.rounded(c).alias(name)


def long_vector(df: DataFrame, keys: list[str], column: str = "embedding", sparse: bool = False) -> DataFrame:
    """(keys, dim, value) rows rounded to 6 places."""
    rows = computed_once(df.select(*keys, column), _vec=F.col(column)).select(*keys, F.posexplode("_vec").alias("dim", "_x"))
    rows = rows.where(F.col("_x") != 0) if sparse else rows
    return rows.select(*keys, F.col("dim").cast("bigint").alias("dim"), r6(F.col("_x"), "value"))


# --- shared inputs ---------------------------------------------------------------------------


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read(spark, sf, "documents").select("doc_id", "text"))


def labeled_source(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with the next one, labelled by its quality."""
    docs = documents(spark, sf)
    labels = read(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    # Only texts behind a labelled document are moved.
    asked = broadcast_within(labels.select("doc_id"), labels.count(), 64)
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("right")).join(asked, "doc_id", "left_semi")
    return docs.join(labels, "doc_id").join(after, "doc_id").select(F.col("text").alias("left"), "right", "label")


def labeled_accepted(spark: SparkSession, sf: str, variant: str = "ascii") -> DataFrame:
    cleaned = pairs.clean_pairs(labeled_source(spark, sf), "left", "right", "label", variant)
    return pairs.filter_pairs(cleaned, MIN_CHARS, MIN_WORDS, DISALLOW)


def labeled_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return train.with_pair_key(pairs.labeled_positives(labeled_accepted(spark, sf)))


def accepted_texts(spark: SparkSession, sf: str, variant: str = "ascii") -> DataFrame:
    cleaned = pairs.clean_texts(documents(spark, sf), "text", variant)
    return pairs.filter_texts(cleaned, MIN_CHARS, MIN_WORDS, DISALLOW)


def conversation_turns(spark: SparkSession, sf: str, ahead: int) -> DataFrame:
    """Turns with the texts of the following turns; system turns count as empty texts."""
    talk = read(spark, sf, "conversations")
    shown = F.when(F.col("role") == "system", F.lit("")).otherwise(F.col("text"))
    out = talk.select("conv_id", "turn", shown.alias("anchor"))
    for step, name in list(enumerate(["positive", "negative"], start=1))[:ahead]:
        after = talk.select("conv_id", (F.col("turn") - step).alias("turn"), shown.alias(name))
        out = out.join(after, ["conv_id", "turn"], "left")
    return out


def passage_rows(spark: SparkSession, sf: str) -> DataFrame:
    return passages.sliding_passages(documents(spark, sf), "text")


def token_table(spark: SparkSession, config: table.ModelConfig = MODEL) -> DataFrame:
    return table.init_token_table(spark, config, SEED)


def training_triplets(spark: SparkSession, sf: str) -> DataFrame:
    """The first epoch's triplets of the labelled pairs."""
    found = materialize(labeled_pairs(spark, sf))
    pool = negatives.index_pool(pairs.pool_of_pairs(found), SEED)
    return materialize(train.epoch_triplets(found, pool, TRAINING, 1))


def repeat_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event type and repeat, as a benchmark run would log."""
    events = read(spark, sf, "events").withColumn("repeat", F.col("event_id") % REPEATS)
    return events.groupBy("event_type", "repeat").agg(
        F.avg("value").alias("mean_us"), F.max("value").alias("max_us"), (F.count("*") / F.sum("value")).alias("per_us")
    )


# --- sources and sinks -----------------------------------------------------------------------


def src_csv_text(spark, sf):
    path = scratch_path(spark, "csv")
    files.write_csv_text(read(spark, sf, "pages").select("page_id", "url", "html"), path)
    return files.read_csv_text(spark, path, ["page_id", "url", "html"])


def src_discover(spark, sf):
    root = scratch_path(spark, "discover")
    files.write_csv_text(read(spark, sf, "documents").select("doc_id", "lang"), root, ["lang"])
    found = [files.discover_csv(spark, root), files.discover_csv(spark, root, "no such [name].csv")]
    folders = [f.rsplit("/", 1)[0] for f in found]
    first = files.read_csv_text(spark, folders[0], ["doc_id"])
    every = files.read_csv_text(spark, root, ["doc_id"])
    ids = F.col("doc_id").cast("bigint")
    return first.agg(F.lit(folders[0].rsplit("/", 1)[1]).alias("folder"), F.lit(folders[0] == folders[1]).alias("same_for_unknown_name"), F.count("*").alias("rows")).select(
        "*", every.select(F.count("*")).scalar().alias("all_rows"), every.select(F.sum(ids)).scalar().alias("all_ids")
    )


def src_corpus_text(spark, sf):
    path = scratch_path(spark, "corpus")
    wrapped = F.concat(
        F.lit("notes before\r\n" + T.WRAPPER_START + " NAME ***\r\n"), F.col("text"), F.lit(T.WRAPPER_END + " NAME ***\r\n")
    )
    separator = "\x1e"
    read(spark, sf, "documents").select(wrapped.alias("value")).write.option("lineSep", separator).text(path)
    return files.read_corpus(spark, path, separator)


def src_corpus_files(spark, sf):
    """Whole files: one per document, and one per language with all its texts inside one wrapper. Their texts come back in pieces and are measured."""
    docs = read(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    opened, closed = "notes before\r\n" + T.WRAPPER_START + " NAME ***\r", T.WRAPPER_END + " NAME ***\r\nnotes after\r"
    single = docs.select("doc_id", F.concat(F.lit(opened + "\n"), "text", F.lit("\r\n" + closed)).alias("value"))
    edge = lambda place, value: docs.select("lang").distinct().select("lang", F.lit(place).cast("bigint").alias("doc_id"), F.lit(value).alias("text"))
    rows = docs.select("lang", "doc_id", "text").unionByName(edge(-1, opened)).unionByName(edge((1 << 62), closed))
    paths = {kind: scratch_path(spark, kind) for kind in ("single", "large")}
    files.write_key_files(single, "doc_id", paths["single"])
    rows.repartition("lang").sortWithinPartitions("lang", "doc_id").select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(paths["large"])
    found = []
    for kind, path in paths.items():
        name = F.regexp_extract("file", "(?:doc_id|lang)=([^/]*?)(?:[.]txt|/[^/]*)$", 1).alias("name")
        pieces = corpus_ranges.corpus_pieces(spark, path).select(F.lit(kind).alias("kind"), name, "text")
        found.append(pieces.groupBy("kind", "name").agg(
            F.sum(F.char_length("text")).alias("chars"), F.sum(F.size(T.words(F.col("text")))).alias("words"), F.sum(F.regexp_count("text", F.lit("\n"))).alias("lines")
        ))
    return found[0].unionByName(found[1])


def src_pairs(spark, sf):
    path = scratch_path(spark, "pairs")
    files.write_pairs(conversation_turns(spark, sf, 1), path)
    return files.read_pairs(spark, path)


def src_triplets(spark, sf):
    path = scratch_path(spark, "triplets")
    files.write_triplets(conversation_turns(spark, sf, 2), path)
    return files.read_triplets(spark, path)


def sink_pairs(spark, sf):
    path = scratch_path(spark, "sink-pairs")
    files.write_pairs(labeled_pairs(spark, sf), path)
    return spark.read.parquet(path)


def sink_triplets(spark, sf):
    path = scratch_path(spark, "sink-triplets")
    files.write_triplets(negatives_reject(spark, sf), path)
    return spark.read.parquet(path)


def _duplicate_counts(spark, sf) -> DataFrame:
    mined = jobs.mine(documents(spark, sf), DUPLICATE_PROFILE, MIN_CHARS, MIN_WORDS, keep=materialize)
    settings = {"min_chars": MIN_CHARS, "min_words": MIN_WORDS, "seed": SEED}
    return jobs.counts_row(spark, settings, mined, {"positive_pairs": mined.positives, "negative_pool_size": mined.pool})


def sink_report(spark, sf):
    path = scratch_path(spark, "report")
    row = _duplicate_counts(spark, sf)
    files.write_report(row, path)
    return files.read_report(spark, path, row.schema)


def model_save_load(spark, sf):
    """A table sized by the distinct words of the corpus, saved, loaded and checked."""
    bare = documents(spark, sf).select(F.explode(T.bare_words(F.col("text"))).alias("word")).where("word <> ''")
    size = bare.distinct().count() + 2
    config = table.ModelConfig(vocab_size=size, embedding_dim=8)
    path = scratch_path(spark, "model")
    models.save_model(table.init_token_table(spark, config, SEED), config, path)
    loaded, found = models.load_model(spark, path)
    return models.check_model(loaded, found).select(
        F.lit(found.vocab_size).cast("bigint").alias("vocab_size"), "token_rows", "cells", "misshapen", "out_of_range", "valid"
    )


def src_ir_results(spark, sf):
    """Result files per language, one expected task of which is missing."""
    docs = read(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    labels = read(spark, sf, "labels")
    scored = docs.join(labels, "doc_id").groupBy("lang").agg(
        F.avg("quality").alias("main_score"), F.avg("toxic").alias("ndcg_at_10"),
        F.avg(F.col("quality") * F.col("toxic")).alias("map_at_10"),
        (F.count("*") / 1000.0).alias("recall_at_10"), F.min(F.col("quality").cast("double")).alias("mrr_at_10"),
        (F.sum("n_chars") / 1000.0).alias("evaluation_time"),
    )
    entry = F.struct("main_score", "ndcg_at_10", "map_at_10", "recall_at_10", "mrr_at_10")
    payload = scored.select(
        F.col("lang").alias("task"), F.col("lang").alias("task_name"), F.lit("rev1").alias("dataset_revision"),
        "evaluation_time", F.struct(F.array(entry).alias("test")).alias("scores"),
    )
    path = scratch_path(spark, "results")
    payload.repartition("task").write.partitionBy("task").json(path)
    expected = docs.select(F.explode(F.array(F.col("lang"), F.concat("lang", F.lit("_missing")))).alias("task_name")).distinct()
    return files.read_ir_results(spark, path, expected)


# --- projections, filters, predicates --------------------------------------------------------


def _all_texts(spark, sf) -> DataFrame:
    return (
        read(spark, sf, "documents").select(F.lit("d").alias("src"), F.col("doc_id").alias("id"), "text")
        .unionByName(read(spark, sf, "pages").select(F.lit("p").alias("src"), F.col("page_id").alias("id"), F.concat_ws(" ", "url", "html").alias("text")))
        .unionByName(read(spark, sf, "conversations").select(F.lit("c").alias("src"), (F.col("conv_id") * 1000000 + F.col("turn")).alias("id"), "text"))
    )


def clean_ascii(spark, sf):
    return spread(_all_texts(spark, sf)).select("src", "id", T.clean_ascii(F.col("text")).alias("clean"))


def clean_markup(spark, sf):
    return spread(_all_texts(spark, sf)).select("src", "id", T.clean_markup(F.col("text")).alias("clean"))


def filter_text(spark, sf):
    rows = computed_once(documents(spark, sf), clean=T.clean_ascii(F.col("text")))
    return rows.where(T.passes_filters(F.col("clean"), MIN_CHARS, MIN_WORDS, DISALLOW)).select("doc_id", "clean")


def filter_question(spark, sf):
    """Conversation texts as they are, and as questions with and without trailing space."""
    talk = read(spark, sf, "conversations")
    forms = F.array(F.col("text"), F.concat("text", F.lit("?")), F.concat("text", F.lit("?  \n")))
    rows = talk.select("conv_id", "turn", F.posexplode(forms).alias("form", "raw"))
    return rows.select(
        "conv_id", "turn", F.col("form").cast("bigint").alias("form"),
        T.asks_question(F.col("raw"), "ascii").alias("keep_ascii"), T.asks_question(F.col("raw"), "markup").alias("keep_markup"),
    )


def parse_label(spark, sf):
    """Every label in clean, padded, decimal, signed and spoiled spelling; -999 stands for null."""
    q = F.col("quality").cast("string")
    spellings = F.array(q, F.concat(F.lit(" "), q, F.lit("\t")), F.concat(q, F.lit(".0")), F.concat(F.lit("+"), q), F.concat(F.lit("x"), q),
                        F.concat(q, F.lit("99999999999999999999")), F.concat(q, F.lit("3000000000")), F.lit(""))
    rows = read(spark, sf, "labels").select("doc_id", F.posexplode(spellings).alias("form", "raw"))
    return rows.select("doc_id", F.col("form").cast("bigint").alias("form"),
                       T.parse_label(F.col("raw"), "ascii").alias("label_ascii"), F.coalesce(T.parse_label(F.col("raw"), "markup"), F.lit(-999)).cast("bigint").alias("label_markup"))


def canonical_pair(spark, sf):
    turns = conversation_turns(spark, sf, 1).where(F.col("positive").isNotNull())
    first, second = T.canonical_pair(F.col("anchor"), F.col("positive"))
    return turns.select("conv_id", "turn", first.alias("anchor"), second.alias("positive"))


def effective_thresholds(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id").join(read(spark, sf, "labels"), "doc_id", "left")
    override, profile = F.col("toxic").cast("bigint"), F.col("quality").cast("bigint") * 20
    return rows.select(
        "doc_id",
        effective_threshold(override, profile, MIN_CHARS).cast("bigint").alias("min_chars_ascii"),
        effective_threshold(override, profile, MIN_CHARS, "markup").cast("bigint").alias("min_chars_markup"),
    )


# --- pair mining -----------------------------------------------------------------------------


def mine_labeled_positives(spark, sf):
    return pairs.labeled_positives(labeled_accepted(spark, sf))


def mine_labeled_positives_markup(spark, sf):
    return pairs.labeled_positives(labeled_accepted(spark, sf, "markup"), 1, "markup")


def mine_labeled_negatives(spark, sf):
    return pairs.labeled_negatives(labeled_accepted(spark, sf))


def mine_duplicates(spark, sf):
    return pairs.duplicate_pairs(accepted_texts(spark, sf)).withColumn("copy", F.col("copy").cast("bigint"))


def mine_duplicates_distinct(spark, sf):
    return pairs.duplicate_pairs_distinct(accepted_texts(spark, sf, "markup"))


def negative_pool_texts(spark, sf):
    return pairs.text_pool(accepted_texts(spark, sf))


def negative_pool_union(spark, sf):
    return pairs.pool_of_pairs(labeled_pairs(spark, sf))


def prep_stats(spark, sf):
    return _duplicate_counts(spark, sf)


def prepare_job(spark, sf):
    """All rows the job writes, read back, with the metadata counts alongside."""
    source_path, out = scratch_path(spark, "source-csv"), scratch_path(spark, "prepared")
    files.write_csv_text(labeled_source(spark, sf), source_path)
    source = files.read_csv_text(spark, source_path, ["left", "right", "label"])
    meta = jobs.prepare_job(spark, source, LABELED_PROFILE, out, PREPARE, "labeled documents")
    train_pairs = files.read_pairs(spark, f"{out}/train_pairs").withColumn("negative", F.lit(None).cast("string"))
    triplets = files.read_triplets(spark, f"{out}/eval_triplets")
    counts = meta.select(
        F.lit("metadata").alias("output"),
        F.concat_ws("|", "rows_after_cleaning", "positive_pairs").alias("anchor"),
        F.concat_ws("|", "negative_pool_size", "train_pairs").alias("positive"),
        F.concat_ws("|", "eval_triplets", "min_chars", "min_words", "seed").alias("negative"),
    )
    return (
        train_pairs.select(F.lit("train").alias("output"), "anchor", "positive", "negative")
        .unionByName(triplets.select(F.lit("eval").alias("output"), "anchor", "positive", "negative"))
        .unionByName(counts)
    )


# --- sampling and ordering -------------------------------------------------------------------


def sample_capped(spark, sf):
    return ordering.sample_capped(documents(spark, sf), SAMPLE_ROWS, SEED, "sample", ["doc_id"])


def shuffle_epoch(spark, sf):
    return train.epoch_order(materialize(labeled_pairs(spark, sf)), SEED, 1).select("position", "anchor", "positive")


def _pool_and_pairs(spark, sf):
    mined = jobs.mine(labeled_source(spark, sf), LABELED_PROFILE, MIN_CHARS, MIN_WORDS, keep=materialize)
    return mined.positives, negatives.index_pool(mined.pool, SEED)


def negatives_reject(spark, sf):
    found, pool = _pool_and_pairs(spark, sf)
    return negatives.draw_rejecting(found, pool, SEED, train.PAIR_KEYS).select("anchor", "positive", "negative")


def negatives_single_draw(spark, sf):
    found, pool = _pool_and_pairs(spark, sf)
    return negatives.draw_single(found, pool, SEED, train.PAIR_KEYS).select("anchor", "positive", "negative")


def cycle_texts(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    size = docs.count()
    numbered = ordering.prefix_offsets(docs, "doc_id", name="idx")
    return passages.cycle_texts(numbered, "idx", size, size * 5 // 2).select("position", "doc_id", "text")


def synth_texts(spark, sf):
    """A synthetic text as long as each document, from words of the corpus."""
    docs = documents(spark, sf)
    sized = docs.select("doc_id", F.size(T.words(F.col("text"))).alias("seq_len"))
    # A scalar stands in a column of its own: it may not appear inside a lambda.
    pool = synthetic.word_pool(docs.select(F.explode(T.words(F.col("text"))).alias("word")), "word", POOL_WORDS)
    text = synthetic.synthetic_text(F.col("doc_id"), F.col("seq_len"), SEED, F.col("_pool"))
    return sized.withColumn("_pool", pool).select("doc_id", F.col("seq_len").cast("bigint").alias("seq_len"), text.alias("text"))


def chunk_rows(spark, sf):
    return passages.chunk_rows(read(spark, sf, "documents").select("doc_id"), "doc_id", BATCH_ROWS)


# --- tokenising and embedding ----------------------------------------------------------------


def token_ids(spark, sf):
    return table.token_ids(documents(spark, sf), "text", WIDE_VOCAB).select(
        "doc_id", F.col("position").cast("bigint").alias("position"), "token_id"
    )


def hash_embed(spark, sf):
    return long_vector(hashed.hash_embed(documents(spark, sf), "text", HASH_DIM), ["doc_id"], sparse=True)


def hash_embed_wide(spark, sf):
    wide = hashed.hash_embed_wide(read(spark, sf, "conversations").select("text"), "text", WIDE_DIM)
    return wide.select("text", *[r6(F.col(f"emb_{i}"), f"emb_{i}") for i in range(WIDE_DIM)])


def l2_normalize(spark, sf):
    """Vectors stretched by their label, so label 0 gives zero vectors."""
    stretched = F.transform(V.as_double(F.col("embedding")), lambda x: x * F.col("label"))
    rows = read(spark, sf, "embeddings").select("vec_id", V.l2_normalize(stretched).alias("embedding"))
    return long_vector(rows, ["vec_id"])


def dot_similarity(spark, sf):
    left = read(spark, sf, "embeddings").select("vec_id", "embedding")
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return left.join(right, "vec_id").select("vec_id", r6(V.dot(F.col("embedding"), F.col("other")), "similarity"))


def mean_pool(spark, sf):
    return long_vector(table.mean_pool(documents(spark, sf), ["doc_id"], "text", token_table(spark), MODEL), ["doc_id"])


def masked_mean_pool(spark, sf):
    """Token vectors of each document, unknown tokens masked out."""
    counts = table.token_counts(documents(spark, sf), ["doc_id"], "text", MODEL)
    rows = table.lookup(counts, token_table(spark), MODEL)
    masked = rows.withColumn("mask", F.when(F.col("token_id") == table.UNKNOWN_ID, 0).otherwise(1))
    return long_vector(table.masked_mean_pool(masked, ["doc_id"], "mask", MODEL.embedding_dim, "count"), ["doc_id"])


def init_token_table(spark, sf):
    """Start rows of every token id the corpus uses, and of the two reserved ids."""
    used = table.token_ids(documents(spark, sf), "text", WIDE_VOCAB).select("token_id")
    reserved = used.sparkSession.range(2).select(F.col("id").alias("token_id"))
    return long_vector(table.init_rows(used.unionByName(reserved).distinct(), WIDE_VOCAB, SEED), ["token_id"], "vec")


def embed_table(spark, sf):
    return long_vector(table.embed_table(documents(spark, sf), ["doc_id"], "text", token_table(spark), MODEL), ["doc_id"])


def embed_batch_udf(spark, sf):
    return long_vector(table.embed_batches(documents(spark, sf), "text", token_table(spark), MODEL), ["doc_id"])


# --- passages --------------------------------------------------------------------------------


def sliding_passages(spark, sf):
    return passage_rows(spark, sf)


def query_from_passage(spark, sf):
    return passage_rows(spark, sf).select("doc_id", "window", T.query_from_passage(F.col("passage"), spaced=True).alias("query"))


def corpus_stats(spark, sf):
    found = passages.corpus_stats(passage_rows(spark, sf))
    return found.select("passage_count", r6(F.col("mean_bytes"), "mean_bytes"), r6(F.col("mean_words"), "mean_words"))


# --- joins -----------------------------------------------------------------------------------


def token_lookup(spark, sf):
    tokens = table.token_ids(documents(spark, sf), "text", MODEL)
    found = table.lookup(tokens, token_table(spark), MODEL)
    last = MODEL.embedding_dim - 1
    return found.select(
        "doc_id", F.col("position").cast("bigint").alias("position"), "token_id", r6(F.col("vec")[0], "first"), r6(F.col("vec")[last], "last")
    )


def _neighbours(spark, sf, k: int) -> DataFrame:
    rows = spread(read(spark, sf, "embeddings").select("vec_id", F.col("embedding")))
    dim = 64
    queries = rows.withColumnRenamed("vec_id", "query_id")
    # Both sides are as large. With the corpus held, a slice of queries has its answer where it is read and only that is kept and moved.
    return retrieve.top_k(queries, "query_id", rows, ["vec_id"], "embedding", retrieve.dense_encoding(dim), k, hold="corpus", skip_self=True)


def retrieve_top1(spark, sf):
    return _neighbours(spark, sf, 1).select("query_id", F.col("vec_id").alias("best_id"), r6(F.col("score"), "score"))


def retrieve_topk(spark, sf):
    return _neighbours(spark, sf, 10).select("query_id", "rank", "vec_id", r6(F.col("score"), "score"))


def retrieve_topk_indexed(spark, sf):
    """The same neighbours through the clustered index."""
    rows = spread(read(spark, sf, "embeddings").select("vec_id", "embedding"))
    index = vector_index.build(rows, ["vec_id"], "embedding", retrieve.dense_encoding(64), seed=SEED)
    found = vector_index.search(index, rows.withColumnRenamed("vec_id", "query_id"), "query_id", 10, skip_self=True)
    return found.select("query_id", "rank", "vec_id", r6(F.col("score"), "score"))


def src_csv_text_ranges(spark, sf):
    """Texts with line ends, read by ranges of the files."""
    path = scratch_path(spark, "csv")
    files.write_csv_text(read(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    return files.read_csv_text(spark, path, ["doc_id", "lang", "text"])


def offset_negative(spark, sf):
    ids, total = passages.number_windows(documents(spark, sf), "doc_id", "text")
    places = ids.select("passage_id", F.struct("doc_id", "window").alias("at"))
    paired = retrieve.offset_negatives(places, "passage_id", "at", max(total, 1))
    wanted = paired.select("passage_id", "negative_idx", "negative.*")
    texts = passages.sliding_passages(documents(spark, sf), "text")
    return wanted.join(texts, ["doc_id", "window"]).select("passage_id", "negative_idx", F.col("passage").alias("negative"))


# --- training --------------------------------------------------------------------------------


def triplet_loss(spark, sf):
    losses = train.triplet_loss(training_triplets(spark, sf), token_table(spark), MODEL, TRAINING.margin)
    return losses.select("tid", r6(F.col("loss"), "loss"))


def triplet_gradients(spark, sf):
    found = train.triplet_gradients(
        training_triplets(spark, sf), token_table(spark), MODEL, TRAINING.learning_rate, TRAINING.margin
    )
    return long_vector(found, ["token_id"], "delta")


def train_step(spark, sf):
    new = train.train_step(training_triplets(spark, sf), token_table(spark), MODEL, TRAINING.learning_rate, TRAINING.margin)
    return long_vector(new, ["token_id"], "vec")


def train_epochs(spark, sf):
    """Two epochs of mini-batches; each step starts from the table the last one left."""
    _table, history = train.train_epochs(labeled_pairs(spark, sf), token_table(spark), MODEL, replace(TRAINING, batch_size=BATCH_ROWS))
    return history.select("epoch", "steps", "active_steps", r6(F.col("mean_active_loss"), "mean_active_loss"))


def epoch_summary(spark, sf):
    losses = train.triplet_loss(training_triplets(spark, sf), token_table(spark), MODEL, TRAINING.margin)
    return train.epoch_summary(losses).select("steps", "active_steps", r6(F.col("mean_active_loss"), "mean_active_loss"))


def inbatch_rank_loss(spark, sf):
    talk = read(spark, sf, "conversations")
    asked = talk.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("ask"))
    replies = talk.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    found = asked.join(replies, ["conv_id", "turn"])
    # Numbered first: numbering reads its input twice, and embedding should run once.
    batched = train.loss_batches(found, SEED, ["conv_id", "turn"], LOSS_BATCH).select("batch", "ask", "reply")
    both = table.embed_batches(table.embed_batches(batched, "ask", token_table(spark), MODEL, "a"), "reply", token_table(spark), MODEL, "p")
    return train.inbatch_rank_loss(both.select("batch", "a", "p"), most_rows=LOSS_BATCH).select("batch", "size", r6(F.col("loss"), "loss"))


# --- evaluation ------------------------------------------------------------------------------


def triplet_metrics(spark, sf):
    rows = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("anchor"))
    wide = rows
    for step, name in ((1, "positive"), (2, "negative")):
        wide = wide.join(rows.select((F.col("vec_id") - step).alias("vec_id"), F.col("anchor").alias(name)), "vec_id")
    found = metrics.triplet_metrics(metrics.score_triplets(wide))
    return found.select(*[r6(F.col(c), c) for c in found.columns])


def retrieval_quality(spark, sf):
    found = jobs.retrieval_quality(read(spark, sf, "documents"), "doc_id", "text", QUERY_COUNT)
    return found.select("eval_count", *[r6(F.col(c), c) for c in found.columns if c != "eval_count"])


def ir_metrics(spark, sf):
    """Every vector as a query; relevant are the other vectors of its label."""
    labels = read(spark, sf, "embeddings").select("vec_id", "label")
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("total_relevant"))
    asked = labels.join(sizes, "label").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"), "total_relevant")
    ranked = (
        _neighbours(spark, sf, 10).join(labels, "vec_id").join(asked, "query_id")
        .select("query_id", "rank", F.when(F.col("label") == F.col("wanted"), 1).otherwise(0).alias("relevant"))
    )
    per_query = metrics.ir_metrics_per_query(ranked, asked.select("query_id", "total_relevant"), "query_id")
    found = metrics.ir_metrics(per_query)
    return found.select("queries", *[r6(F.col(c), c) for c in found.columns if c != "queries"])


def leaderboard(spark, sf):
    scored = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").groupBy(
        F.col("source").alias("run"), F.col("lang").alias("task")
    ).agg(F.avg("quality").alias("main_score"))
    found = metrics.leaderboard(scored, LANGUAGES)
    return found.select("run", *[r6(F.col(c), c) for c in [*LANGUAGES, "mean_score"]])


def latency_nearest_rank(spark, sf):
    found = stats.latency_nearest_rank(read(spark, sf, "events"), ["event_type"], "value")
    return found.select("event_type", "n", *[r6(F.col(c), c) for c in ("mean_us", "min_us", "max_us", "p50_us", "p95_us", "p99_us")])


def latency_linear(spark, sf):
    found = stats.latency_linear(read(spark, sf, "events"), ["event_type"], "value")
    return found.select("event_type", "n", *[r6(F.col(c), c) for c in ("mean_us", "max_us", "p50_us", "p95_us", "p99_us")])


def throughput(spark, sf):
    batches = read(spark, sf, "events").groupBy("event_type", "user_id").agg(
        F.count("*").alias("items"), (F.sum("value") / 1000.0).alias("elapsed_s")
    )
    found = stats.throughput(batches, ["event_type"], "items", "elapsed_s")
    return found.select("event_type", "items", *[r6(F.col(c), c) for c in ("elapsed_s", "per_second", "mean_item_us", "max_item_us")])


def repeat_summary(spark, sf):
    found = stats.repeat_summary(repeat_metrics(spark, sf), ["event_type"], "repeat", ["mean_us", "max_us", "per_us"])
    millionths = F.transform("all_repeats", lambda x: F.round(x * 1e6).cast("bigint").cast("string"))
    return found.select("event_type", "metric", "repeats", r6(F.col("median"), "median"), F.array_join(millionths, ",").alias("all_repeats_e6"))


def bootstrap_median_ci(spark, sf):
    """Of an even number of repeats, so that a median lies between two values."""
    found = stats.bootstrap_median_ci(repeat_metrics(spark, sf).where("repeat <> 2"), ["event_type"], "mean_us", 3000, 0.95, SEED)
    return found.select("event_type", "samples", r6(F.col("ci_low"), "ci_low"), r6(F.col("ci_high"), "ci_high"))


def length_stats(spark, sf):
    sized = spread(read(spark, sf, "documents").select("lang", "text"))
    found = stats.length_stats(sized, ["lang"], F.size(T.words(F.col("text"))))
    return found.select("lang", r6(F.col("mean_words"), "mean_words"), "min_words", "max_words")


def benchmark_report(spark, sf):
    """Event values stand for measured times, a user's events of one type for a batch."""
    events = read(spark, sf, "events")
    batches = events.groupBy("event_type", "user_id").agg(F.count("*").alias("items"), (F.sum("value") / 1000.0).alias("elapsed_s"))
    found = jobs.benchmark_report(
        spark, read(spark, sf, "documents"), "doc_id", "text", events, "value", batches, "items", "elapsed_s", scratch_path(spark, "benchmark"), QUERY_COUNT
    )
    whole = [F.col(c) for c in ("dataset.passage_count", "throughput.items", "latency.n", "quality.eval_count")]
    real = "dataset.mean_bytes dataset.mean_words throughput.per_second latency.p50_us latency.p95_us latency.p99_us quality.top1_accuracy quality.separation".split()
    return found.select(*whole, *[r6(F.col(c), c.split(".")[1]) for c in real])


def pipeline_job(spark, sf):
    """Two epochs of mini-batches, then the same chain again, which finds its stages done and its model trained."""
    out, options = scratch_path(spark, "full"), replace(TRAINING, batch_size=BATCH_ROWS)
    jobs.pipeline_job(spark, labeled_source(spark, sf), LABELED_PROFILE, out, MODEL, PREPARE, options, source_key=sf)
    found = jobs.pipeline_job(spark, labeled_source(spark, sf), LABELED_PROFILE, out, MODEL, PREPARE, options, skip_train=True, source_key=sf)
    return found.select(*[r6(F.col(c), c) for c in found.columns])


KEYS = (
    "src_csv_text src_csv_text_ranges src_discover src_corpus_text src_corpus_files src_pairs src_triplets sink_pairs sink_triplets sink_report model_save_load "
    "src_ir_results clean_ascii clean_markup filter_text filter_question parse_label canonical_pair effective_thresholds "
    "mine_labeled_positives mine_labeled_positives_markup mine_labeled_negatives mine_duplicates mine_duplicates_distinct "
    "negative_pool_texts negative_pool_union prep_stats prepare_job sample_capped shuffle_epoch negatives_reject "
    "negatives_single_draw cycle_texts synth_texts chunk_rows token_ids hash_embed hash_embed_wide l2_normalize "
    "dot_similarity mean_pool masked_mean_pool init_token_table embed_table embed_batch_udf sliding_passages "
    "query_from_passage corpus_stats token_lookup retrieve_top1 retrieve_topk retrieve_topk_indexed offset_negative triplet_loss "
    "triplet_gradients train_step train_epochs epoch_summary inbatch_rank_loss triplet_metrics retrieval_quality "
    "ir_metrics leaderboard latency_nearest_rank latency_linear throughput repeat_summary bootstrap_median_ci length_stats "
    "benchmark_report pipeline_job"
).split()


def all_queries() -> dict[str, Query]:
    return {key: globals()[key] for key in KEYS}
