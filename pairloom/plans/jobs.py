"""Prepare, train, benchmark and the chain of them; stages hand over by path."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hashed, negatives, pairs, passages, retrieve, stats
from ..operators.layout import spread
from ..operators.metrics import score_triplets, triplet_metrics
from ..operators.ordering import sample_capped
from ..operators.table import ModelConfig, embed_batches, embed_table, fits_broadcast, init_token_table
from ..operators.train import PAIR_KEYS, ROLES, TrainOptions, train_epochs, with_pair_key
from ..session import dropped_shuffles, forget, scratch_tables
from ..sources import files, models
from . import stages
from .profiles import DUPLICATES, LABELED, Profile

@dataclass(frozen=True)
class PrepareOptions:
    # 0 keeps all rows.
    max_train_pairs: int = 0
    max_eval_triplets: int = 0
    min_chars: int | None = None
    min_words: int | None = None
    seed: int = 42
    variant: str = "ascii"


@dataclass(frozen=True)
class Mined:
    """Positive pairs and negative pool, both derived from one grouped pass over the source."""

    groups: DataFrame
    positives: DataFrame
    pool: DataFrame

    def counts(self) -> DataFrame:
        """Rows left after cleaning, before and after the filters."""
        kept = F.when(F.col("kind") != "rest", F.col("n")).otherwise(0)
        return self.groups.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows_after_cleaning"), F.coalesce(F.sum(kept), F.lit(0)).alias("accepted_rows")
        )


def mine(
    source: DataFrame, profile: Profile, min_chars: int, min_words: int, variant: str = "ascii", keep: Callable = lambda df: df
) -> Mined:
    """Clean, filter and group one source frame; ``keep`` may write the groups out, since positives,
    pool and counts all read them and cleaning is the costly part."""
    if profile.kind == LABELED:
        cleaned = pairs.clean_pairs(
            source, profile.column("left"), profile.column("right"), profile.column("label"), variant
        )
        accept = pairs.pairs_accepted(min_chars, min_words, profile.disallow)
        groups = keep(pairs.labeled_groups(cleaned, accept, profile.positive_label, variant))
        positives = groups.where(F.col("kind") == "pair").select("anchor", "positive")
        pool = groups.where(F.col("kind") == "pool").select(F.col("positive").alias("negative"))
        return Mined(groups, with_pair_key(positives), pool)
    if profile.kind == DUPLICATES:
        cleaned = pairs.clean_texts(source, profile.column("text"), variant)
        accept = pairs.texts_accepted(min_chars, min_words, profile.disallow, profile.question_mark, variant)
        groups = keep(pairs.text_groups(cleaned, accept))
        counts = groups.where(F.col("kind") == "text").select("clean", "n")
        found = pairs.repeat_pairs(counts) if variant == "ascii" else pairs.repeat_pairs_distinct(counts)
        return Mined(groups, with_pair_key(found), counts.select(F.col("clean").alias("negative")))
    raise ValueError(f"profile {profile.name}: unknown kind {profile.kind}")


def eval_triplets(train_pairs: DataFrame, pool: DataFrame, options: PrepareOptions) -> DataFrame:
    """At most max_eval_triplets pairs, each with a drawn negative."""
    indexed = negatives.index_pool(pool, options.seed)
    chosen = sample_capped(train_pairs, options.max_eval_triplets, options.seed + 7, "triplet", PAIR_KEYS)
    if options.variant == "ascii":
        return negatives.draw_rejecting(chosen, indexed, options.seed + 11, PAIR_KEYS)
    drawn = negatives.draw_single(chosen, indexed, options.seed + 11, PAIR_KEYS)
    return sample_capped(drawn, options.max_eval_triplets, options.seed + 19, "capped", PAIR_KEYS)


def counts_row(spark: SparkSession, fixed: dict, mined: Mined, frames: dict[str, DataFrame]) -> DataFrame:
    """One report row: settings next to the row counts of the mining and of further frames."""
    counts = [df.select(F.count("*")).scalar().alias(k) for k, df in frames.items()]
    settings = [F.lit(v).cast("bigint" if isinstance(v, int) else "string").alias(k) for k, v in fixed.items()]
    return mined.counts().select(*settings, "rows_after_cleaning", "accepted_rows", *counts)


def prepare_job(
    spark: SparkSession, source: DataFrame, profile: Profile, out: str, options: PrepareOptions, source_name: str = ""
) -> DataFrame:
    """Write train_pairs, eval_triplets and metadata below ``out``; returns the metadata row.

    The source is read and cleaned once; everything else works on the grouped texts it leaves.
    """
    min_chars, min_words = profile.thresholds(options.min_chars, options.min_words, options.variant)
    with scratch_tables(spark) as keep:
        mined = mine(spread(source), profile, min_chars, min_words, options.variant, lambda df: keep(df, "groups"))
        positives, pool = mined.positives, mined.pool
        if positives.isEmpty():
            raise ValueError("the source has no positive pair left after cleaning")
        if pool.isEmpty():
            raise ValueError("the source leaves no text to draw negatives from")
        train = sample_capped(positives, options.max_train_pairs, options.seed, "train", PAIR_KEYS)
        # All pairs are read from the groups again, a sample is drawn once.
        train = keep(train, "train") if options.max_train_pairs > 0 else train
        with dropped_shuffles(spark):
            files.write_triplets(eval_triplets(train, pool, options), f"{out}/eval_triplets")
        triplets = spark.read.parquet(f"{out}/eval_triplets")
        if triplets.isEmpty():
            forget(spark, f"{out}/eval_triplets")
            raise ValueError("every evaluation pair uses up the negative pool")
        files.write_pairs(train, f"{out}/train_pairs")
        fixed = {
            "profile": profile.name,
            "profile_kind": profile.kind,
            "dataset_ref": "local_csv",
            "source_csv": source_name,
            "max_train_pairs": options.max_train_pairs,
            "max_eval_triplets": options.max_eval_triplets,
            "min_chars": min_chars,
            "min_words": min_words,
            "seed": options.seed,
        }
        frames = {"positive_pairs": positives, "negative_pool_size": pool, "train_pairs": spark.read.parquet(f"{out}/train_pairs"), "eval_triplets": triplets}
        row = counts_row(spark, fixed, mined, frames)
        files.write_report(row, f"{out}/metadata")
    return files.read_report(spark, f"{out}/metadata", row.schema)


def evaluate_model(triplets: DataFrame, table: DataFrame, config: ModelConfig) -> DataFrame:
    """Triplet metrics of a token table.

    A table that fits a broadcast embeds the triplets in place. With a larger one equal triplets are
    embedded once through the relational lookup and weighted.
    """
    if fits_broadcast(config):
        vectors = triplets.select(*ROLES)
        for role in ROLES:
            vectors = embed_batches(vectors, role, table, config, f"{role}_vec")
        named = vectors.select(*[F.col(f"{r}_vec").alias(r) for r in ROLES])
        return triplet_metrics(score_triplets(named))
    key = F.sha2(F.concat_ws("\x00", *ROLES), 256)
    distinct = triplets.groupBy(*ROLES).agg(F.count("*").alias("copies")).withColumn("tid", key)
    sides = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("text")) for r in ROLES]))
    texts = distinct.select("tid", sides.alias("_s")).select("tid", "_s.role", "_s.text")
    vectors = embed_table(texts, ["tid", "role"], "text", table, config)
    wide = vectors.groupBy("tid").agg(
        *[F.max(F.when(F.col("role") == r, F.col("embedding"))).alias(r) for r in ROLES]
    )
    scored = score_triplets(wide.join(distinct.select("tid", "copies"), "tid"), "copies")
    return triplet_metrics(scored, "copies")


def train_job(
    spark: SparkSession, pairs_path: str, triplets_path: str, out: str, config: ModelConfig, options: TrainOptions, max_train_pairs: int = 0
) -> DataFrame:
    """Train on written pairs, save the model and return its report row with the triplet metrics."""
    found = files.read_pairs(spark, pairs_path)
    if found.isEmpty():
        raise ValueError(f"{pairs_path} holds no pairs")
    triplets = files.read_triplets(spark, triplets_path)
    if triplets.isEmpty():
        raise ValueError(f"{triplets_path} holds no triplets")
    copies = found.groupBy("anchor", "positive").agg(F.count("*").alias("_n"))
    keyed = copies.select("anchor", "positive", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("copy"))
    start = init_token_table(spark, config, options.seed + 1)
    with scratch_tables(spark) as keep:
        train = keep(sample_capped(with_pair_key(keyed), max_train_pairs, options.seed, "train", PAIR_KEYS), "train")
        used = train.count()
        table, history = train_epochs(train, start, config, options, kept=True)
    models.save_model(table, config, f"{out}/model")
    metrics = evaluate_model(triplets, table, config)
    report = metrics.select(
        F.lit("spark").alias("backend"),
        F.lit(used).cast("bigint").alias("train_pairs_used"),
        triplets.select(F.count("*")).scalar().alias("eval_triplets"),
        *[F.lit(getattr(options, k)).alias(k) for k in ("epochs", "learning_rate", "margin", "seed")],
        *[F.lit(getattr(config, k)).alias(k) for k in ("vocab_size", "embedding_dim", "max_seq_len")],
        F.struct(*metrics.columns).alias("metrics"),
        history.agg(F.array_sort(F.collect_list(F.struct("epoch", "steps", "active_steps", "mean_active_loss")))).scalar().alias("history"),
    )
    files.write_report(report, f"{out}/metrics")
    return files.read_report(spark, f"{out}/metrics", report.schema)


def pipeline_job(
    spark: SparkSession,
    source: DataFrame,
    profile: Profile,
    out: str,
    config: ModelConfig,
    prepare: PrepareOptions,
    train: TrainOptions,
    skip_train: bool = False,
    model_path: str | None = None,
    source_key: str | None = None,
) -> DataFrame:
    """Prepare, train and evaluate; the row of triplet metrics.

    Each stage leaves a manifest below ``out`` (see ``stages``), so a run that broke off goes on at its first unfinished stage, and one with other
    options repeats only what depends on them. ``source_key`` names the source's content; without it the rows are read once more for a digest.
    With ``skip_train`` the training stage counts as done: its model is the one at ``model_path``, by default the last one trained below ``out``.
    """
    key = source_key or stages.content_key(source)
    shown = {"profile": asdict(profile), "prepare": asdict(prepare)}
    counts = ("positive_pairs", "negative_pool_size", "train_pairs", "eval_triplets")

    def prepared(path: str) -> dict:
        row = prepare_job(spark, source, profile, path, prepare).first()
        return {c: row[c] for c in counts}

    data = stages.stage(spark, out, "data", [key], shown, f"{out}/data", prepared)
    triplets = files.read_triplets(spark, f"{data.path}/eval_triplets")
    if skip_train:
        known = [d.path for d in stages.finished(spark, out, "train")]
        where = model_path or (f"{known[-1]}/model" if known else f"{out}/model")
        model = stages.Done(f"given|{where}", where.removesuffix("/model"), {})
    else:
        options = {"config": asdict(config), "train": asdict(train), "max_train_pairs": prepare.max_train_pairs}

        def trained(path: str) -> dict:
            train_job(spark, f"{data.path}/train_pairs", f"{data.path}/eval_triplets", path, config, train, prepare.max_train_pairs)
            return {}

        model = stages.stage(spark, out, "train", [data.key], options, out, trained)
        where = f"{model.path}/model"

    def evaluated(path: str) -> dict:
        table, loaded = models.load_model(spark, where)
        found = evaluate_model(triplets, table, loaded)
        found.write.parquet(path)
        return {"columns": found.columns}

    done = stages.stage(spark, out, "evaluation", [data.key, model.key], {}, f"{out}/evaluation", evaluated)
    return spark.read.parquet(done.path).select(*done.report["columns"])


def benchmark_report(
    spark: SparkSession, docs: DataFrame, key: str, text: str, samples: DataFrame, value: str, batches: DataFrame, items: str, elapsed_s: str, out: str, query_count: int = 32
) -> DataFrame:
    """One report of a benchmark run: the passages it used, throughput and latency as measured, and retrieval quality.

    ``samples`` holds one measured time a row and ``batches`` one measured batch a row; timing itself is the caller's.
    """
    one = F.lit("all").alias("run")
    parts = {
        "dataset": passages.corpus_stats(passages.sliding_passages(spread(docs.select(key, text)), text)),
        "throughput": stats.throughput(batches.select(one, items, elapsed_s), ["run"], items, elapsed_s).drop("run"),
        "latency": stats.latency_nearest_rank(samples.select(one, value), ["run"], value).drop("run"),
        "quality": retrieval_quality(docs, key, text, query_count),
    }
    row = spark.range(1).select(*[df.select(F.struct(*df.columns)).scalar().alias(name) for name, df in parts.items()])
    files.write_report(row, out)
    return files.read_report(spark, out, row.schema)


def retrieval_quality(
    docs: DataFrame, key: str, text: str, query_count: int = 32, window: int = passages.WINDOW, stride: int = passages.STRIDE,
    max_windows: int | None = None, dim: int = hashed.DEFAULT_DIM, shift: int = 23,
) -> DataFrame:
    """How well queries built from the first passages find their own passage in the whole corpus.

    Passages are ordered by (key, window). The corpus is cut into words once, narrowly: passages are made,
    hashed and scored in the task that reads them, and only each task's best row per query is
    shuffled. Queries and offset negatives come from the first texts alone, read up to a bound of the key; the corpus size matters
    only where the offset wraps around, which is where those first texts are the whole corpus.
    """
    spread_docs = spread(docs.select(key, text))
    needed = query_count + shift
    numbered, available = passages.leading_passages(docs, key, text, needed, window, stride, max_windows)
    eval_count = min(query_count, available)
    wrap = available if available < needed else needed + 1
    queries = numbered.where(F.col("passage_id") < eval_count).select(
        F.col("passage_id").alias("query_id"), key, "window",
        F.col("passage"), T.query_from_passage(F.col("passage"), spaced=True).alias("query"),
    )
    corpus = passages.sliding_passages(spread_docs, text, window, stride, max_windows)
    coding = retrieve.hashed_encoding(dim)
    best = retrieve.top_k(
        queries.select("query_id", F.col("query").alias("payload")), "query_id",
        corpus.select(key, "window", F.col("passage").alias("payload")), [key, "window"],
        "payload", coding, 1,
    )
    hits = best.join(queries.select("query_id", F.col(key).alias("_k"), F.col("window").alias("_w")), "query_id").select(
        F.when((F.col(key) == F.col("_k")) & (F.col("window") == F.col("_w")), 1.0).otherwise(0.0).alias("hit")
    )
    other = numbered.select(F.col("passage_id").alias("negative_id"), F.col("passage").alias("negative"))
    sides = (
        queries.withColumn("negative_id", F.pmod(F.col("query_id") + shift, F.lit(max(wrap, 1))))
        .join(other, "negative_id")
        .select("query", "passage", "negative")
    )
    scored = retrieve.pair_scores(retrieve.pair_scores(sides, "query", "passage", dim, "pos"), "query", "negative", dim, "neg")
    similarity = scored.agg(
        F.count("*").alias("eval_count"),
        F.coalesce(F.avg("pos"), F.lit(0.0)).alias("mean_positive_similarity"),
        F.coalesce(F.avg("neg"), F.lit(0.0)).alias("mean_negative_similarity"),
    )
    accuracy = hits.agg(F.coalesce(F.avg("hit"), F.lit(0.0))).scalar()
    return similarity.select(
        "eval_count",
        accuracy.alias("top1_accuracy"),
        "mean_positive_similarity",
        "mean_negative_similarity",
        (F.col("mean_positive_similarity") - F.col("mean_negative_similarity")).alias("separation"),
    )
