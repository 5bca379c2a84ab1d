"""SQL that computes the registered queries' results a second way, for checking by value.

The statements are composed of fragments so each rule is written once; they run on plain tables
named as in the registry and share no code path with the Spark operators.
"""

from __future__ import annotations

from ..functions.text import WHITE, WRAPPER_END
from . import queries as Q

SEED = Q.SEED
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH_RANGE = "1152921504606846976::DOUBLE"


def ascii_lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WHITE}+'), lambda w: w <> '')"


def clean_a(x: str) -> str:
    kept = f"list_filter({words(ascii_lower(x))}, lambda w: NOT regexp_matches(w, '^https?://'))"
    return f"trim(regexp_replace(array_to_string({kept}, ' '), '[^a-z0-9]+', ' ', 'g'))"


def clean_b(x: str) -> str:
    step = f"regexp_replace(lower({x}), '<[^>]+>', ' ', 'g')"
    step = f"regexp_replace({step}, 'https?://[^{WHITE[1:]}+', ' ', 'g')"
    step = f"regexp_replace({step}, '[^a-z0-9{WHITE[1:]}', ' ', 'g')"
    return f"trim(regexp_replace({step}, '{WHITE}+', ' ', 'g'))"


def h60(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 15))::BIGINT"


def key(seed: int, purpose: str, *parts: str) -> str:
    return "concat_ws('|', " + ", ".join([f"'{seed}'", f"'{purpose}'", *[f"({p})::VARCHAR" for p in parts]]) + ")"


def draw(seed: int, purpose: str, *parts: str) -> str:
    return h60(key(seed, purpose, *parts))


def r6(x: str, name: str = "") -> str:
    return f"round(({x})::DOUBLE, 6) + 0.0::DOUBLE" + (f" AS {name}" if name else "")


def banned() -> str:
    return ", ".join(f"'{d}'" for d in Q.DISALLOW)


def passes(x: str) -> str:
    return f"({x} NOT IN ({banned()}) AND length({x}) >= {Q.MIN_CHARS} AND len(string_split({x}, ' ')) >= {Q.MIN_WORDS})"


def labeled(clean=clean_a, self_pairs: bool = False) -> str:
    """CTEs src, cl, acc, pos, neg."""
    self_rule = "" if self_pairs else "AND lt <> rt"
    return f"""
    src AS (SELECT d.text AS l, e.text AS r, q.quality FROM documents d JOIN labels q ON q.doc_id = d.doc_id
            JOIN documents e ON e.doc_id = d.doc_id + 1),
    cl AS (SELECT * FROM (SELECT {clean('l')} AS lt, {clean('r')} AS rt, quality FROM src) WHERE lt <> '' AND rt <> ''),
    acc AS (SELECT * FROM cl WHERE {passes('lt')} AND {passes('rt')}),
    pos AS (SELECT *, md5(concat_ws('|', length(anchor)::VARCHAR, anchor, length(positive)::VARCHAR, positive, copy::VARCHAR)) AS pkey FROM (
            SELECT DISTINCT least(lt, rt) AS anchor, greatest(lt, rt) AS positive, 1::BIGINT AS copy FROM acc WHERE quality = 1 {self_rule})),
    neg AS (SELECT DISTINCT rt AS negative FROM acc WHERE quality <> 1 AND lt <> rt)"""


def single(clean=clean_a) -> str:
    """CTEs cl, acc over documents."""
    return f"""
    cl AS (SELECT * FROM (SELECT {clean('text')} AS clean FROM documents) WHERE clean <> ''),
    acc AS (SELECT clean FROM cl WHERE {passes('clean')})"""


def sampled(source: str, n: int, seed: int, purpose: str, keys: str = "pkey") -> str:
    parts = [k.strip() for k in keys.split(",")]
    return f"(SELECT * FROM {source} ORDER BY {draw(seed, purpose, *parts)}, {keys}{f' LIMIT {n}' if n > 0 else ''})"


def indexed_pool(neg: str, seed: int) -> str:
    order = f"{draw(seed, 'pool', 'negative')}, negative"
    return f"""
    pool AS (SELECT negative, row_number() OVER (ORDER BY {order}) - 1 AS pool_idx FROM {neg}),
    psize AS (SELECT count(*) AS n FROM pool)"""


def drawn_once(source: str, seed: int) -> str:
    index = f"{draw(seed, 'draw', 'pkey', '0')} % (SELECT n FROM psize)"
    return f"""(SELECT t.anchor, t.positive, t.pkey, pool.negative FROM (SELECT *, {index} AS pool_idx FROM {source}) t JOIN pool USING (pool_idx)
      WHERE pool.negative <> t.anchor AND pool.negative <> t.positive)"""


def drawn(source: str, seed: int, extra: str = "") -> str:
    """Rows (anchor, positive, copy, negative): the first draw, or if it collides one among the entries that are not forbidden."""
    first, second = (draw(seed, "draw", "pkey", k) for k in ("0", "1"))
    n = "(SELECT n FROM psize)"
    bad = "(o.negative = o.anchor OR o.negative = o.positive)"
    room = "CASE WHEN high IS NULL THEN 1 ELSE 2 END"
    return f"""(WITH o AS MATERIALIZED (SELECT t.*, pool.negative FROM (SELECT *, {first} % {n} AS pool_idx FROM {source}) t JOIN pool USING (pool_idx)),
      c AS (SELECT o.* EXCLUDE (negative, pool_idx), least(coalesce(x.pool_idx, y.pool_idx), coalesce(y.pool_idx, x.pool_idx)) AS low,
              CASE WHEN x.pool_idx <> y.pool_idx THEN greatest(x.pool_idx, y.pool_idx) END AS high
            FROM o LEFT JOIN pool x ON x.negative = o.anchor LEFT JOIN pool y ON y.negative = o.positive WHERE {bad}),
      d AS (SELECT *, {second} % ({n} - {room}) AS i0 FROM c WHERE {n} > {room}),
      e AS (SELECT *, i0 + CASE WHEN i0 >= low THEN 1 ELSE 0 END AS i1 FROM d),
      f AS (SELECT *, i1 + CASE WHEN i1 >= high THEN 1 ELSE 0 END AS i2 FROM e)
      SELECT anchor, positive, pkey {extra}, negative FROM o WHERE NOT {bad}
      UNION ALL SELECT f.anchor, f.positive, f.pkey {extra}, pool.negative FROM f JOIN pool ON pool.pool_idx = f.i2)"""


def passages() -> str:
    """CTEs tok, win: all full 80-word windows, every 40 words."""
    return f"""
    tok AS MATERIALIZED (SELECT doc_id, {words('text')} AS w FROM documents),
    win AS MATERIALIZED (SELECT doc_id, i AS "window", array_to_string(w[i * 40 + 1 : i * 40 + 80], ' ') AS passage
            FROM (SELECT doc_id, w, unnest(range((len(w) - 80) // 40 + 1)) AS i FROM tok WHERE len(w) >= 80))"""


def numbered() -> str:
    return passages() + """,
    num AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, "window") - 1 AS passage_id, * FROM win)"""


def query_text(x: str) -> str:
    letters = f"list_filter(list_transform({words(x)}, lambda w: regexp_replace(w, '[^A-Za-z]', '', 'g')), lambda w: length(w) >= 3)"
    picked = f"array_to_string((list_filter({letters}, lambda w, i: (i - 1) % 3 = 0))[1:32], ' ')"
    return f"CASE WHEN {picked} = '' THEN 'empty' ELSE upper({picked}) END"


def hashed_rows(source: str, id_col: str, text: str, dim: int) -> str:
    """(id, dim, w): summed integer weights, zero sums left out."""
    half = lambda a, b: f"('0x' || substr(h, {a}, 7))::BIGINT % {dim} AS {b}"
    return f"""(SELECT {id_col}, dim, sum(w)::BIGINT AS w FROM (
        SELECT {id_col}, unnest([p, q]) AS dim, unnest([2 * s, -s]) AS w FROM (
          SELECT {id_col}, {half(1, 'p')}, {half(8, 'q')}, CASE WHEN ('0x' || substr(h, 15, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS s
          FROM (SELECT {id_col}, md5(t) AS h FROM (SELECT {id_col}, unnest({words(ascii_lower(text))}) AS t FROM {source}))))
      GROUP BY {id_col}, dim HAVING sum(w) <> 0)"""


def bare(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^A-Za-z0-9]+', '', 'g'))"


def token_id(x: str, vocab: int) -> str:
    return f"CASE WHEN {bare(x)} = '' THEN 1::BIGINT ELSE {h60(bare(x))} % {vocab - 2} + 2 END"


def token_rows(source: str, keys: str, text: str, vocab: int) -> str:
    """(keys, position, token_id)."""
    return f"""(SELECT {keys}, i::BIGINT AS position, {token_id('w[i + 1]', vocab)} AS token_id FROM
      (SELECT {keys}, w, unnest(range(len(w))) AS i FROM (SELECT {keys}, {words(text)} AS w FROM {source})))"""


def init_cells(ids: str, dim: int, seed: int) -> str:
    cell = f"({draw(seed, 'init', 'token_id', 'dim')}::DOUBLE / {HASH_RANGE} * 2.0::DOUBLE - 1.0::DOUBLE) * 0.05::DOUBLE"
    return f"(SELECT token_id, dim, CASE WHEN token_id = 0 THEN 0.0::DOUBLE ELSE {cell} END AS x FROM {ids}, range({dim}) AS r(dim))"


def base_table(seed: int = SEED) -> str:
    return init_cells(f"(SELECT range AS token_id FROM range({Q.MODEL.vocab_size}))", Q.MODEL.embedding_dim, seed)


def pooled(tokens: str, keys: str, cells: str) -> str:
    """(keys, dim, x): mean over token occurrences."""
    return f"""(SELECT {keys}, dim, sum(n * x) / sum(n) AS x FROM
      (SELECT {keys}, token_id, count(*) AS n FROM {tokens} GROUP BY ALL) JOIN {cells} c USING (token_id) GROUP BY {keys}, dim)"""


def unit(rows: str, keys: str) -> str:
    return f"""(SELECT {keys}, dim, CASE WHEN s > 0 THEN x / s ELSE x END AS x FROM
      (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY {keys})) AS s FROM {rows}))"""


def doc_tokens(vocab: int) -> str:
    return token_rows("documents", "doc_id", "text", vocab)


def neighbours(k: int) -> str:
    """CTEs v, scored, top: the k best other vectors of each vector."""
    return f"""
    v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    scored AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.e, b.e), 12) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
            QUALIFY rank <= {k})"""


def epoch_triplets(epoch: int, name: str) -> str:
    """CTE ``name`` (tid, anchor, positive, negative) for one epoch over the CTEs pos, pool, psize."""
    ordered = f"""(SELECT *, row_number() OVER (ORDER BY {draw(SEED, f'epoch{epoch}', 'pkey')}, pkey) - 1 AS tid FROM pos)"""
    return f"{name} AS MATERIALIZED (SELECT tid, anchor, positive, negative FROM {drawn(ordered, SEED + epoch, ', tid')})"


def training_start() -> str:
    """CTEs up to the first epoch's triplets and the start table."""
    return f"""{labeled()},
    union_pool AS (SELECT DISTINCT unnest([anchor, positive]) AS negative FROM pos), {indexed_pool('union_pool', SEED)},
    {epoch_triplets(1, 'trip1')}, table1 AS MATERIALIZED (SELECT * FROM {base_table()})"""


def forward(step: int) -> str:
    """CTEs of one step: tokens, unit vectors per role, losses."""
    roles = f"""(SELECT tid, unnest(['anchor', 'positive', 'negative']) AS role, unnest([anchor, positive, negative]) AS text FROM trip{step})"""
    emb = unit(pooled(f"rt{step}", "tid, role", f"table{step}"), "tid, role")
    return f"""
    rt{step} AS MATERIALIZED (SELECT * FROM {token_rows(roles, 'tid, role', 'text', Q.MODEL.vocab_size)}),
    emb{step} AS MATERIALIZED (SELECT * FROM {emb}),
    apn{step} AS MATERIALIZED (SELECT tid, dim, max(x) FILTER (role = 'anchor') AS a, max(x) FILTER (role = 'positive') AS p,
            max(x) FILTER (role = 'negative') AS n FROM emb{step} GROUP BY tid, dim),
    loss{step} AS MATERIALIZED (SELECT tid, greatest(coalesce({Q.TRAINING.margin}::DOUBLE - sum(a * p) + sum(a * n), 0.0::DOUBLE), 0.0::DOUBLE) AS loss
            FROM apn{step} GROUP BY tid)"""


def gradients(step: int) -> str:
    """CTE delta: summed updates per token and dim."""
    return f"""
    g{step} AS (SELECT tid, dim, unnest(['anchor', 'positive', 'negative']) AS role, unnest([n - p, -a, a]) AS g
            FROM apn{step} JOIN loss{step} USING (tid) WHERE loss > 0),
    cnt{step} AS (SELECT tid, role, token_id, count(*) AS n FROM rt{step} GROUP BY 1, 2, 3),
    len{step} AS (SELECT tid, role, count(*) AS len FROM rt{step} GROUP BY 1, 2),
    delta{step} AS MATERIALIZED (SELECT token_id, dim, sum({Q.TRAINING.learning_rate}::DOUBLE * n::DOUBLE / len::DOUBLE * g) AS d
            FROM cnt{step} JOIN len{step} USING (tid, role) JOIN g{step} USING (tid, role) GROUP BY token_id, dim)"""


def stepped(step: int) -> str:
    return f"""
    table{step + 1} AS MATERIALIZED (SELECT t.token_id, t.dim, t.x - coalesce(d.d, 0.0::DOUBLE) AS x
            FROM table{step} t LEFT JOIN delta{step} d USING (token_id, dim))"""


SUMMARY = f"count(*)::BIGINT AS steps, count_if(loss > 0)::BIGINT AS active_steps, {r6('coalesce(avg(loss) FILTER (loss > 0), 0)', 'mean_active_loss')}"


def percentile_columns(kind: str) -> str:
    if kind == "linear":
        return ", ".join(r6(f"quantile_cont(value, {p / 100}::DOUBLE)", f"p{p}_us") for p in (50, 95, 99))
    pick = lambda p: f"max(value) FILTER (rn = floor((n - 1) * {p / 100}::DOUBLE + 0.5::DOUBLE))"
    return ", ".join(r6(pick(p), f"p{p}_us") for p in (50, 95, 99))


def duplicate_counts() -> str:
    return f"""WITH {single()} SELECT {Q.MIN_CHARS}::BIGINT AS min_chars, {Q.MIN_WORDS}::BIGINT AS min_words, {SEED}::BIGINT AS seed,
        (SELECT count(*) FROM cl) AS rows_after_cleaning, (SELECT count(*) FROM acc) AS accepted_rows,
        (SELECT count(*) - count(DISTINCT clean) FROM acc) AS positive_pairs, (SELECT count(DISTINCT clean) FROM acc) AS negative_pool_size"""


def turns(ahead: int) -> str:
    shown = lambda t: f"CASE WHEN {t}.role = 'system' THEN '' ELSE {t}.text END"
    third = ", " + shown("d") + " AS negative" if ahead == 2 else ""
    join = "JOIN conversations d ON d.conv_id = a.conv_id AND d.turn = a.turn + 2" if ahead == 2 else ""
    rule = "AND negative <> ''" if ahead == 2 else ""
    return f"""SELECT * FROM (SELECT {shown('a')} AS anchor, {shown('b')} AS positive {third} FROM conversations a
        JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 {join}) WHERE anchor <> '' AND positive <> '' {rule}"""


def all_texts(clean) -> str:
    return f"""SELECT src, id, {clean('text')} AS clean FROM (
        SELECT 'd' AS src, doc_id AS id, text FROM documents UNION ALL SELECT 'p', page_id, concat_ws(' ', url, html) FROM pages
        UNION ALL SELECT 'c', conv_id * 1000000 + turn, text FROM conversations)"""


def prepared() -> str:
    o = Q.PREPARE
    return f"""WITH {labeled()}, {indexed_pool('neg', SEED)},
        train AS (SELECT * FROM {sampled('pos', o.max_train_pairs, SEED, 'train')}),
        chosen AS (SELECT * FROM {sampled('train', o.max_eval_triplets, SEED + 7, 'triplet')}),
        ev AS (SELECT * FROM {drawn('chosen', SEED + 11)})
        SELECT 'train' AS output, anchor, positive, NULL::VARCHAR AS negative FROM train
        UNION ALL SELECT 'eval', anchor, positive, negative FROM ev
        UNION ALL SELECT 'metadata', concat_ws('|', (SELECT count(*) FROM cl), (SELECT count(*) FROM pos)),
          concat_ws('|', (SELECT count(*) FROM neg), (SELECT count(*) FROM train)),
          concat_ws('|', (SELECT count(*) FROM ev), {Q.MIN_CHARS}, {Q.MIN_WORDS}, {SEED})"""


STEPS = 6


def chain(epochs: int = 2, steps: int = STEPS) -> tuple[list[str], int]:
    """CTEs of every step of every epoch, and how many; ``steps`` covers the pairs of the tables this is checked on."""
    parts, k = [], 0
    for epoch in range(1, epochs + 1):
        parts.append(epoch_triplets(epoch, f"epoch{epoch}"))
        for batch in range(steps):
            k += 1
            parts.append(f"trip{k} AS MATERIALIZED (SELECT * FROM epoch{epoch} WHERE tid // {Q.BATCH_ROWS} = {batch})")
            parts += [forward(k), gradients(k), stepped(k)]
    return parts, k


def mini_batches(steps: int = STEPS) -> str:
    parts, k = chain(steps=steps)
    lost = " UNION ALL ".join(f"SELECT {1 + (n - 1) // steps}::BIGINT AS epoch, loss FROM loss{n}" for n in range(1, k + 1))
    return f"""WITH {labeled()},
        union_pool AS (SELECT DISTINCT unnest([anchor, positive]) AS negative FROM pos), {indexed_pool('union_pool', SEED)},
        table1 AS MATERIALIZED (SELECT * FROM {base_table()}), {", ".join(parts)}
        SELECT epoch, {SUMMARY} FROM ({lost}) GROUP BY epoch"""


def chained() -> str:
    """Prepare, two epochs of mini-batches from the training start table, and the metrics of the drawn triplets."""
    parts, k = chain()
    roles = "(SELECT tid, unnest(['anchor', 'positive', 'negative']) AS role, unnest([anchor, positive, negative]) AS text FROM ev)"
    emb = unit(pooled("et", "tid, role", f"table{k + 1}"), "tid, role")
    return f"""WITH {labeled()},
        ev AS MATERIALIZED (WITH {indexed_pool('neg', SEED)} SELECT row_number() OVER (ORDER BY pkey) AS tid, anchor, positive, negative FROM {drawn('pos', SEED + 11)}),
        union_pool AS (SELECT DISTINCT unnest([anchor, positive]) AS negative FROM pos), {indexed_pool('union_pool', SEED)},
        table1 AS MATERIALIZED (SELECT * FROM {base_table(SEED + 1)}), {", ".join(parts)},
        et AS MATERIALIZED (SELECT * FROM {token_rows(roles, 'tid, role', 'text', Q.MODEL.vocab_size)}),
        ee AS MATERIALIZED (SELECT * FROM {emb}),
        w AS (SELECT tid, dim, max(x) FILTER (role = 'anchor') AS a, max(x) FILTER (role = 'positive') AS p, max(x) FILTER (role = 'negative') AS n FROM ee GROUP BY tid, dim),
        s AS (SELECT tid, coalesce(sum(a * p), 0) AS p, coalesce(sum(a * n), 0) AS n FROM w GROUP BY tid)
        SELECT {r6('avg((p > n)::INT)', 'triplet_accuracy')}, {r6('avg(p)', 'mean_positive_similarity')}, {r6('avg(n)', 'mean_negative_similarity')},
          {r6('avg(p) - avg(n)', 'mean_margin')} FROM s"""


def quality() -> str:
    rows = lambda src, i, t: hashed_rows(src, i, t, Q.HASH_DIM)
    return f"""WITH {numbered()},
        total AS (SELECT count(*) AS n FROM num),
        q AS MATERIALIZED (SELECT passage_id AS query_id, {query_text('passage')} AS query FROM num WHERE passage_id < {Q.QUERY_COUNT}),
        qw AS MATERIALIZED (SELECT * FROM {rows('q', 'query_id', 'query')}), pw AS MATERIALIZED (SELECT * FROM {rows('num', 'passage_id', 'passage')}),
        qn AS (SELECT query_id, sum(w * w)::BIGINT AS s FROM qw GROUP BY 1), pn AS (SELECT passage_id, sum(w * w)::BIGINT AS s FROM pw GROUP BY 1),
        dots AS (SELECT query_id, passage_id, sum(qw.w * pw.w)::BIGINT AS d FROM qw JOIN pw USING (dim) GROUP BY 1, 2),
        scores AS MATERIALIZED (SELECT q.query_id, num.passage_id,
              coalesce(d::DOUBLE / sqrt((qn.s * pn.s)::DOUBLE), 0.0::DOUBLE) AS score
            FROM q CROSS JOIN num LEFT JOIN dots USING (query_id, passage_id) LEFT JOIN qn USING (query_id) LEFT JOIN pn USING (passage_id)),
        best AS (SELECT query_id, passage_id FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) = 1),
        pn2 AS (SELECT s.query_id, max(score) FILTER (s.passage_id = s.query_id) AS pos,
              max(score) FILTER (s.passage_id = (s.query_id + 23) % (SELECT n FROM total)) AS neg FROM scores s GROUP BY 1)
        SELECT count(*)::BIGINT AS eval_count, {r6('avg(CASE WHEN passage_id = query_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 'top1_accuracy')},
          {r6('avg(pos)', 'mean_positive_similarity')}, {r6('avg(neg)', 'mean_negative_similarity')}, {r6('avg(pos) - avg(neg)', 'separation')}
        FROM best JOIN pn2 USING (query_id)"""


def rank_loss() -> str:
    tok = lambda role, col: token_rows("qa", "conv_id, turn", col, Q.MODEL.vocab_size)
    emb = lambda role, col: unit(pooled(tok(role, col), "conv_id, turn", "table1"), "conv_id, turn")
    order = f"{draw(SEED, 'batch', 'conv_id', 'turn')}, conv_id, turn"
    return f"""WITH table1 AS MATERIALIZED (SELECT * FROM {base_table()}),
        qa AS (SELECT a.conv_id, a.turn, a.text AS ask, b.text AS reply FROM conversations a JOIN conversations b
               ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
        pos AS MATERIALIZED (SELECT conv_id, turn, (row_number() OVER (ORDER BY {order}) - 1) // {Q.LOSS_BATCH} AS batch FROM qa),
        a AS MATERIALIZED (SELECT * FROM {emb('a', 'ask')}), p AS MATERIALIZED (SELECT * FROM {emb('p', 'reply')}),
        ab AS (SELECT batch, conv_id, turn, dim, x FROM a JOIN pos USING (conv_id, turn)), pb AS (SELECT batch, conv_id, turn, dim, x FROM p JOIN pos USING (conv_id, turn)),
        logit AS (SELECT ab.batch, ab.conv_id, ab.turn, ab.conv_id = pb.conv_id AND ab.turn = pb.turn AS own, sum(ab.x * pb.x) * 20.0::DOUBLE AS s
            FROM ab JOIN pb ON ab.batch = pb.batch AND ab.dim = pb.dim GROUP BY ab.batch, ab.conv_id, ab.turn, pb.conv_id, pb.turn),
        per AS (SELECT batch, conv_id, turn, ln(sum(exp(s))) - max(s) FILTER (own) AS loss FROM logit GROUP BY 1, 2, 3)
        SELECT batch::BIGINT AS batch, count(*)::BIGINT AS size, {r6('avg(loss)', 'loss')} FROM per GROUP BY batch"""


def bootstrap() -> str:
    """Each sample's draws split over halves of the sorted values by the quantile of a binomial, spelled out as sums of its masses."""
    tail = 0.025
    mass = "exp(lgamma(c + 1) - lgamma(i + 1) - lgamma(c - i + 1) + i * ln(p) + (c - i) * ln(1 - p))"
    below = f"list_sum(list_transform(range(0, j + 1), lambda i: {mass}))"
    return f"""WITH RECURSIVE m AS (SELECT event_type, event_id % {Q.REPEATS} AS rep, avg(value) AS v FROM events WHERE event_id % {Q.REPEATS} <> 2 GROUP BY 1, 2),
        vals AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY v) - 1 AS pos, v FROM m),
        s AS (SELECT event_type, count(*) AS n FROM m GROUP BY 1),
        walk(event_type, b, side, lo, hi, c, r) AS (
          SELECT event_type, b, side, 0::BIGINT, n, n, (n - 1 + side) // 2 FROM s, range(3000) AS x(b), range(2) AS y(side)
          UNION ALL
          SELECT event_type, b, side, CASE WHEN r < k THEN lo ELSE mid END, CASE WHEN r < k THEN mid ELSE hi END, CASE WHEN r < k THEN k ELSE c - k END, CASE WHEN r < k THEN r ELSE r - k END
          FROM (SELECT *, least(c, len(list_filter(range(0, c + 1), lambda j: {below} <= u))) AS k
            FROM (SELECT *, (lo + hi) // 2 AS mid, ((lo + hi) // 2 - lo) / (hi - lo)::DOUBLE AS p, {draw(SEED, 'bootstrap', 'event_type', 'b', 'lo', 'hi')} / {1 << 60}::DOUBLE AS u
              FROM walk WHERE hi - lo > 1))),
        med AS (SELECT event_type, b, avg(v) AS v FROM walk JOIN vals USING (event_type) WHERE hi - lo = 1 AND pos = lo GROUP BY 1, 2)
        SELECT event_type, count(*)::BIGINT AS samples, {r6(f'quantile_cont(v, {tail}::DOUBLE)', 'ci_low')}, {r6(f'quantile_cont(v, {1 - tail}::DOUBLE)', 'ci_high')}
        FROM med GROUP BY event_type"""


def board() -> str:
    cols = ", ".join(r6(f"max(s) FILTER (lang = '{c}')", c) for c in Q.LANGUAGES)
    return f"""WITH s AS (SELECT source AS run, lang, avg(quality) AS s FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)
        SELECT run, {cols}, {r6('avg(s)', 'mean_score')} FROM s GROUP BY run"""


def ranking() -> str:
    return f"""WITH {neighbours(10)},
        r AS (SELECT query_id, rank, (b.label = a.label)::INT AS rel FROM top JOIN embeddings b USING (vec_id) JOIN embeddings a ON a.vec_id = query_id),
        h AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM r),
        tot AS (SELECT a.vec_id AS query_id, count(*) - 1 AS total FROM embeddings a JOIN embeddings b USING (label) GROUP BY 1),
        per AS (SELECT query_id, sum(rel / log2(rank + 1)) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) AS x(i) WHERE i <= any_value(total)) AS ndcg,
            sum(rel * hits / rank) / any_value(total) AS ap, sum(rel) / any_value(total) AS rec, coalesce(1 / min(rank) FILTER (rel = 1), 0) AS mrr
            FROM h JOIN tot USING (query_id) WHERE total > 0 GROUP BY query_id)
        SELECT count(*)::BIGINT AS queries, {r6('avg(ndcg)', 'ndcg_at_10')}, {r6('avg(ap)', 'map_at_10')}, {r6('avg(rec)', 'recall_at_10')}, {r6('avg(mrr)', 'mrr_at_10')} FROM per"""


def all_oracles() -> dict[str, str]:
    start = training_start()
    vec = r6("x", "value")
    docs16 = doc_tokens(Q.MODEL.vocab_size)
    embedded = unit(pooled(docs16, "doc_id", "cells"), "doc_id")
    with_cells = f"WITH cells AS MATERIALIZED (SELECT * FROM {base_table()})"
    pick = "WITH " + start + "," + forward(1)
    embed = f"{with_cells} SELECT doc_id, dim, {vec} FROM {embedded}"
    numbered_words = f"len({words('text')})"
    position = "row_number() OVER (ORDER BY doc_id) - 1"
    synth_draw = h60(f"concat_ws('|', ({SEED} + seq_len * 101)::VARCHAR, 'synth', doc_id::VARCHAR, i::VARCHAR)")
    wide = ", ".join(r6(f"coalesce(max(v) FILTER (dim = {i}), 0)", f"emb_{i}") for i in range(Q.WIDE_DIM))
    label_forms = "[q, ' ' || q || chr(9), q || '.0', '+' || q, 'x' || q, q || '99999999999999999999', q || '3000000000', '']"
    digits = "'^[+-]?[0-9]+$'"
    trimmed = f"regexp_replace(regexp_replace(raw, '^{WHITE}+', ''), '{WHITE}+$', '')"
    no_line_ends = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    langs = "SELECT DISTINCT unnest([lang, lang || '_missing']) AS task_name FROM documents"
    return {
        "src_csv_text": "SELECT page_id::VARCHAR AS page_id, url, html FROM pages",
        "src_csv_text_ranges": "SELECT doc_id::VARCHAR AS doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents",
        "src_discover": """SELECT 'lang=' || min(lang) AS folder, true AS same_for_unknown_name,
            count(*) FILTER (lang = (SELECT min(lang) FROM documents)) AS rows, count(*) AS all_rows, sum(doc_id)::BIGINT AS all_ids FROM documents""",
        "src_corpus_text": f"SELECT {no_line_ends} AS text FROM documents WHERE text NOT LIKE '%{WRAPPER_END}%'",
        "src_corpus_files": f"""SELECT 'single' AS kind, doc_id::VARCHAR AS name, (len({no_line_ends}) + 1)::BIGINT AS chars, len({words('text')})::BIGINT AS words,
              (len({no_line_ends}) - len(replace({no_line_ends}, chr(10), '')) + 1)::BIGINT AS lines FROM documents
            UNION ALL SELECT 'large', lang, sum(len({no_line_ends}) + 1)::BIGINT, sum(len({words('text')}))::BIGINT,
              sum(len({no_line_ends}) - len(replace({no_line_ends}, chr(10), '')) + 1)::BIGINT FROM documents GROUP BY lang""",
        "src_pairs": turns(1),
        "src_triplets": turns(2),
        "sink_pairs": f"WITH {labeled()} SELECT anchor, positive FROM pos",
        "sink_triplets": f"WITH {labeled()}, {indexed_pool('neg', SEED)} SELECT anchor, positive, negative FROM {drawn('pos', SEED)}",
        "sink_report": duplicate_counts(),
        "prep_stats": duplicate_counts(),
        "model_save_load": f"""WITH v AS (SELECT count(DISTINCT w) + 2 AS n FROM (SELECT {bare('t')} AS w FROM (SELECT unnest({words('text')}) AS t FROM documents)) WHERE w <> '')
            SELECT n::BIGINT AS vocab_size, n::BIGINT AS token_rows, (n * 8)::BIGINT AS cells, 0::BIGINT AS misshapen, 0::BIGINT AS out_of_range, true AS valid FROM v""",
        "src_ir_results": f"""WITH s AS (SELECT lang, avg(quality) AS main_score, avg(toxic) AS ndcg_at_10, avg(quality * toxic) AS map_at_10,
              count(*) / 1000.0::DOUBLE AS recall_at_10, min(quality)::DOUBLE AS mrr_at_10, sum(n_chars)::DOUBLE / 1000.0::DOUBLE AS evaluation_time_s
              FROM documents JOIN labels USING (doc_id) GROUP BY lang)
            SELECT t.task_name, CASE WHEN lang IS NULL THEN NULL ELSE 'rev1' END AS dataset_revision, main_score, ndcg_at_10, map_at_10, recall_at_10, mrr_at_10,
              evaluation_time_s, CASE WHEN lang IS NULL THEN 'result_json_not_found' END AS error FROM ({langs}) t LEFT JOIN s ON s.lang = t.task_name""",
        "clean_ascii": all_texts(clean_a),
        "clean_markup": all_texts(clean_b),
        "filter_text": f"SELECT * FROM (SELECT doc_id, {clean_a('text')} AS clean FROM documents) WHERE {passes('clean')}",
        "filter_question": f"""SELECT conv_id, turn, form, regexp_matches(raw, '\\?{WHITE}*$') AS keep_ascii, suffix(raw, '?') AS keep_markup FROM (
            SELECT conv_id, turn, unnest([0::BIGINT, 1, 2]) AS form, unnest([text, text || '?', text || '?  ' || chr(10)]) AS raw FROM conversations)""",
        "parse_label": f"""SELECT doc_id, form, coalesce(CASE WHEN regexp_matches({trimmed}, {digits}) THEN try_cast({trimmed} AS BIGINT) END, 0)::BIGINT AS label_ascii,
            coalesce(CASE WHEN regexp_matches(raw, {digits}) THEN try_cast(raw AS INT) END, -999)::BIGINT AS label_markup FROM (
            SELECT doc_id, unnest(range(8)) AS form, unnest({label_forms}) AS raw FROM (SELECT doc_id, quality::VARCHAR AS q FROM labels))""",
        "canonical_pair": """SELECT conv_id, turn, least(x, y) AS anchor, greatest(x, y) AS positive FROM (
            SELECT a.conv_id, a.turn, CASE WHEN a.role = 'system' THEN '' ELSE a.text END AS x, CASE WHEN b.role = 'system' THEN '' ELSE b.text END AS y
            FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)""",
        "effective_thresholds": f"""SELECT doc_id, coalesce(toxic, quality * 20, {Q.MIN_CHARS})::BIGINT AS min_chars_ascii,
            coalesce(nullif(toxic, 0), quality * 20, {Q.MIN_CHARS})::BIGINT AS min_chars_markup FROM documents LEFT JOIN labels USING (doc_id)""",
        "mine_labeled_positives": f"WITH {labeled()} SELECT anchor, positive FROM pos",
        "mine_labeled_positives_markup": f"WITH {labeled(clean_b, True)} SELECT anchor, positive FROM pos",
        "mine_labeled_negatives": f"WITH {labeled()} SELECT negative FROM neg",
        "mine_duplicates": f"""WITH {single()} SELECT clean AS anchor, clean AS positive, copy FROM (
            SELECT clean, row_number() OVER (PARTITION BY clean) - 1 AS copy FROM acc) WHERE copy > 0""",
        "mine_duplicates_distinct": f"""WITH {single(clean_b)} SELECT DISTINCT clean AS anchor, nxt AS positive FROM (
            SELECT clean, lead(clean) OVER (PARTITION BY clean ORDER BY clean) AS nxt FROM acc) WHERE nxt IS NOT NULL""",
        "negative_pool_texts": f"WITH {single()} SELECT DISTINCT clean AS negative FROM acc",
        "negative_pool_union": f"WITH {labeled()} SELECT anchor AS negative FROM pos UNION SELECT positive FROM pos",
        "prepare_job": prepared(),
        "sample_capped": f"SELECT doc_id, text FROM documents ORDER BY {draw(SEED, 'sample', 'doc_id')}, doc_id LIMIT {Q.SAMPLE_ROWS}",
        "shuffle_epoch": f"""WITH {labeled()} SELECT row_number() OVER (ORDER BY {draw(SEED, 'epoch1', 'pkey')}, pkey) - 1 AS position,
            anchor, positive FROM pos""",
        "negatives_reject": f"WITH {labeled()}, {indexed_pool('neg', SEED)} SELECT anchor, positive, negative FROM {drawn('pos', SEED)}",
        "negatives_single_draw": f"WITH {labeled()}, {indexed_pool('neg', SEED)} SELECT anchor, positive, negative FROM {drawn_once('pos', SEED)}",
        "cycle_texts": f"""WITH d AS (SELECT {position} AS idx, count(*) OVER () AS n, doc_id, text FROM documents)
            SELECT position, doc_id, text FROM range((SELECT count(*) * 5 // 2 FROM documents)) AS r(position) JOIN d ON idx = position % n""",
        "synth_texts": f"""WITH b AS (SELECT list(w ORDER BY {h60('w')}, w) AS p FROM (SELECT * FROM (SELECT DISTINCT unnest({words('text')}) AS w FROM documents)
              ORDER BY {h60('w')}, w LIMIT {Q.POOL_WORDS}))
            SELECT doc_id, seq_len, array_to_string(list_transform(range(1, seq_len + 1), lambda i: p[{synth_draw} % len(p) + 1]), ' ') AS text
            FROM (SELECT doc_id, {numbered_words}::BIGINT AS seq_len FROM documents), b""",
        "chunk_rows": f"SELECT doc_id, position, (position // {Q.BATCH_ROWS})::BIGINT AS batch FROM (SELECT doc_id, {position} AS position FROM documents)",
        "token_ids": f"SELECT doc_id, position, token_id FROM {doc_tokens(Q.WIDE_VOCAB.vocab_size)}",
        "hash_embed": f"""WITH w AS MATERIALIZED (SELECT * FROM {hashed_rows('documents', 'doc_id', 'text', Q.HASH_DIM)}), s AS (SELECT doc_id, sqrt(sum(w * w)::DOUBLE) AS s FROM w GROUP BY 1)
            SELECT doc_id, dim, {r6('(w::DOUBLE / s)::FLOAT', 'value')} FROM w JOIN s USING (doc_id)""",
        "hash_embed_wide": f"""WITH c AS (SELECT conv_id * 1000000 + turn AS id, text FROM conversations), w AS MATERIALIZED (SELECT * FROM {hashed_rows('c', 'id', 'text', Q.WIDE_DIM)}),
            v AS (SELECT id, dim, (w::DOUBLE / sqrt((sum(w * w) OVER (PARTITION BY id))::DOUBLE))::FLOAT AS v FROM w)
            SELECT text, {wide} FROM c LEFT JOIN v USING (id) GROUP BY id, text""",
        "l2_normalize": f"""WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE * label AS x FROM embeddings)
            SELECT vec_id, dim, {vec} FROM {unit('x', 'vec_id')}""",
        "dot_similarity": f"""SELECT a.vec_id, {r6('list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])', 'similarity')}
            FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
        "mean_pool": f"{with_cells} SELECT doc_id, dim, {vec} FROM {pooled(docs16, 'doc_id', 'cells')}",
        "masked_mean_pool": f"""{with_cells}, t AS (SELECT * FROM {docs16}), m AS (SELECT doc_id, dim, avg(x) FILTER (token_id <> 1) AS x FROM t JOIN cells USING (token_id) GROUP BY 1, 2)
            SELECT doc_id, dim, {r6('coalesce(x, 0)', 'value')} FROM m""",
        "init_token_table": f"""WITH ids AS (SELECT DISTINCT token_id FROM {doc_tokens(Q.WIDE_VOCAB.vocab_size)} UNION SELECT unnest([0, 1]))
            SELECT token_id, dim, {vec} FROM {init_cells('ids', Q.WIDE_VOCAB.embedding_dim, SEED)}""",
        "embed_table": embed,
        "embed_batch_udf": embed,
        "sliding_passages": f'WITH {passages()} SELECT doc_id, "window", passage FROM win',
        "query_from_passage": f'WITH {passages()} SELECT doc_id, "window", {query_text("passage")} AS query FROM win',
        "corpus_stats": f"""WITH {passages()} SELECT count(*)::BIGINT AS passage_count, {r6('avg(strlen(passage))', 'mean_bytes')},
            {r6(f'avg(len({words("passage")}))', 'mean_words')} FROM win""",
        "token_lookup": f"""{with_cells}, t AS (SELECT * FROM {docs16})
            SELECT doc_id, position, token_id, {r6('a.x', '"first"')}, {r6('b.x', '"last"')} FROM t JOIN (SELECT * FROM cells WHERE dim = 0) a USING (token_id)
            JOIN (SELECT * FROM cells WHERE dim = {Q.MODEL.embedding_dim - 1}) b USING (token_id)""",
        "retrieve_top1": f"WITH {neighbours(1)} SELECT query_id, vec_id AS best_id, {r6('score', 'score')} FROM top",
        **dict.fromkeys(["retrieve_topk", "retrieve_topk_indexed"], f"WITH {neighbours(10)} SELECT query_id, rank, vec_id, {r6('score', 'score')} FROM top"),
        "offset_negative": f"""WITH {numbered()}, n AS (SELECT count(*) AS n FROM num)
            SELECT a.passage_id, b.passage_id AS negative_idx, b.passage AS negative FROM num a, n JOIN num b ON b.passage_id = (a.passage_id + 23) % n""",
        "triplet_loss": f"{pick} SELECT tid, {r6('coalesce(loss, 0)', 'loss')} FROM trip1 LEFT JOIN loss1 USING (tid)",
        "triplet_gradients": f"{pick}, {gradients(1)} SELECT token_id, dim, {r6('d', 'value')} FROM delta1",
        "train_step": f"{pick}, {gradients(1)}, {stepped(1)} SELECT token_id, dim, {vec} FROM table2",
        "train_epochs": mini_batches(),
        "epoch_summary": f"{pick} SELECT {SUMMARY} FROM loss1",
        "inbatch_rank_loss": rank_loss(),
        "pipeline_job": chained(),
        "benchmark_report": f"""WITH c AS (WITH {passages()} SELECT count(*)::BIGINT AS passage_count, {r6('avg(strlen(passage))', 'mean_bytes')},
              {r6(f'avg(len({words("passage")}))', 'mean_words')} FROM win),
            b AS (SELECT count(*) AS items, sum(value) / 1000.0::DOUBLE AS el FROM events GROUP BY event_type, user_id),
            t AS (SELECT sum(items)::BIGINT AS items, {r6('sum(items) / greatest(sum(el), 2.220446049250313e-16::DOUBLE)', 'per_second')} FROM b),
            e AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS rn, count(*) OVER () AS n FROM events),
            l AS (SELECT any_value(n) AS n, {percentile_columns('nearest')} FROM e), q AS ({quality()})
            SELECT passage_count, items, n, eval_count, mean_bytes, mean_words, per_second, p50_us, p95_us, p99_us, top1_accuracy, separation FROM c, t, l, q""",
        "triplet_metrics": f"""WITH s AS (SELECT list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS p, list_dot_product(a.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS n
              FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2)
            SELECT {r6('avg((p > n)::INT)', 'triplet_accuracy')}, {r6('avg(p)', 'mean_positive_similarity')}, {r6('avg(n)', 'mean_negative_similarity')},
              {r6('avg(p) - avg(n)', 'mean_margin')} FROM s""",
        "retrieval_quality": quality(),
        "ir_metrics": ranking(),
        "leaderboard": board(),
        "latency_nearest_rank": f"""WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
            SELECT event_type, any_value(n) AS n, {r6('avg(value)', 'mean_us')}, {r6('min(value)', 'min_us')}, {r6('max(value)', 'max_us')}, {percentile_columns('nearest')} FROM e GROUP BY event_type""",
        "latency_linear": f"""SELECT event_type, count(*)::BIGINT AS n, {r6('avg(value)', 'mean_us')}, {r6('max(value)', 'max_us')}, {percentile_columns('linear')}
            FROM events GROUP BY event_type""",
        "throughput": f"""WITH b AS (SELECT event_type, user_id, count(*) AS items, sum(value) / 1000.0::DOUBLE AS el FROM events GROUP BY 1, 2)
            SELECT event_type, sum(items)::BIGINT AS items, {r6('sum(el)', 'elapsed_s')}, {r6('sum(items) / greatest(sum(el), 2.220446049250313e-16::DOUBLE)', 'per_second')},
              {r6('sum(el) * 1e6::DOUBLE / sum(items)', 'mean_item_us')}, {r6('max(el / items * 1e6::DOUBLE)', 'max_item_us')} FROM b GROUP BY event_type""",
        "repeat_summary": f"""WITH m AS (SELECT event_type, event_id % {Q.REPEATS} AS rep, avg(value) AS mean_us, max(value) AS max_us, count(*) / sum(value) AS per_us FROM events GROUP BY 1, 2),
            l AS (SELECT event_type, rep, unnest(['mean_us', 'max_us', 'per_us']) AS metric, unnest([mean_us, max_us, per_us]) AS v FROM m)
            SELECT event_type, metric, count(*)::BIGINT AS repeats, {r6('quantile_cont(v, 0.5::DOUBLE)', 'median')},
              string_agg(round(v * 1e6::DOUBLE)::BIGINT::VARCHAR, ',' ORDER BY rep) AS all_repeats_e6 FROM l GROUP BY 1, 2""",
        "bootstrap_median_ci": bootstrap(),
        "length_stats": f"""SELECT lang, {r6('avg(n)', 'mean_words')}, min(n)::BIGINT AS min_words, max(n)::BIGINT AS max_words
            FROM (SELECT lang, {numbered_words} AS n FROM documents) GROUP BY lang""",
    }
