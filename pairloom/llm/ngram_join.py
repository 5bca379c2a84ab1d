"""Jaccard join on word 5-grams by T-occurrence search.

A document is the set of its 5-word shingles; equal sets are one node. A partner of a node with n shingles shares at
least T = ceil(0.8 n) of them. The work runs in three steps, none of which lists all pairs of a group:

1. Inverted lists. Each bounded batch deals its shingles, packed, to parts by hash. A part finds those that
   several nodes hold; the others have lists of length one and can support no link. Nodes with fewer than T shared
   shingles are done.
2. Hubs. Ordered by list length, a node's first c - T + 1 lists are its short ones (c shared shingles), and linked nodes meet
   in one of them. Every node is compared with the hub, the least unusual node of a list, that it meets most often.
3. T-occurrence search (DivideSkip). What a hub connects needs no further proof. A node in a short list whose most frequent
   component is another one visits that component, so two linked nodes that are still apart meet where one of them lives or both
   visit. A task holds a bounded chunk of such a block as inverted lists: the short lists of a visitor are merged and counted, and
   members that occur often enough there are probed for in the long lists by binary search until they cannot reach the overlap any more, which
   gives the exact overlap. One link is enough for a visitor and a component.

Connected components of hub and search links are the classes. A link joins members of one class, so ``linked_groups`` counts the links
of every document by searching each class in itself, the pairs inside the components of step 2 among them. A class is cut into cells of
two bounded parts; a cell gives numbers of links and no pairs.

Shingles are told apart by 48 bits within a part, so two
sets of a thousand shingles would disagree about one of them once in ten million pairs.

Defined cases: null, empty and blank texts have the empty set, link with nothing and keep their own id; a text of fewer
than five words is one shingle, its whole sequence. A null id is no smallest id where another is known. Rows that repeat an
id and a text are one node and ``drop_near_duplicates`` keeps one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
PERCENT = 80
HITS = 1
PART_SHINGLES = 4_000_000
BUCKET_NODES = 20_000
ASIDE_HITS = 3
CHUNK_BYTES = 4 << 20
CHUNK_QUERIES = 2000
CELL_BYTES = 1 << 20
_KEY_BYTES = 6


def needed(size):
    """Least overlap of a set of this size with any partner."""
    return -(-PERCENT * size // 100)


def sets_of(table: pa.Table, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text."""
    raw, offsets = common.text_buffer(table.column("text"))
    starts, ends, first = common.words(raw, offsets)
    hashes = common.word_hashes(raw, starts, ends, fold_case=True)
    runs = common.run_hashes(hashes, shingle, 5)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= shingle:
            out.append(np.unique(runs[a : b - shingle + 1]))
        else:
            out.append(common.run_hashes(hashes[a:b], b - a, 100 + b - a) if b > a else np.zeros(0, np.uint64))
    return out


def name_of(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else b""


def named_sets(records) -> Iterator[pa.RecordBatch]:
    """Arrow mapper: (doc_id, n_shingles, node, text_sha256) of each document."""
    for table in common.batches(records):
        sets = sets_of(table)
        texts = table.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                table.column("doc_id").combine_chunks(), pa.array([len(s) for s in sets], pa.int64()), pa.array([name_of(s) for s in sets], pa.binary()),
                pa.array([hashlib.sha256((t or "").encode()).hexdigest() for t in texts], pa.string()),
            ],
            names=["doc_id", "n_shingles", "node", "text_sha256"],
        )


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _KEY_BYTES, 8), np.uint8)
    out[:, :_KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, _KEY_BYTES)
    return out.view(np.uint64).ravel()


def dealt_sets(parts: int):
    """Arrow mapper: each batch's sets, once per distinct set, dealt to parts by shingle."""

    def run(records) -> Iterator[pa.RecordBatch]:
        for table in common.batches(records):
            sets = {name_of(s): s for s in sets_of(table) if len(s)}
            if not sets:
                continue
            names, sizes = np.array(list(sets), dtype="V16"), np.array([len(s) for s in sets.values()], np.int32)
            keys, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            part = ((keys >> np.uint64(16)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            borders = np.searchsorted(part[order], np.arange(parts + 1))
            for k in range(parts):
                mine = order[borders[k] : borders[k + 1]]
                if len(mine):
                    own, counts = np.unique(owner[mine], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k], pa.int32()), pa.array([names[own].tobytes()], pa.binary()), pa.array([sizes[own].tobytes()], pa.binary()),
                            pa.array([counts.astype(np.int32).tobytes()], pa.binary()), pa.array([_pack(keys[mine])], pa.binary()),
                        ],
                        names=["part", "names", "sizes", "counts", "keys"],
                    )

    return run


def _read(group: pa.Table):
    """Names, sizes and counts of a group's nodes, one entry per row and node, and their keys."""
    cols = {c: group.column(c).to_pylist() for c in ("names", "sizes", "counts", "keys")}
    names = np.concatenate([np.frombuffer(x, "V16") for x in cols["names"]])
    sizes = np.concatenate([np.frombuffer(x, np.int32) for x in cols["sizes"]])
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in cols["counts"]])
    return names, sizes, counts, cols["keys"]


def shared_shingles(buckets: int):
    """One part: the shingles that several nodes hold, with their list lengths, dealt to buckets by node."""

    def run(group: pa.Table) -> pa.Table:
        names, sizes, counts, packed = _read(group)
        part = group.column("part")[0].as_py()
        keys = np.concatenate([_unpack(x) for x in packed])
        order = np.argsort(keys)
        ranked = keys[order]
        twice = np.zeros(len(keys), dtype=bool)
        same = ranked[1:] == ranked[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        order = order[twice]
        nodes, node_of = np.unique(names, return_inverse=True)
        owner = np.repeat(node_of.astype(np.int32), counts)[order]
        size_of = np.zeros(len(nodes), np.int32)
        size_of[node_of] = sizes
        keys = keys[order]
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        keys, owner = keys[fresh], owner[fresh]
        _u, inverse, length = np.unique(keys, return_inverse=True, return_counts=True)
        length = length[inverse]
        keys, owner, length = keys[length > 1], owner[length > 1], np.minimum(length[length > 1], 65535).astype(np.uint16)
        order = np.argsort(owner, kind="stable")
        keys, owner, length = keys[order], owner[order], length[order]
        held, first, counts = np.unique(owner, return_index=True, return_counts=True)
        bucket = (nodes[held].view(np.uint64)[::2] % np.uint64(buckets)).astype(np.int64) if len(held) else np.zeros(0, np.int64)
        rows = []
        for k in np.unique(bucket).tolist():
            mine = np.flatnonzero(bucket == k)
            spans = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in mine])
            rows.append((k, part, nodes[held[mine]].tobytes(), size_of[held[mine]].tobytes(), counts[mine].astype(np.int32).tobytes(), _pack(keys[spans]), length[spans].tobytes()))
        cols = list(zip(*rows)) or [[] for _ in range(7)]
        types = [pa.int32(), pa.int32()] + [pa.binary()] * 5
        return pa.table([pa.array(list(c), t) for c, t in zip(cols, types)], names=["bucket", "part", "names", "sizes", "counts", "keys", "lengths"])

    return run


def candidates(group: pa.Table) -> pa.Table:
    """One bucket of nodes: those with enough shared shingles, their short lists and all their shared shingles."""
    names, sizes, counts, packed = _read(group)
    parts = np.repeat(np.array(group.column("part").to_pylist(), np.uint64), [len(x) // _KEY_BYTES for x in packed])
    keys = common.mix(np.concatenate([_unpack(x) for x in packed]) + parts * np.uint64(0x9E3779B97F4A7C15))
    lengths = np.concatenate([np.frombuffer(x, np.uint16) for x in group.column("lengths").to_pylist()])
    nodes, node_of = np.unique(names, return_inverse=True)
    size_of = np.zeros(len(nodes), np.int64)
    size_of[node_of] = sizes
    shared = np.bincount(node_of, weights=counts, minlength=len(nodes)).astype(np.int64)
    owner = np.repeat(node_of, counts)
    alive = np.flatnonzero(shared >= needed(size_of))
    keep = np.isin(owner, alive)
    owner, keys, lengths = owner[keep], keys[keep], lengths[keep]
    order = np.lexsort((keys, lengths, owner))
    owner, keys = owner[order], keys[order]
    first = np.searchsorted(owner, alive)
    out = []
    for node, a in zip(alive.tolist(), first.tolist()):
        n, c = int(size_of[node]), int(shared[node])
        least = int(needed(n))
        hits = min(HITS, least)
        mine = keys[a : a + c]
        out.append((nodes[node].tobytes(), n, n - c, mine[: c - least + hits].view(np.int64), np.sort(mine).tobytes()))
    cols = list(zip(*out)) or [[] for _ in range(5)]
    types = [pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, types)], names=["node", "n", "alone", "short", "shared"])


def probe(records) -> Iterator[pa.RecordBatch]:
    """Arrow mapper over (a, b, n_a, n_b, shared_a, shared_b): the pairs whose similarity is high enough."""
    for record in records:
        keep = []
        for na, nb, x, y in zip(*(record.column(record.schema.get_field_index(c)).to_pylist() for c in ("n_a", "n_b", "shared_a", "shared_b"))):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            x, y = (x, y) if len(x) < len(y) else (y, x)
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            keep.append(100 * both >= PERCENT * (na + nb - both))
        yield record.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def with_sets(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Add the size and the shared shingles of the node in ``key``. The sets stay where they are while the rows are few."""
    side = nodes.select(F.col("node").alias(key), F.col("n").alias(f"n_{key}"), F.col("shared").alias(f"shared_{key}"))
    few = rows.count() * 100 <= common.SMALL_SIDE_BYTES
    return side.join(F.broadcast(rows) if few else rows, key)


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked."""
    pairs = common.written(pairs.select("a", "b"), "pairs")
    hubs = common.written(with_sets(pairs.select("b").distinct(), nodes, "b"), "hubs")
    return common.map_arrow(with_sets(pairs, nodes, "a").join(hubs, "b"), probe, "a binary, b binary")


def hub_pairs(short: DataFrame) -> DataFrame:
    """(a, b): each node with the hub of a list that it meets most often.

    A hub is the node of the list with the fewest shingles of its own, which of copies with changes is the one nearest to all.
    """
    hubs = short.groupBy("token").agg(F.min(F.struct("alone", "node", "n")).alias("hub"), F.count("*").alias("m")).where("m > 1")
    met = short.join(hubs, "token").where("node <> hub.node").withColumn("hub_n", F.col("hub.n"))
    met = met.where(100 * F.least("n", "hub_n") >= PERCENT * F.greatest("n", "hub_n"))
    times = met.groupBy("node", F.col("hub.node").alias("b")).count()
    return times.groupBy("node").agg(F.max(F.struct("count", "b")).alias("best")).select(F.col("node").alias("a"), F.col("best.b").alias("b"))


def visits(short: DataFrame, placed: DataFrame) -> DataFrame:
    """(node, component, block): nodes and the other components that are the most frequent ones of their short lists."""
    entries = short.select("token", "node").join(placed.select("node", "component"), "node")
    per = entries.groupBy("token", "component").count()
    mixed = per.groupBy("token").agg(F.count("*").alias("k"), F.max(F.struct("count", "component")).alias("top")).where("k > 1")
    met = entries.join(mixed.select("token", F.col("top.component").alias("block")), "token")
    return met.where("component <> block").select("node", "component", "block").distinct()


class Index:
    """Inverted lists over the sets of some members; list entries are in the order of the members."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        flat = np.concatenate(sets)
        member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.keys, self.member, self.sizes = flat[order], member[order], sizes

    def search(self, asked: np.ndarray, size: int, skip: np.ndarray) -> np.ndarray:
        """DivideSkip: members linked to a set of ``size`` shingles, of which the shared ones are asked.

        The longest lists are set aside, so many that a result must still be in ``ASIDE_HITS`` of the others. Those are merged
        and counted; what is left is looked up in the long lists, the shorter ones first.
        """
        low, high = np.searchsorted(self.keys, asked, "left"), np.searchsorted(self.keys, asked, "right")
        order = np.argsort(high - low, kind="stable")
        order = order[(high - low)[order] > 0]
        low, high = low[order], high[order]
        # Overlap that makes a link with each member: 100 o >= PERCENT (a + b - o).
        wanted = -(-PERCENT * (size + self.sizes) // (100 + PERCENT))
        aside = max(0, min(len(low), int(needed(size)) - ASIDE_HITS))
        split = len(low) - aside
        if not split:
            return np.zeros(0, np.int64)
        merged = np.concatenate([self.member[a:b] for a, b in zip(low[:split], high[:split])])
        found, hits = np.unique(merged, return_counts=True)
        alive = (hits + aside >= wanted[found]) & ~skip[found]
        found, hits = found[alive], hits[alive]
        for k in range(split, len(low)):
            if not len(found):
                break
            entries = self.member[low[k] : high[k]]
            at = np.minimum(np.searchsorted(entries, found), len(entries) - 1)
            hits = hits + (entries[at] == found)
            alive = hits + (len(low) - k - 1) >= wanted[found]
            found, hits = found[alive], hits[alive]
        return found[hits >= wanted[found]]


def search(group: pa.Table) -> pa.Table:
    """Some chunks of blocks: for each visitor one linked member of each other component."""
    rows = {c: group.column(c).to_pylist() for c in ("block", "chunk", "turn", "asks", "node", "component", "n_node", "shared_node")}
    tasks: dict[tuple, tuple[list[int], list[int]]] = {}
    for i, key in enumerate(zip(rows["block"], rows["chunk"], rows["turn"])):
        tasks.setdefault(key, ([], []))[rows["asks"][i]].append(i)
    found = set()
    for members, queries in tasks.values():
        if not members or not queries:
            continue
        members.sort(key=lambda i: rows["node"][i])
        index = Index([np.frombuffer(rows["shared_node"][i], np.uint64) for i in members], np.array([rows["n_node"][i] for i in members]))
        components, number = np.unique(np.array([rows["component"][i] for i in members], dtype="V16"), return_inverse=True)
        known = {c.tobytes(): k for k, c in enumerate(components)}
        for i in queries:
            own = known.get(rows["component"][i], -1)
            hits = index.search(np.frombuffer(rows["shared_node"][i], np.uint64), rows["n_node"][i], number == own)
            for m in hits[np.unique(number[hits], return_index=True)[1]].tolist():
                found.add((rows["node"][i], rows["node"][members[m]]))
    a, b = zip(*sorted(found)) if found else ((), ())
    return pa.table([pa.array(list(a), pa.binary()), pa.array(list(b), pa.binary())], names=["a", "b"])


def search_links(nodes: DataFrame, visiting: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b): links between nodes of different components.

    A block is a component and its visitors. It is dealt to chunks of bounded bytes and its visitors to turns of bounded number; a
    task holds a few (chunk, turn) pairs.
    """
    guests = visiting.select("block", "node", "component")
    homes = placed.join(visiting.select(F.col("block").alias("component")).distinct(), "component").select(F.col("component").alias("block"), "node", "component")
    people = common.written(homes.unionByName(guests).join(placed.select("node", "n"), "node"), "block-members")
    sizes = people.groupBy("block").agg(F.sum("n").alias("shingles"), F.count_if(F.col("component") != F.col("block")).alias("guests"))
    chunks = common.written(
        sizes.select("block", F.ceil(8 * F.col("shingles") / CHUNK_BYTES).cast("int").alias("chunks"), F.ceil(F.col("guests") / CHUNK_QUERIES).cast("int").alias("turns")), "block-chunks"
    )
    total = chunks.agg(F.sum(F.col("chunks") * F.col("turns")).alias("t")).first()["t"] or 0
    cut = people.join(chunks, "block")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    members = cut.select("block", "node", "component", part("chunks").alias("chunk"), every("turns").alias("turn"), F.lit(0).alias("asks"))
    queries = cut.where("component <> block").select("block", "node", "component", every("chunks").alias("chunk"), part("turns").alias("turn"), F.lit(1).alias("asks"))
    rows = common.written(members.unionByName(queries), "block-rows")
    bucket = F.pmod(F.xxhash64("block", "chunk", "turn"), F.lit(common.parts_for(total, 8)))
    return with_sets(rows, nodes, "node").groupBy(bucket.alias("bucket")).applyInArrow(search, "a binary, b binary")


def cell_links(group: pa.Table) -> pa.Table:
    """Some cells of classes: how many rows each node is linked with there, those of its own set left out.

    A cell holds two parts of a class, or one part alone, which is searched in itself.
    """
    rows = {c: group.column(c).to_pylist() for c in ("block", "low", "high", "part", "node", "weight", "n_node", "shared_node")}
    cells: dict[tuple, tuple[list[int], list[int]]] = {}
    for i, key in enumerate(zip(rows["block"], rows["low"], rows["high"])):
        cells.setdefault(key, ([], []))[rows["part"][i] != key[1]].append(i)
    weight, links = np.array(rows["weight"], np.int64), np.zeros(len(group), np.int64)
    for (_block, low, high), (members, others) in cells.items():
        alone = low == high
        if not members or not (alone or others):
            continue
        members = np.array(members)
        index = Index([np.frombuffer(rows["shared_node"][i], np.uint64) for i in members], np.array([rows["n_node"][i] for i in members]))
        skip = np.zeros(len(members), dtype=bool)
        for at, i in enumerate(members.tolist() if alone else others):
            skip[at % len(members)] = alone
            hits = members[index.search(np.frombuffer(rows["shared_node"][i], np.uint64), rows["n_node"][i], skip)]
            skip[at % len(members)] = False
            links[i] += weight[hits].sum()
            if not alone:
                links[hits] += weight[i]
    return pa.table([group.column("node"), pa.array(links)], names=["node", "links"])


def node_links(nodes: DataFrame, placed: DataFrame, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(node, links): the rows of other sets that are linked with each node; ``placed`` has node, component and rows.

    A class of p parts is p (p + 1) / 2 cells and each node lies in p of them, so every pair of nodes meets in one cell.
    """
    people = common.written(nodes.select("node", "n").join(placed, "node").select("node", F.col("component").alias("block"), "n", F.col("rows").alias("weight")), "class-members")
    sizes = people.groupBy("block").agg(F.sum("n").alias("shingles"), F.count("*").alias("m")).where("m > 1")
    parts = common.written(sizes.select("block", "shingles", F.ceil(8 * F.col("shingles") / cell_bytes).cast("int").alias("parts")), "class-parts")
    total = parts.agg(F.sum(8 * F.col("shingles") * F.col("parts")).alias("b")).first()["b"] or 0
    dealt = people.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = common.written(
        dealt.select("block", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "weight"), "class-cells"
    )
    bucket = F.pmod(F.xxhash64("block", "low", "high"), F.lit(common.parts_for(total, 2 * cell_bytes)))
    found = with_sets(rows, nodes, "node").groupBy(bucket.alias("bucket")).applyInArrow(cell_links, "node binary, links bigint")
    return found.groupBy("node").agg(F.sum("links").alias("links"))


def _grouped(docs: DataFrame):
    """(rows of ``near_groups`` with their nodes, nodes with their sets, distinct sets with class and rows)."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    named = common.written(common.map_arrow(source, named_sets, "doc_id bigint, n_shingles bigint, node binary, text_sha256 string"), "sets")
    totals = named.agg(F.sum("n_shingles").alias("s"), F.count("*").alias("d")).first()
    parts, buckets = common.parts_for(totals["s"] or 0, PART_SHINGLES), common.parts_for(totals["d"], BUCKET_NODES)
    dealt = common.map_arrow(source.select("text"), dealt_sets(parts), "part int, names binary, sizes binary, counts binary, keys binary")
    shared = dealt.groupBy("part").applyInArrow(shared_shingles(buckets), "bucket int, part int, names binary, sizes binary, counts binary, keys binary, lengths binary")
    nodes = common.written(
        shared.groupBy("bucket").applyInArrow(candidates, "node binary, n int, alone int, short array<bigint>, shared binary"), "nodes"
    )
    short = nodes.select("node", "n", "alone", F.explode("short").alias("token"))
    connected = common.components(verified(hub_pairs(short), nodes))
    placed = common.written(nodes.select("node", "n").join(connected, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    visiting = common.written(visits(short, placed), "visits")
    links = connected.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(search_links(nodes, visiting, placed))
    classes = common.components(links)
    least = named.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    inside = least.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    totals = inside.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n_texts"), F.sum("rows").alias("all_rows")).where("all_rows > 1")
    placed = common.written(inside.select("node", "component", "rows").join(totals, "component").select("node", "component", "rows", "component_id", "n_texts"), "classes")
    groups = named.join(placed.select("node", "component_id", "n_texts"), "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_texts").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_texts", F.lit(1)).cast("bigint").alias("n_texts"), "text_sha256", "node",
    )
    return groups, nodes, placed


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_texts (nodes in its class), text_sha256."""
    return _grouped(docs)[0].drop("node")


def linked_groups(docs: DataFrame, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """The rows of ``near_groups`` and ``n_links``, the number of other rows that each is linked with."""
    groups, nodes, placed = _grouped(docs)
    inside = placed.select("node", "component", "rows")
    links = inside.join(node_links(nodes, inside, cell_bytes), "node", "left").select("node", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return groups.join(links, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("bigint")).drop("node")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with one document left of each class: the one with the smallest id."""
    found = near_groups(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return common.keep_rows(docs, found, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
