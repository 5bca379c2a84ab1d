"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

The same layer is used twice. Over characters it turns the spelling of each distinct word into a vector; over words it
reads, for every window of 32 words (a new one each 24 words, the whole text covered), that vector next to a word
embedding. Attention pools the states of a window, a logistic unit scores it, and a document's score comes from the
softmax-weighted mean of its windows' logits: bad windows weigh more than clean ones, but a very long text of clean windows can outvote one.

Training is numpy on the driver over a sample whose size is fixed by ``SAMPLE_TOXIC``, ``SAMPLE_CLEAN`` and
``SAMPLE_CHARS``; scoring is one narrow pass over all rows and whole texts.

Defined cases: null, empty and blank texts have no window and get the score of the bias alone; a null id counts as not
held out. Labels, language, source and id are no inputs. Rows score alike wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, STRIDE = 32, 24
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 600, 900, 4000
FOLDS = 5
EPOCHS, LEAST_STEPS, DOCS_PER_STEP, RATE = 4, 200, 32, 0.012
HIDDEN, CHAR_DIM, WORD_DIM, ATTENTION = 8, 8, 12, 8
SEGMENT = 32
LENGTH_BANDS = (4, 8, 16)
VOCABULARY, LEAST_TEXTS = 20_000, 3
SHARPNESS = 2.0
BATCH_BYTES = 2 << 20


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Layer:
    """Bidirectional gated units and attention over (time, sequence, input) arrays; both directions in one product."""

    def __init__(self, rng, inputs: int, name: str, p: dict, hidden: int = HIDDEN):
        self.h, self.name, self.p = hidden, name, p
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        p[f"{name}.W"], p[f"{name}.b"] = make(inputs, 6 * hidden), np.zeros(6 * hidden, np.float32)
        p[f"{name}.U"] = make(2, hidden, 3 * hidden)
        p[f"{name}.A"], p[f"{name}.v"] = make(2 * hidden, ATTENTION), make(ATTENTION, 1)[:, 0]

    def project(self, x):
        return x @ self.p[f"{self.name}.W"] + self.p[f"{self.name}.b"]

    def forward(self, projected, mask, keep: bool = False):
        """(sequences, 2 hidden) from projected inputs (time, sequence, 6 hidden) and a 0/1 mask (time, sequence)."""
        steps, count, h = *mask.shape, self.h
        u, state = self.p[f"{self.name}.U"], np.zeros((2, count, self.h), np.float32)
        states = np.zeros((2, steps, count, h), np.float32)
        saved = []
        for t in range(steps):
            back = steps - 1 - t
            a = np.stack([projected[t, :, : 3 * h], projected[back, :, 3 * h :]])
            m = np.stack([mask[t], mask[back]])[:, :, None]
            g = state @ u
            zr = _sigmoid(a[..., : 2 * h] + g[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            n = np.tanh(a[..., 2 * h :] + r * g[..., 2 * h :])
            new = state + m * (1 - z) * (n - state)
            if keep:
                saved.append((state, m, z, r, n, g[..., 2 * h :]))
            state = new
            states[0, t], states[1, back] = state[0], state[1]
        both = np.concatenate([states[0], states[1]], axis=-1)
        hidden = np.tanh(both @ self.p[f"{self.name}.A"])
        e = np.where(mask > 0, hidden @ self.p[f"{self.name}.v"], -1e9)
        weight = np.exp(e - e.max(axis=0, keepdims=True)) * mask
        weight /= np.maximum(weight.sum(axis=0, keepdims=True), 1e-9)
        pooled = np.einsum("tn,tnk->nk", weight, both)
        return (pooled, (saved, both, hidden, weight)) if keep else (pooled, None)

    def backward(self, d_pooled, cache, grads):
        """Gradient of the projected inputs; parameter gradients are added to ``grads``."""
        saved, both, hidden, weight = cache
        name, h = self.name, self.h
        d_weight = np.einsum("nk,tnk->tn", d_pooled, both)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=0, keepdims=True))
        grads[f"{name}.v"] += np.einsum("tn,tna->a", d_e, hidden)
        d_hidden = d_e[:, :, None] * self.p[f"{name}.v"] * (1 - hidden**2)
        grads[f"{name}.A"] += np.einsum("tnk,tna->ka", both, d_hidden)
        d_both = weight[:, :, None] * d_pooled + d_hidden @ self.p[f"{name}.A"].T
        steps, count = weight.shape
        u = self.p[f"{name}.U"]
        d_projected = np.zeros((steps, count, 6 * h), np.float32)
        d_state = np.zeros((2, count, h), np.float32)
        for t in range(steps - 1, -1, -1):
            back = steps - 1 - t
            state, m, z, r, n, gn = saved[t]
            d_new = d_state + np.stack([d_both[t, :, :h], d_both[back, :, h:]])
            gate = m * d_new
            d_n = gate * (1 - z) * (1 - n**2)
            d_z = -gate * (n - state) * z * (1 - z)
            d_r = d_n * gn * r * (1 - r)
            d_g = np.concatenate([d_z, d_r, d_n * r], axis=-1)
            grads[f"{name}.U"] += np.swapaxes(state, 1, 2) @ d_g
            d_state = d_new * (1 - m * (1 - z)) + d_g @ np.swapaxes(u, 1, 2)
            d_a = np.concatenate([d_z, d_r, d_n], axis=-1)
            d_projected[t, :, : 3 * h] += d_a[0]
            d_projected[back, :, 3 * h :] += d_a[1]
        grads[f"{name}.b"] += d_projected.sum(axis=(0, 1))
        return d_projected


class Network:
    def __init__(self, vocabulary: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.vocabulary, self.p = np.sort(vocabulary), {}
        self.chars = Layer(rng, CHAR_DIM, "char", self.p)
        self.words = Layer(rng, 2 * HIDDEN + WORD_DIM, "word", self.p)
        self.p["bytes"] = (0.3 * rng.standard_normal((256, CHAR_DIM))).astype(np.float32)
        self.p["embedding"] = (0.1 * rng.standard_normal((len(vocabulary) + 1, WORD_DIM))).astype(np.float32)
        self.p["embedding"][-1] = 0
        self.p["out"], self.p["bias"] = (0.3 * rng.standard_normal(2 * HIDDEN)).astype(np.float32), np.float32([-1.0])

    def embedding_row(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each word in the embedding; the last one stands for all other words."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary))

    def spell(self, letters, mask, keep=False):
        """Vectors of spellings given as bytes (time, word)."""
        table = self.chars.project(self.p["bytes"])
        return self.chars.forward(table[letters], mask, keep)

    def spelled(self, raw, starts, ends, step: int = 4096) -> np.ndarray:
        """One vector a word; words over ``SEGMENT`` bytes are the mean over their segments."""
        out = np.zeros((len(starts), 2 * HIDDEN), np.float32)
        lengths = ends - starts
        counts = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(starts)), counts)
        begin = np.repeat(starts, counts) + SEGMENT * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
        size = np.minimum(np.repeat(ends, counts) - begin, SEGMENT)
        order = np.argsort(size, kind="stable")
        for a in range(0, len(order), step):
            mine = order[a : a + step]
            vectors, _ = self.spell(*letter_block(raw, begin[mine], size[mine]))
            np.add.at(out, owner[mine], vectors)
        return out / np.maximum(counts, 1)[:, None]


def letter_block(raw, begin, size):
    """(letters, mask) of shape (longest, words)."""
    steps = np.arange(int(size.max()))[:, None]
    mask = steps < size
    letters = raw[np.minimum(begin + steps, len(raw) - 1)]
    return common.ASCII_LOWER[letters] * mask, mask.astype(np.float32)


class Windows:
    """Distinct words and windows of a set of texts."""

    def __init__(self, column):
        self.raw, offsets = common.text_buffer(column)
        starts, ends, first = common.words(self.raw, offsets)
        hashes = common.word_hashes(self.raw, starts, ends, fold_case=True)
        self.hashes, lead, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        self.starts, self.ends = starts[lead], ends[lead]
        lengths = np.diff(first)
        counts = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE)), 0)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.document = np.repeat(np.arange(len(counts)), counts)
        begin = first[:-1][self.document] + STRIDE * (np.arange(len(self.document)) - self.first[:-1][self.document])
        self.begin, self.size = begin, np.minimum(WINDOW, first[1:][self.document] - begin)

    def block(self, rows):
        """(word indexes, mask) of some windows, time first."""
        steps = np.arange(WINDOW)[:, None]
        mask = steps < self.size[rows]
        return self.word[np.minimum(self.begin[rows] + steps, len(self.word) - 1)], mask.astype(np.float32)


def pool_logits(logits, first, bias):
    """Document logits from window logits; documents without windows get the bias."""
    out = np.full(len(first) - 1, bias, np.float64)
    weights = np.zeros(len(logits))
    for d in np.flatnonzero(np.diff(first)):
        mine = logits[first[d] : first[d + 1]].astype(np.float64)
        w = np.exp(SHARPNESS * (mine - mine.max()))
        weights[first[d] : first[d + 1]] = w / w.sum()
        out[d] = (weights[first[d] : first[d + 1]] * mine).sum()
    return out, weights


def scores(net: Network, column, step: int = 2048) -> np.ndarray:
    """Score of each text."""
    windows = Windows(column)
    bias = float(net.p["bias"][0])
    logits = np.zeros(len(windows.document), np.float32)
    if len(logits):
        inputs = np.concatenate([net.spelled(windows.raw, windows.starts, windows.ends), net.p["embedding"][net.embedding_row(windows.hashes)]], axis=1)
        table = net.words.project(inputs)
        for a in range(0, len(logits), step):
            rows = np.arange(a, min(a + step, len(logits)))
            index, mask = windows.block(rows)
            logits[rows] = net.words.forward(table[index], mask)[0] @ net.p["out"] + bias
    return 1 / (1 + np.exp(-np.clip(pool_logits(logits, windows.first, bias)[0], -40, 40)))


def train(texts: list[str], labels: list[int], prior: float, epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Fit the network; ``prior`` is the share of toxic rows among all, which the sample need not have."""
    column = pa.array(texts, pa.large_string())
    raw, offsets = common.text_buffer(column)
    starts, ends, first = common.words(raw, offsets)
    hashes = common.word_hashes(raw, starts, ends, fold_case=True)
    seen, counts = np.unique(np.concatenate([np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]), return_counts=True)
    order = np.lexsort((seen, -counts))[:VOCABULARY]
    net = Network(seen[order][counts[order] >= LEAST_TEXTS], seed)
    y = np.array(labels, np.float64)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    weight = np.where(y > 0, prior / share, (1 - prior) / (1 - share))
    rng = np.random.default_rng(seed)
    m, v, t = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(texts) // DOCS_PER_STEP)))
    steps = epochs * -(-len(texts) // DOCS_PER_STEP)
    for _ in range(epochs):
        shuffled = rng.permutation(len(texts))
        for a in range(0, len(texts), DOCS_PER_STEP):
            mine = np.sort(shuffled[a : a + DOCS_PER_STEP])
            grads = gradients(net, column.take(pa.array(mine)), y[mine], weight[mine] / len(mine))
            t += 1
            rate = RATE * (1 - 0.9 * t / steps)
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
            net.p["embedding"][-1] = 0
    return net


def gradients(net: Network, column, y, weight) -> dict[str, np.ndarray]:
    """Gradient of the weighted logistic loss over some documents."""
    grads = {k: np.zeros_like(x) for k, x in net.p.items()}
    windows = Windows(column)
    if not len(windows.document):
        return grads
    size = np.minimum(windows.ends - windows.starts, SEGMENT)
    spelled, spellings = np.zeros((len(size), 2 * HIDDEN), np.float32), []
    for low, top in zip((0, *LENGTH_BANDS), (*LENGTH_BANDS, SEGMENT)):
        band = np.flatnonzero((size > low) & (size <= top))
        if len(band):
            letters, letter_mask = letter_block(windows.raw, windows.starts[band], size[band])
            spelled[band], cache = net.spell(letters, letter_mask, keep=True)
            spellings.append((band, letters, cache))
    rows = net.embedding_row(windows.hashes)
    inputs = np.concatenate([spelled, net.p["embedding"][rows]], axis=1)
    index, mask = windows.block(np.arange(len(windows.document)))
    pooled, cache = net.words.forward(net.words.project(inputs)[index], mask, keep=True)
    logits = pooled @ net.p["out"] + net.p["bias"][0]
    document, share = pool_logits(logits, windows.first, float(net.p["bias"][0]))
    d_document = weight * (1 / (1 + np.exp(-document)) - y)
    d_logits = (d_document[windows.document] * share * (1 + SHARPNESS * (logits - document[windows.document]))).astype(np.float32)
    grads["bias"] += np.float32(d_logits.sum() + d_document[np.diff(windows.first) == 0].sum())
    grads["out"] += pooled.T @ d_logits
    d_projected = net.words.backward(d_logits[:, None] * net.p["out"], cache, grads)
    d_table = summed(index.ravel(), d_projected.reshape(-1, d_projected.shape[-1]), len(inputs))
    grads["word.W"] += inputs.T @ d_table
    d_inputs = d_table @ net.p["word.W"].T
    grads["embedding"] += summed(rows, d_inputs[:, 2 * HIDDEN :], len(grads["embedding"]))
    for band, letters, cache in spellings:
        d_letters = net.chars.backward(d_inputs[band, : 2 * HIDDEN], cache, grads)
        d_bytes = summed(letters.ravel(), d_letters.reshape(-1, d_letters.shape[-1]), 256)
        grads["char.W"] += net.p["bytes"].T @ d_bytes
        grads["bytes"] += d_bytes @ net.p["char.W"].T
    return grads


def summed(index, values, rows: int):
    """Sum of the values of each index."""
    out = np.zeros((rows, values.shape[-1]), np.float32)
    if len(index):
        order = np.argsort(index, kind="stable")
        ranked = index[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        out[ranked[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


# --- Spark -----------------------------------------------------------------------------------


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Train on a bounded sample of the rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").where(~held_out())
    rates = known.agg(F.avg("toxic").alias("prior")).first()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.where(f"toxic = {k}").orderBy(*order).limit(n) for k, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.length("text").between(1, SAMPLE_CHARS))
    rows = sorted(texts.join(ids, "doc_id").limit(4 * (SAMPLE_TOXIC + SAMPLE_CLEAN)).collect(), key=lambda r: (r.doc_id, r.toxic, r.text))
    return train([r.text for r in rows], [r.toxic for r in rows], rates.prior or 0.0) if rows else Network(np.zeros(0, np.uint64))


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(records) -> Iterator[pa.RecordBatch]:
        for table in common.batches(records, target=BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(scores(shared.value, table.column("text")))], names=["doc_id", "score"])

    found = common.map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of ``docs``, all columns, that score below one half."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(records) -> Iterator[pa.RecordBatch]:
        for table in common.batches(records, target=BATCH_BYTES):
            yield from table.filter(pa.array(scores(shared.value, table.column("text")) < 0.5)).to_batches()

    return common.map_arrow(docs, run, docs.schema)
