"""Benchmark decontamination by latent semantic retrieval.

1. Documents are kept as sequences of 32 bit word hashes in a written table, so
   text is read once; the upper half of a hash is one of ``VOCAB`` features.
2. Passage frequencies give IDF.  A randomised eigendecomposition of A'A (A: the
   TF-IDF matrix of all passages) with one pass, B = A'(A W): every task adds up
   its share of B, blocks of rows are summed after one shuffle, and the driver
   solves the small problem (VOCAB x RANK, fixed by parameters).  Its
   eigenvectors are A's right singular vectors.
3. Sliding windows of every document and the benchmark items are compared by
   cosine in the latent space; long items are compared in parts.
4. An item of n words of which k = LCS_SHARE n stand in order in a copy has at
   least 2 k - n - 1 pairs of neighbours both kept, so a copy without insertions
   holds that many of its word pairs (k of its words, where that bound is 0).
   Stretches with so many are candidates too, whatever their cosine.
5. Candidates are confirmed by the longest common subsequence of words with the
   item, and of its answer part (its last words).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wayloom.llm.memory import bounded
from wayloom.llm import textvec as tv
from wayloom.llm.scratch import Scratch

VOCAB, RANK = 1 << 16, 64
PASSAGE = 64  # words of a passage in the decomposition
STEP = 8  # words between window starts
WINDOWS = (16, 32)  # the smaller serves items under twice its length; items of twice the larger or more are cut into parts
COSINE = 0.64
LCS_SHARE, ANSWER_SHARE, ANSWER_WORDS = 0.6, 0.5, 8
ITEM_BLOCK = 4096  # benchmark items compared at a time
ROW_BLOCKS = 64
MATRIX = 4_000_000  # cosines held at a time


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32 bit hashes of all words of lower-cased texts, with bounds by text; the upper 16 bits are a word's feature number."""
    buf = tv.LOWER[buf]
    starts, ends, woffs = tv.words(buf, offs)
    return (tv.word_hashes(buf, starts, ends) >> np.uint64(32)).astype(np.uint32), woffs


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, buf, offs in tv.slices(batch.column(1)):
            f, woffs = features(buf, offs)
            data = pa.BinaryArray.from_buffers(pa.binary(), end - first, [None, pa.py_buffer((4 * woffs).astype(np.int32)), pa.py_buffer(f)])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), data], ["doc_id", "feats"])


def _sequences(col: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, bounds by row) of runs of whole documents."""
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) // 4
    data = np.frombuffer(col.buffers()[2] or b"", np.uint32)
    at = 0
    while at < len(col):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        end = min(end, len(col))
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def _passages(offs: np.ndarray, size: int) -> np.ndarray:
    """Starts of the documents' consecutive passages of ``size`` words, and the end."""
    n = np.diff(offs)
    count = -(-n // size)
    doc = np.repeat(np.arange(len(n)), count)
    inner = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return np.concatenate([offs[:-1][doc] + inner * size, offs[-1:]])


def _sum_runs(table: np.ndarray, rows: np.ndarray, cut: np.ndarray, size: np.ndarray, short: int) -> np.ndarray:
    """Sums of table[rows] over the runs that start at ``cut``; runs up to ``short`` long are summed step by step together."""
    out = np.zeros((len(cut), table.shape[1]), np.float32)
    for j in range(min(short, int(size.max(initial=0)))):
        on = np.flatnonzero((size > j) & (size <= short))
        out[on] += table[rows[cut[on] + j]]
    for i in np.flatnonzero(size > short).tolist():
        out[i] = table[rows[cut[i] : cut[i] + size[i]]].sum(axis=0)
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, passages = np.zeros(VOCAB, np.int64), 0
    for batch in batches:
        for _, _, f, offs in _sequences(batch.column(0)):
            starts = _passages(offs, PASSAGE)
            passages += len(starts) - 1
            key = np.repeat(np.arange(len(starts) - 1, dtype=np.int64), np.diff(starts)) * VOCAB + (f >> 16)
            key.sort()
            key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
            df += np.bincount(key % VOCAB, minlength=VOCAB)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], passages))], ["feature", "n"])


def _test_matrix(rank: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((VOCAB, rank), dtype=np.float32)


def _project(shared, rank: int, seed: int, blocks: int):
    """Each task's share of A'(A test), as rows (block of features, float32 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        scaled, out = _test_matrix(rank, seed), np.zeros((VOCAB, rank), np.float32)
        scaled *= idf[:, None].astype(np.float32)
        for batch in batches:
            for _, _, f, offs in _sequences(batch.column(0), 1 << 19):
                if not len(f):
                    continue
                starts = _passages(offs, PASSAGE)
                key = np.repeat(np.arange(len(starts) - 1, dtype=np.int64), np.diff(starts)) * VOCAB + (f >> 16)
                key.sort()
                key = key[np.concatenate([[True], key[1:] != key[:-1]])]  # a feature counts once a passage
                passage, g = key // VOCAB, (key % VOCAB).astype(np.uint16)
                cut = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
                norm = np.add.reduceat(idf[g] ** 2, cut)
                rows = _sum_runs(scaled, g, cut, np.diff(np.append(cut, len(g))), PASSAGE) / norm[:, None].astype(np.float32)  # rows of A have length 1
                order = np.argsort(g, kind="stable")
                g, passage = g[order], passage[order]
                cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
                out[g[cut]] += _sum_runs(rows, passage, cut, np.diff(np.append(cut, len(g))), 24)
        out *= idf[:, None].astype(np.float32)
        parts = np.split(out, blocks)
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "part"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the parts by block."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, part in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.frombuffer(part.as_buffer(), np.float32)
            total[block] = total[block] + x if block in total else x.astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())], ["block", "part"])


def latent_space(encoded: DataFrame, rank: int = RANK, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(VOCAB, rank) map of a word to the latent space (IDF and 1 / singular value included), and the singular values."""
    freq = encoded.select("feats").mapInArrow(bounded(_frequencies), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # VOCAB + 1 rows at most
    feature, count = freq["feature"].to_numpy(), freq["n"].to_numpy()
    n = int(count[feature < 0].sum())
    if not n:
        return np.zeros((VOCAB, rank), np.float32), np.zeros(rank)
    idf = np.zeros(VOCAB)
    idf[feature[feature >= 0]] = np.log((1 + n) / (1 + count[feature >= 0])) + 0.01
    # every task emits VOCAB x rank sums, so the tasks are as many as the cluster keeps busy, not as many as the input has splits
    sc, feats = encoded.sparkSession.sparkContext, encoded.select("feats")
    splits = feats.rdd.getNumPartitions()
    tasks = min(splits, max(2 * sc.defaultParallelism, int(2 * splits**0.5)))
    parts = (
        feats.coalesce(tasks).mapInArrow(bounded(_project(sc.broadcast(idf), rank, seed, ROW_BLOCKS)), "block int, part binary")
        .repartition(ROW_BLOCKS, "block").mapInArrow(bounded(_add), "block int, part binary").toArrow()
    )
    test = _test_matrix(rank, seed)
    b = np.zeros((VOCAB, rank), np.float32)
    size = VOCAB // ROW_BLOCKS
    for block, part in zip(parts["block"].to_pylist(), parts["part"]):
        b[block * size : (block + 1) * size] += np.frombuffer(part.as_buffer(), np.float32).reshape(size, rank)
    del parts
    # Nystrom: with C = A'A and B = C W, C is about B (W'B)^-1 B'; all but B and W is rank x rank
    b += np.float32(np.sqrt(VOCAB) * np.finfo(np.float32).eps * max(float(np.linalg.norm(b)), 1e-30)) * test
    inner = test.T.astype(np.float64) @ b
    del test
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, values.max() * 1e-12 + 1e-300))
    squares, turn = np.linalg.eigh(root.T @ (b.T.astype(np.float64) @ b) @ root)
    order = np.argsort(-squares)
    s = np.sqrt(np.maximum(squares[order], 0.0))
    to_space = root @ turn[:, order] / np.maximum(s, s.max() * 1e-6 + 1e-30) ** 2
    return (b @ to_space.astype(np.float32)) * idf[:, None].astype(np.float32), s


def lcs(a: list[int], b: np.ndarray) -> int:
    """Length of the longest common subsequence, 1 bit a word of ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        u = v & at.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _answer(item: np.ndarray) -> np.ndarray:
    return item[-min(ANSWER_WORDS, max(1, len(item) // 3)) :]


def _least(size: int) -> int:
    """Words of an item that a leak has in order at least."""
    return int(np.ceil(LCS_SHARE * size - 1e-9))


class _Grams:
    """Word pairs of the items (words, where a leak need not hold a pair), and where texts hold enough of one item's."""

    def __init__(self, items: list[np.ndarray]):
        self.size = np.array([len(x) for x in items], np.int64)
        self.need = np.zeros(len(items), np.int64)
        keys, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        self.words = False
        for i, x in enumerate(items):
            pairs = 2 * _least(len(x)) - len(x) - 1
            self.need[i] = pairs if pairs > 0 else _least(len(x))
            self.words |= pairs <= 0
            keys.append(self._pairs(x) if pairs > 0 else self._alone(x))
            own.append(np.full(len(keys[-1]), i, np.int64))
        keys, own = np.concatenate(keys), np.concatenate(own)
        order = np.lexsort((own, keys))
        keys, own = keys[order], own[order]
        cut = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])])) if len(keys) else np.zeros(0, np.int64)
        self.times = np.diff(np.append(cut, len(keys)))
        self.item = own[cut]
        self.keys, first = np.unique(keys[cut], return_index=True)
        self.first = np.append(first, len(cut))
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self._slot(self.keys)] = True

    @staticmethod
    def _pairs(f: np.ndarray) -> np.ndarray:
        return f[:-1].astype(np.uint64) << np.uint64(32) | f[1:]

    @staticmethod
    def _alone(f: np.ndarray) -> np.ndarray:
        return ~(f.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)

    def _hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, number of the key) of the keys that some item has."""
        at = np.flatnonzero(self.seen[self._slot(keys)])
        which = np.searchsorted(self.keys, keys[at])
        on = which < len(self.keys)
        on[on] = self.keys[which[on]] == keys[at[on]]
        return at[on], which[on]

    def candidates(self, f: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, first hit) of stretches of twice an item's length that hold as much of it as a leak must."""
        doc_of = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        at, which = self._hits(self._pairs(f))
        inside = doc_of[at] == doc_of[at + 1]
        at, which = at[inside], which[inside]
        if self.words:
            more = self._hits(self._alone(f))
            at, which = np.concatenate([at, more[0]]), np.concatenate([which, more[1]])
        count = self.first[which + 1] - self.first[which]
        row = np.repeat(self.first[which] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        at, which = np.repeat(at, count), np.repeat(which, count)
        item, low = self.item[row], offs[doc_of[at]]
        out = []
        for shift in (0, 1):  # what is no longer than the item lies inside one stretch of the first or of the second dealing
            cell = (item * (len(f) + 1) + low + (at - low + shift * self.size[item]) // (2 * self.size[item])) * max(1, len(self.keys)) + which
            cell, first = np.unique(cell, return_index=True)  # a pair counts as often as the item has it
            cut = np.flatnonzero(np.diff(cell // max(1, len(self.keys)), prepend=-1))
            if len(cut):
                enough = np.add.reduceat(self.times[row[first]], cut) >= self.need[item[first[cut]]]
                out.append(np.stack([item[first[cut]], np.minimum.reduceat(at[first], cut)])[:, enough])
        item, at = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
        return doc_of[at], item, at


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _close(windows: np.ndarray, target: np.ndarray, cosine: float) -> Iterator[tuple[int, int]]:
    """(window, item) of pairs at least that close; a bounded part of the matrix at a time, however long a text is."""
    rows = max(1, MATRIX // max(1, len(target)))
    for low in range(0, len(windows), rows):
        for at, which in zip(*(x.tolist() for x in np.nonzero(windows[low : low + rows] @ target.T >= cosine))):
            yield low + at, which


def _search(shared, ids: list[int], items: list[np.ndarray], cosine: float):
    groups, plain = [], [x.tolist() for x in items]
    grams, space = _Grams(items), shared.value
    widest = max(map(len, plain), default=0) + STEP
    for w in WINDOWS:
        own = [i for i, x in enumerate(items) if len(x) and (len(x) < 2 * WINDOWS[0]) == (w == WINDOWS[0])]
        # of parts as long as each other, one at least holds the share of the whole
        parts = [(i, part) for i in own for part in np.array_split(items[i], max(1, len(items[i]) // WINDOWS[1]))]
        if own:
            groups.append((w // STEP, np.array([i for i, _ in parts]), _unit(np.stack([space[part >> 16].sum(axis=0) for _, part in parts]))))

    def confirmed(seq: np.ndarray, item: np.ndarray, low: int, high: int) -> tuple[float, float]:
        part = seq[low:high]
        share = lcs(item.tolist(), part) / len(item)
        if share < LCS_SHARE:
            return share, 0.0
        answer = _answer(item)
        return share, lcs(answer.tolist(), part) / len(answer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            doc_ids, out = batch.column(0), []
            for first, _, f, offs in _sequences(batch.column(1), 1 << 16):
                if not len(f):
                    continue
                starts = _passages(offs, STEP)
                blocks = _sum_runs(space, f >> 16, starts[:-1], np.diff(starts), STEP)
                doc = np.searchsorted(offs, starts[:-1], side="right") - 1
                best: dict[tuple[int, int], tuple[bool, float, float]] = {}

                def confirm(d: int, i: int, low: int, high: int) -> None:
                    share, answer = confirmed(f, items[i], max(int(offs[d]), low), min(int(offs[d + 1]), high))
                    found = share >= LCS_SHARE and answer >= ANSWER_SHARE, share, answer
                    best[d, i] = max(best.get((d, i), found), found)

                for wide, own, target in groups:
                    window = blocks.copy()
                    for j in range(1, wide):
                        same = doc[j:] == doc[:-j]
                        window[:-j][same] += blocks[j:][same]
                    reach: dict[tuple[int, int], int] = {}
                    seen, near = -1, set()
                    for at, which in _close(_unit(window), target, cosine):
                        d, i = int(doc[at]), int(own[which])
                        low, high = int(offs[d]), int(offs[d + 1])
                        start, end = int(starts[at]), int(starts[at]) + wide * STEP
                        if at != seen:
                            seen, near = at, set(f[max(low, start - widest) : min(high, end + widest)].tolist())
                        # no common subsequence is longer than the item's words that are near at all
                        if sum(map(near.__contains__, plain[i])) < LCS_SHARE * len(plain[i]):
                            continue
                        key = (d, i)
                        if key in best and best[key][0] or at < reach.get(key, -1):
                            continue
                        slack = len(plain[i]) + STEP
                        confirm(d, i, start - slack, end + slack)
                        reach[key] = at + 2
                for d, i, at in zip(*(x.tolist() for x in grams.candidates(f, offs))):
                    if (d, i) in best and best[d, i][0]:
                        continue
                    size = len(plain[i])
                    near = set(f[max(int(offs[d]), at - size) : min(int(offs[d + 1]), at + 3 * size)].tolist())
                    if sum(map(near.__contains__, plain[i])) >= _least(size):
                        confirm(d, i, at - size, at + 3 * size)
                out += [(first + d, ids[i], a, b) for (d, i), (found, a, b) in best.items() if found]
            if out:
                rows, item_ids, share, answer = zip(*out)
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(rows)), pa.array(item_ids, pa.int64()), pa.array(share), pa.array(answer)], ["doc_id", "item_id", "lcs_share", "answer_share"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", cosine: float = COSINE) -> DataFrame:
    """One row (doc_id, item_id, lcs_share, answer_share) for each benchmark item found in a document.

    Items are compared in blocks of ITEM_BLOCK, so the benchmark may have any
    size.  Defined cases: null or empty texts and items match nothing; rows of
    documents with null ids are reported with a null id; an item's row with a
    null id is left out; repeated documents are each reported; empty tables
    give an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    kind = docs.schema[id_col].dataType.simpleString()
    encoded = scratch.save(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(bounded(_encode), f"doc_id {kind}, feats binary"), "features")
    space, _ = latent_space(encoded)
    shared = docs.sparkSession.sparkContext.broadcast(space)
    schema = f"doc_id {kind}, item_id long, lcs_share double, answer_share double"
    found, block = [], []

    def flush():
        seqs = [features(*tv.buffers(pa.array([t or ""])))[0] for _, t in block]
        found.append(encoded.mapInArrow(bounded(_search(shared, [i for i, _ in block], seqs, cosine)), schema))
        block.clear()

    for row in benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null").toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == ITEM_BLOCK:
            flush()
    if block or not found:
        flush()
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found; null ids are told apart by no one, so their rows stay."""
    bad = leaks(docs, benchmark).select(F.col("doc_id")).where("doc_id is not null").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
