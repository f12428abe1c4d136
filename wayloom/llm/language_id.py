"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (proximal, per coordinate) under
elastic-net penalties, then calibrated by a temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wayloom.llm.memory import bounded
from wayloom.llm import textvec as tv

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Labelled documents of each language that the regression is fitted on, about;
#: document frequencies come from all labelled documents.
SAMPLE_PER_LANG = 1500
UNDETERMINED = "und"

_FOLD = np.arange(0x250, dtype=np.uint32)
for _i in range(0x250):
    _c = chr(_i).lower()
    if len(_c) == 1 and ord(_c) < 0x250:
        _FOLD[_i] = ord(_c)
_ALPHA_TO = 0x3400
_ALPHA = np.array([chr(i).isalpha() for i in range(_ALPHA_TO)])


def code_points(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of texts and their bounds by text."""
    cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return np.where(cp < 0x250, _FOLD[np.minimum(cp, 0x24F)], cp), lead[offs]


def has_letter(cp: np.ndarray, offs: np.ndarray) -> np.ndarray:
    alpha = _ALPHA[np.minimum(cp, _ALPHA_TO - 1)] & (cp < _ALPHA_TO)
    for c in np.unique(cp[cp >= _ALPHA_TO]).tolist():
        if chr(c).isalpha():
            alpha |= cp == c
    return tv.sum_by(alpha.astype(np.int64), offs) > 0


def ngram_buckets(cp: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at every position."""
    out, run = [], np.zeros(len(cp), np.uint64)
    wide = cp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in ORDERS:
        shifted = np.zeros(len(cp), np.uint64)
        shifted[: len(cp) - n + 1] = wide[n - 1 :]
        run = (run * np.uint64(0xD6E8FEB86659FD93)) ^ (shifted + (shifted >> np.uint64(29)))
        mixed = run * np.uint64(0xC2B2AE3D27D4EB4F)
        out.append(((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(7)).astype(np.int64) & (BUCKETS - 1))
    return out


def sparse_rows(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(row, buckets, counts, has a letter) of every text, whole."""
    for first, end, buf, offs in tv.slices(col):
        cp, at = code_points(buf, offs)
        letters, grams = has_letter(cp, at), ngram_buckets(cp)
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if not letters[i]:
                yield first + i, np.zeros(0, np.int64), np.zeros(0), False
                continue
            parts = [g[a : b - n + 1] for n, g in zip(ORDERS, grams) if b - a >= n]
            counts = np.bincount(np.concatenate(parts), minlength=BUCKETS)
            which = np.flatnonzero(counts)
            yield first + i, which, counts[which], True


def tf_idf(which: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[which]
    return x / max(np.linalg.norm(x), 1e-12)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS + 1, np.int64), 0
    for batch in batches:
        for _, which, _, ok in sparse_rows(batch.column(0)):
            if ok:
                df[which] += 1
                n += 1
    df[BUCKETS] = n
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], ["bucket", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, rows = batch.column(1), [(r, w, c) for r, w, c, ok in sparse_rows(batch.column(0)) if ok]
        yield pa.RecordBatch.from_arrays([
            langs.take(pa.array([r for r, _, _ in rows], pa.int32())),
            pa.array([w.astype(np.uint16).tobytes() for _, w, _ in rows], pa.binary()),
            pa.array([c.astype(np.uint32).tobytes() for _, _, c in rows], pa.binary()),
        ], ["lang", "which", "counts"])


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS x langs, sparse by the L1 penalty
    temperature: float

    def predict(self, which: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        logits = tf_idf(which, counts, self.idf) @ self.weights[which] / self.temperature
        p = np.exp(logits - logits.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.002, seed: int = 3) -> np.ndarray:
    """FTRL-proximal: z gathers gradients less what the step sizes owe; weights are its soft threshold."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            which, x = rows[i]
            zi, ni = z[which], n[which]
            w = weights(zi, ni)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p[None, :]
            more = ni + g * g
            z[which] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[which] = more
    return weights(z, n)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden section on its logarithm."""
    def loss(t):
        x = logits / np.exp(t)
        x = x - x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), labels]).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = SAMPLE_PER_LANG) -> Model | None:
    """A model from the labelled rows (null languages are ignored); None without any.

    Frequencies cover all rows.  The regression sees about ``per_lang`` rows of
    each language, picked by a hash of the id; a fifth of those only calibrate.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("doc_id"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return None
    df = {r.bucket: r.n for r in rows.select("text").mapInArrow(bounded(_document_frequencies), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    total = df.pop(BUCKETS, 0)
    idf = np.full(BUCKETS, np.log(1 + total) + 1.0)
    for b, n in df.items():
        idf[b] = np.log((1 + total) / (1 + n)) + 1.0
    share = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, per_lang / n)))))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) / 1e6
    sample = rows.where(unit < share[F.col("lang")]).select("text", "lang").mapInArrow(bounded(_vectors), "lang string, which binary, counts binary").collect()
    sample.sort(key=lambda r: (r.which, r.counts, r.lang))  # the order of tasks must not matter
    if not sample:
        return None
    langs = sorted({r.lang for r in sample})
    labels = np.array([langs.index(r.lang) for r in sample])
    vectors = []
    for r in sample:
        which = np.frombuffer(r.which, np.uint16).astype(np.int64)
        vectors.append((which, tf_idf(which, np.frombuffer(r.counts, np.uint32), idf)))
    hold = np.arange(len(sample)) % 5 == 0
    if len(sample) < 20:
        hold[:] = False
    fit = np.flatnonzero(~hold)
    weights = fit_ftrl([vectors[i] for i in fit], labels[fit], len(langs))
    calibrate = np.flatnonzero(hold) if hold.any() else fit
    logits = np.stack([vectors[i][1] @ weights[vectors[i][0]] for i in calibrate])
    return Model(langs, idf, weights, fit_temperature(logits, labels[calibrate]))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, lang_pred, score; only the text is looked at.

    Defined cases: null texts and texts without a letter are ``und`` with score
    0, as are all if there is no model; ties go to the first language by code
    point; ids may be null or repeat; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = [m.predict(w, c) if ok and m else (UNDETERMINED, 0.0) for _, w, c, ok in sparse_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(bounded(run), f"doc_id {kind}, lang_pred string, score double")
