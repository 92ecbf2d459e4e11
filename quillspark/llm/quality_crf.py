"""Operator 4, quality classifier: a linear-chain conditional random field over the lines of a document.

Each line has features of its own and those of the lines before and after it; the chain's two states are bad (0) and
good (1), with weights for the four transitions. In training each line of a labelled document has the document's label,
and the chain's exact log-likelihood is raised by full-batch Adam on the driver. The score of a document is the mean of
its lines' forward-backward marginals of state good, weighted by line length (in bytes, plus one).

Training takes a bounded sample: the first SAMPLE_DOCS labelled documents by the md5 of their id, without those of over
SAMPLE_LINES lines (both are parameters). Held-out documents (crc32 of the id as text, modulo 5, is 0) are never taken.
Scores come from the text alone.

Features are counted for whole record batches at once on the bytes of the text column, so a text is never cut short.

Defined results: null and empty texts are one empty line and get that line's score; rows that repeat are scored alike;
a null id is not held out and takes no label; without labels of both kinds every score is the share of good labels (1.0
without any); an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.shared import cut, free_name

SAMPLE_DOCS, SAMPLE_LINES = 4000, 400
ROUNDS, RATE, DECAY = 250, 0.08, 1e-3
THRESHOLD = 0.3

_CLASSES = ("upper", "lower", "digit", "space", "point", "mark", "high")
_TABLE = np.full(256, 5, np.uint8)
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), (32, 9, 13, 11, 12), b".,;:'\"?()-", (), range(128, 256))):
    _TABLE[list(_bytes)] = _k
OWN = 12
WIDTH = 3 * OWN + 3


def _per_line(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """OWN features of each line data[start:end]."""
    kinds = _TABLE[data]

    def between(hits: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(hits, out=total[1:])
        return (total[ends] - total[starts]).astype(np.float64)

    upper, lower, digit, space, point, mark = (between(kinds == k) for k in range(6))
    size = (ends - starts).astype(np.float64)
    some = np.maximum(size, 1)
    words = space + 1
    bang, bar = between(data == 33), between(data == 124)
    again = np.zeros(len(data), bool)
    if len(data) > 1:
        again[1:] = (data[1:] == data[:-1]) & (kinds[1:] == 5)
    return np.stack([
        np.log1p(size) / 6, upper / np.maximum(upper + lower, 1), digit / some, point / some * 5, mark / some * 3, np.minimum(mark / words, 4),
        np.minimum(between(again) / words, 3), bang / words, bar / words, np.minimum((size - space) / words, 20) / 10, np.minimum(words, 200) / 100, (size == 0) * 1.0,
    ], 1)


def _sameness(text: bytes, lines: int) -> np.ndarray:
    """Share of words that repeat an earlier word of their line, per line."""
    out = np.zeros(lines)
    for k, line in enumerate(text.split(b"\n")):
        words = line.split()
        if len(words) > 3:
            out[k] = 1 - len(set(words)) / len(words)
    return out


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, lines per document, weight of each line) of a column of texts."""
    texts = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    raw = [x.as_buffer().to_pybytes() for x in texts]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    cuts = np.flatnonzero(data == 10)
    starts, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(data)]])
    counts = np.array([t.count(b"\n") + 1 for t in raw], np.int64)
    own = _per_line(data, starts, ends)
    same = np.concatenate([_sameness(t, n) for t, n in zip(raw, counts)])
    own[:, 11] = np.where(own[:, 11] > 0, 1.0, -same * 2)  # an empty line has no words to repeat
    first = np.zeros(len(own), bool)
    first[np.cumsum(counts) - counts] = True
    last = np.roll(first, -1)
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[last] = 0, 0
    return np.concatenate([own, before, after, first[:, None], last[:, None], np.ones((len(own), 1))], 1), counts, ends - starts + 1.0


def _grid(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each line's place (step, document) in a time-major grid, documents by falling length; active documents per step."""
    order = np.argsort(-counts, kind="stable")
    starts = np.cumsum(counts) - counts
    active = [int(n) for n in np.searchsorted(-counts[order], -np.arange(int(counts.max())), side="left")]
    steps = np.concatenate([starts[order[:n]] + t for t, n in enumerate(active)])
    return steps, np.array(active)


def forward_backward(score: np.ndarray, trans: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginal of state 1 of each line, expected counts of the transitions, log of all partition functions).

    score: of state 1 over state 0 per line; trans: 2 x 2 log weights. All documents step together.
    """
    steps, active = _grid(counts)
    offsets = np.concatenate([[0], np.cumsum(active)])
    emit = np.stack([np.zeros(len(score)), score], 1)[steps]
    alpha, scale = np.empty_like(emit), np.empty(len(emit))
    w = np.exp(trans - trans.max())
    for t, n in enumerate(active):
        a, b = offsets[t], offsets[t + 1]
        top = emit[a:b].max(1)
        now = np.exp(emit[a:b] - top[:, None])
        if t:
            now = now * (alpha[offsets[t - 1] : offsets[t - 1] + n] @ w)
        total = now.sum(1)
        alpha[a:b], scale[a:b] = now / total[:, None], np.log(total) + top + (trans.max() if t else 0)
    beta, pairs = np.ones_like(emit), np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        n, a, p = active[t], offsets[t], offsets[t - 1]
        e = np.exp(emit[a : a + n] - emit[a : a + n].max(1, keepdims=True)) * beta[a : a + n]
        back = e @ w.T
        joint = alpha[p : p + n, :, None] * w[None] * e[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        beta[p : p + n] = back / back.sum(1, keepdims=True)
    both = alpha * beta
    marginal = np.empty(len(score))
    marginal[steps] = both[:, 1] / both.sum(1)
    return marginal, pairs, float(scale.sum())


def train(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> dict:
    """Weights by full-batch Adam on the log-likelihood; each document's lines all have its label."""
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9], mean[-1] = 1, 0
    x = (x - mean) / spread
    x[:, -1] = 1
    y = np.repeat(labels, counts).astype(np.float64)
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = (counts[labels == k] - 1).sum()
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    docs = len(counts)
    for k in range(1, rounds + 1):
        p, pairs, _ = forward_backward(x @ w, trans, counts)
        g = np.concatenate([x.T @ (y - p), (seen - pairs).ravel()]) / docs - DECAY * np.concatenate([w, trans.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = RATE * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
        w, trans = w + step[:-4], trans + step[-4:].reshape(2, 2)
    return {"mean": mean, "spread": spread, "w": w, "trans": trans}


def score(model: dict, column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.empty(0)
    if "share" in model:
        return np.full(len(column), model["share"])
    x, counts, weight = features(column)
    x = (x - model["mean"]) / model["spread"]
    x[:, -1] = 1
    p, _, _ = forward_backward(x @ model["w"], model["trans"], counts)
    starts = np.cumsum(counts) - counts
    return np.clip(np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts), 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, counts, _ = features(batch.column(1))
            parts = np.split(x.astype("<f4"), np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes() for p in parts], pa.binary())], ["quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES, rounds: int = ROUNDS) -> dict:
    """A model from labels (doc_id, quality) of documents that are not held out; only features of the bounded sample reach the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int")).filter(F.col("_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("_id")))
    chosen = known.groupBy("_id").agg(F.min("quality").alias("quality")).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(sample_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(chosen), "_id")  # sample_docs rows at most
    found = texts.filter(F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) < sample_lines).orderBy("_id").limit(sample_docs).select("quality", "text").mapInArrow(_featured, "quality int, x binary").toArrow()
    y = np.array(found.column("quality").to_pylist(), np.int64)
    if len(set(y.tolist())) < 2:
        return {"share": float(y.mean()) if len(y) else 1.0}
    parts = [np.frombuffer(b, "<f4").reshape(-1, WIDTH) for b in found.column("x").to_pylist()]
    return train(np.concatenate(parts).astype(np.float64), np.array([len(p) for p in parts]), y, rounds)


def _scored(model: dict, own: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score(model, part.column(0)), pa.float64())], [*batch.schema.names, own])

    return run


def score_quality(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), score_col: str = "score") -> DataFrame:
    """The columns of keep, and score_col."""
    text, own = free_name("_text", list(keep)), free_name("_score", list(keep))
    taken = docs.select(F.col("text").alias(text), *keep)
    out = taken.mapInArrow(_scored(model, own), T.StructType([*taken.schema.fields, T.StructField(own, T.DoubleType())]))
    return out.select(*keep, F.col(own).alias(score_col))


def keep_good(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold, with their columns, whatever their names; written, as whole rows pass through Python workers in small batches only then."""
    own = free_name("_quality", docs.columns)
    return cut(score_quality(docs, model, tuple(docs.columns), own).filter(F.col(own) >= threshold).drop(own), "quality-kept")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))

