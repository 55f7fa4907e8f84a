"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier in numpy sees, for every word, cells hashed from the word and from its beginning. A cell's
value is its share of the document's words (texts under LEAST words count as LEAST), times the log of how much more
often confirmed toxic documents have the cell than the others are to have it by the prior; cells that they don't have
more often say nothing about toxicity and stay at zero. No cell is left out for being rare: the log of a rare one is
drawn to zero by EVIDENCE imagined documents. The weights are learnt from confirmed toxic documents and unlabelled
ones with the estimator
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),
stepping back on the second part where it falls below zero. The prior is the share of toxic rows among
the labelled rows that may be learnt from, and also says where the score's 0.7 lies: about so many of the unlabelled
documents are to reach it.

Bounds of what is learnt from: POSITIVES and UNLABELLED documents, those with the least hash of doc_id, each id once
(of several rows of an id the text with the least hash), whole texts. Every document is scored on its whole text.
Labels, lang, source and doc_id are no inputs of a score. Labels with a null doc_id or null mark are ignored; of
repeated labels the highest counts. Repeated rows get one score each, the same for the same text. Null, empty and
wordless texts get the score of the bias. Without positives every score is 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD_BYTES, binary, blocks, least_distinct, mix, ragged, strings, trim, words
from ._tokens import hashes

POSITIVES = 1500
UNLABELLED = 8000
BITS = 18
STEPS = 200
DECAY = 1e-4
RATE = 1.0
#: Imagined documents that have every cell as often as all documents.
EVIDENCE = 10
#: Words that a shorter text counts as.
LEAST = 20
#: The margin of score 0.7, and the shares of the prior between whose quantiles it is put.
AT_07 = float(np.log(0.7 / 0.3))
AROUND_PRIOR = (0.9, 1.1)
PREFIXES = (5,)


def remainder(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def cells_of(distinct: pa.Array) -> np.ndarray:
    """Cells of each word: of the whole and of its first bytes."""
    off, data = binary(distinct)
    lens = np.diff(off)
    out = [mix(hashes(distinct))]
    for n in PREFIXES:
        short = np.minimum(lens, n)
        heads = strings(np.concatenate([[0], np.cumsum(short)]), data[ragged(off[:-1], short)])
        out.append(mix(hashes(heads) + np.uint64(n)))
    return (np.stack(out, axis=1) >> np.uint64(64 - BITS)).astype(np.int32)


def _counted(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts side by side: for each one's distinct cells the text, the cell and the cell's share; how many cells each text has."""
    at, flat = words(col, WORD_BYTES)
    coded = flat.dictionary_encode()
    cells, ids = cells_of(coded.dictionary), coded.indices.to_numpy()
    n = len(col)
    text = np.repeat(np.arange(n, dtype=np.int64), np.diff(at) * cells.shape[1])
    key, many = np.unique((text << BITS) | cells[ids].ravel(), return_counts=True)
    text = key >> BITS
    return text, (key & ((1 << BITS) - 1)).astype(np.int32), (many / np.maximum(np.diff(at), LEAST)[text]).astype(np.float32), np.bincount(text, minlength=n)


def _featurized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches):
        _, cells, shares, many = _counted(b.column("text"))
        ends = np.concatenate([[0], np.cumsum(many)]).tolist()
        parts = [[x[a:z].tobytes() for a, z in zip(ends, ends[1:], strict=False)] for x in (cells, shares)]
        yield pa.RecordBatch.from_arrays([b.column("toxic"), *(pa.array(p, pa.binary()) for p in parts)], ["toxic", "cells", "shares"])


def _margins(col: pa.Array, weights: np.ndarray) -> np.ndarray:
    text, cells, shares, _ = _counted(col)
    return np.bincount(text, weights[cells] * shares, minlength=len(col))


def evidence(rows: np.ndarray, cells: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """For each cell the log of its share among positives over its share among the others; never below zero."""
    p, u = int(positive.sum()), int((~positive).sum())
    in_p, in_u = (np.bincount(cells[of[rows]], minlength=1 << BITS) for of in (positive, ~positive))
    others = np.maximum(in_u / u - prior * in_p / p, 0) / (1 - prior)
    all_ = (in_p + in_u) / (p + u)
    tiny = 1e-9
    return np.maximum(0, np.log((in_p + EVIDENCE * all_) / (p + EVIDENCE) + tiny) - np.log((others * u + EVIDENCE * all_) / (u + EVIDENCE) + tiny))


def nnpu(rows: np.ndarray, cells: np.ndarray, shares: np.ndarray, positive: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """rows, cells, shares: the non-zero features, by document; positive: of each document. Logistic loss, gradient descent with momentum."""
    n, p, u = len(positive), positive, ~positive
    ratio = evidence(rows, cells, positive, prior).astype(np.float32)
    kept = ratio[cells] > 0
    rows, cells, x = rows[kept], cells[kept], shares[kept]
    del kept, shares
    x *= ratio[cells]
    size = np.sqrt(max(float(np.dot(x, x)) / n, 1e-12))  # the mean document has length one
    x /= np.float32(size)
    per_cell = np.bincount(cells, minlength=1 << BITS)
    used = np.flatnonzero(per_cell)
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used))
    cells = place[cells]
    by_cell = np.argsort(cells, kind="stable").astype(np.int32)
    rows_of, x_of = rows[by_cell], x[by_cell]
    del by_cell
    first_of_cell = np.cumsum(per_cell[used]) - per_cell[used]
    full = np.flatnonzero(np.bincount(rows, minlength=n))
    first_of_row = np.searchsorted(rows, full)
    del rows
    trim()

    def margin(w: np.ndarray, b: float) -> np.ndarray:
        out = np.full(n, b)
        if len(full):
            out[full] += np.add.reduceat(w.astype(np.float32)[cells] * x, first_of_row, dtype=np.float64)
        return out

    w, b, speed, speed_b = np.zeros(len(used)), float(np.log(prior / (1 - prior))), np.zeros(len(used)), 0.0
    for _ in range(steps):
        g = margin(w, b)
        sig = 1 / (1 + np.exp(-g))
        as_negative = np.logaddexp(0, g)
        rest = as_negative[u].mean() - prior * as_negative[p].mean()
        d_rest = np.where(u, sig / max(1, u.sum()), -prior * sig / max(1, p.sum()))
        d = d_rest + np.where(p, prior * (sig - 1) / max(1, p.sum()), 0) if rest >= 0 else -d_rest
        if len(used):
            slope = np.add.reduceat(d.astype(np.float32)[rows_of] * x_of, first_of_cell, dtype=np.float64)
            speed = 0.9 * speed - rate * (slope + DECAY * w)
        speed_b = 0.9 * speed_b - rate * d.sum()
        w, b = w + speed, b + speed_b
    # the prior says how many of the unlabelled are toxic: as many, about, are to score 0.7 or more; the cut lies amid the gap there, if there is one
    cut = np.quantile(margin(w, b)[u], [max(0.0, 1 - s * prior) for s in AROUND_PRIOR]).mean()
    out = np.zeros(1 << BITS)
    out[used] = w * ratio[used] / size
    return out, float(b + AT_07 - cut)


def fit(docs: DataFrame, labels: DataFrame, mod: int = 3, hold: int = 1, label: str = "toxic") -> tuple[np.ndarray, float] | None:
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(F.col("doc_id"), mod) != hold))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0]
    if not prior:
        return None
    h = F.xxhash64("doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    toxic = known.where("toxic = 1").select("doc_id").orderBy(h, "doc_id").limit(POSITIVES).collect()
    some = least_distinct(texts.where(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), mod) != hold)).select("doc_id"), UNLABELLED)
    ids = [(r["doc_id"], 1) for r in toxic] + [(r["doc_id"], 0) for r in some]  # POSITIVES + UNLABELLED rows at most
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int").groupBy("doc_id").agg(F.collect_list("toxic").alias("as"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("as").alias("as"))
    rows = rows.select(F.explode("as").alias("toxic"), "text").mapInArrow(_featurized, "toxic int, cells binary, shares binary").collect()
    positive = np.array([r["toxic"] == 1 for r in rows], bool)
    if not positive.any() or positive.all():
        return None
    at = np.repeat(np.arange(len(positive), dtype=np.int32), [len(r["cells"]) // 4 for r in rows])
    found = [np.frombuffer(b"".join([r[c] for r in rows]), kind) for c, kind in (("cells", np.int32), ("shares", np.float32))]
    del rows
    trim()
    return nnpu(at, found.pop(0), found.pop(), positive, min(float(prior), 0.95))


def score(docs: DataFrame, labels: DataFrame, mod: int = 3, hold: int = 1) -> DataFrame:
    """doc_id, text's score (0 to 1, of toxicity); the model is trained first."""
    model = fit(docs, labels, mod, hold)
    weights, bias = (model[0].astype(np.float32), model[1]) if model else (None, 0.0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            s = np.zeros(b.num_rows)
            if weights is not None:
                s = 1 / (1 + np.exp(-(_margins(b.column("text"), weights) + bias)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scored, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns."""
    model = fit(docs, labels)
    if model is None:
        return docs
    weights, bias = model[0].astype(np.float32), model[1]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            stays = 1 / (1 + np.exp(-(_margins(b.column("text"), weights) + bias))) < threshold
            yield b.filter(pa.array(stays))

    return docs.mapInArrow(kept, docs.schema)
