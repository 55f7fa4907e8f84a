"""Packing into windows of 1024 ids by non-negative least squares over a length histogram.

A document's ids are cut into whole windows and a tail shorter than a window. All combinations of two or
three tail lengths that fill a window exactly are enumerated; projected gradient descent finds
non-negative repeat counts whose combinations reproduce the histogram of the tails, they are rounded
down and lowered where they ask for more tails than there are. What is left is packed greedily: first
whole, largest lengths first, into windows that come out full; the rest end to end, cutting a tail at a
window's end. So only the last sequence is padded. The driver sees the histogram alone (a window's
number of cells) and plans in counts; which tail a plan means is a matter of ranks: tails of one length
are numbered by (task, place in the task), so no length, however frequent, gathers in one task.

Null text counts as empty: its end id is its only id. Repeated rows are packed each time. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import blocks, materialize
from ._tokens import encoder, tokenizer_path

SIZE = 1024
END_ID = 0
STEPS = 300
#: Parts of a greedy window at most.
DEPTH = 8
TEXT_BYTES = 4 << 20
TAILS = "doc_id long, part int, n long, tail int, whole long, nth_tail long, nth_whole long, crcs array<long>, ids binary"


def cut(docs: DataFrame, path: str, byte_level: bool, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: its ids, whole windows and their checksums, its tail, and the numbers of both within the task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, wholes = TaskContext.get().partitionId(), np.zeros(size, np.int64), 0
        enc = encoder(path, byte_level)
        for b in blocks(batches, "text", TEXT_BYTES):
            at, ids = enc.encode(b.column("text"))
            ids = ids.astype("<u4")
            out: list[list] = [[] for _ in range(8)]
            for k in range(b.num_rows):
                own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")
                q, r = divmod(len(own), size)
                raw = own.tobytes()
                crc = [zlib.crc32(raw[4 * size * j : 4 * size * (j + 1)]) for j in range(q)]
                for column, x in zip(out, (part, len(own), r, q, int(seen[r]), wholes, crc, raw[4 * size * q :]), strict=True):
                    column.append(x)
                seen[r] += 1
                wholes += q
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], ["doc_id", "part", "n", "tail", "whole", "nth_tail", "nth_whole", "crcs", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, TAILS)


def combinations(lengths: np.ndarray, size: int) -> np.ndarray:
    """All sets of two or three of these lengths (0: none) that add up to the window; a row each, descending."""
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = size - a - b
    keep = (a >= b) & (c >= 0) & (c <= b)
    a, b, c = a[keep], b[keep], c[keep]
    keep = (c == 0) | there[c]
    return np.stack([a[keep], b[keep], c[keep]], axis=1)


def solve(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative counts x that least-squares fit sum(x * combination) to the histogram; accelerated projected gradient."""
    goal = histogram.astype(float)

    def forward(x: np.ndarray) -> np.ndarray:
        y = sum(np.bincount(combos[:, j], x, minlength=len(goal)) for j in range(3))
        y[0] = 0
        return y

    used = forward(np.ones(len(combos)))
    x = np.zeros(len(combos))
    rate = 1 / max(1.0, 3 * used.max())  # the Lipschitz constant is at most the largest row sum times the largest column sum
    y, t = x.copy(), 1.0
    for _ in range(steps):
        r = forward(y) - goal
        r[0] = 0
        new = np.maximum(0, y - rate * (r[combos[:, 0]] + r[combos[:, 1]] + r[combos[:, 2]]))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(histogram: np.ndarray, size: int = SIZE) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Patterns of tail lengths that fill a window with their counts, and what is left of the histogram."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    patterns: list[tuple[tuple[int, ...], int]] = []
    lengths = np.flatnonzero(left)
    combos = combinations(lengths, size) if len(lengths) else np.zeros((0, 3), np.int64)
    if len(combos):
        x = solve(combos, left)
        for i in np.argsort(-x, kind="stable"):
            count = int(np.floor(x[i] + 0.5))
            if not count:
                break
            parts = tuple(int(v) for v in combos[i] if v)
            fits = min(left[v] // parts.count(v) for v in parts)
            count = min(count, int(fits))
            if count > 0:
                patterns.append((parts, count))
                for v in parts:
                    left[v] -= count
    # greedily: the largest length, then the largest that still fit, if the window comes out full
    open_lengths = [int(v) for v in np.flatnonzero(left)]
    for largest in reversed(open_lengths):
        while left[largest] > 0:
            take, room, now = [], size, left.copy()
            v = largest
            while room and len(take) < DEPTH:
                fit = open_lengths[: bisect_right(open_lengths, min(v, room))]
                v = next((u for u in reversed(fit) if now[u] > 0), 0)
                if not v:
                    break
                take.append(v)
                now[v] -= 1
                room -= v
            if room:
                break
            count = int(min(left[v] // take.count(v) for v in take))
            patterns.append((tuple(take), count))
            for v in take:
                left[v] -= count
    return patterns, left


def pack(docs: DataFrame, path: str | None = None, byte_level: bool = True, end_id: int = END_ID, size: int = SIZE) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tails = materialize(cut(docs, path or tokenizer_path("byte_bpe_50k.json"), byte_level, end_id, size), "tails")
    counts = materialize(tails.groupBy("part", "tail").agg(F.count("*").alias("c"), F.sum("whole").alias("w")), "tail-counts")
    histogram = np.zeros(size + 1, np.int64)
    wholes = 0
    for r in counts.groupBy("tail").agg(F.sum("c").alias("c"), F.sum("w").alias("w")).collect():  # at most `size` rows
        histogram[r["tail"]] = r["c"]
        wholes += r["w"]
    patterns, left = plan(histogram, size)
    # intervals of ranks of each length: from, first sequence, sequence's step, offset
    spans: dict[int, list[tuple[int, int, int]]] = {}
    taken = np.zeros(size + 1, np.int64)
    first = int(wholes)
    for parts, count in patterns:
        at = 0
        for v in parts:
            spans.setdefault(v, []).append((int(taken[v]), first, at))
            taken[v] += count
            at += v
        first += count
    stream = np.cumsum(left * np.arange(size + 1)) - left * np.arange(size + 1)  # where the rest of each length begins, end to end
    ranks = {v: ([s[0] for s in x], x) for v, x in spans.items()}

    order = Window.partitionBy("tail").orderBy("part")
    before = counts.select("part", "tail", (F.sum("c").over(order) - F.col("c")).alias("tails_before"))
    of_parts = counts.groupBy("part").agg(F.sum("w").alias("w"))  # a row for each task that cut
    wholes_before = of_parts.select("part", (F.sum("w").over(Window.orderBy("part")) - F.col("w")).alias("wholes_before"))
    numbered = tails.join(before, ["part", "tail"]).join(wholes_before, "part")
    numbered = numbered.select("doc_id", "n", "tail", "crcs", "ids", (F.col("nth_tail") + F.col("tails_before")).alias("rank"), (F.col("nth_whole") + F.col("wholes_before")).alias("first_whole"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]

            def put(*values: object, out: list[list] = out) -> None:
                for column, x in zip(out, values, strict=True):
                    column.append(x)

            columns = [b.column(c).to_pylist() for c in ("doc_id", "n", "tail", "crcs", "rank", "first_whole")]
            raws = b.column("ids")
            for k, (doc, n, tail, crcs, rank, whole) in enumerate(zip(*columns, strict=True)):
                for j, crc in enumerate(crcs):
                    put(doc, j * size, size, crc, n, whole + j, 0)
                if not tail:
                    continue
                raw, start = raws[k].as_py(), n - tail
                if rank < taken[tail]:
                    froms, known = ranks[tail]
                    low, seq, at = known[bisect_right(froms, rank) - 1]
                    put(doc, start, tail, zlib.crc32(raw), n, seq + rank - low, at)
                    continue
                pos = int(stream[tail]) + (rank - int(taken[tail])) * tail
                done = 0
                while done < tail:
                    seq, at = divmod(pos + done, size)
                    length = min(tail - done, size - at)
                    put(doc, start + done, length, zlib.crc32(raw[4 * done : 4 * (done + length)]), n, first + seq, at)
                    done += length
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return numbered.mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
