"""Removal of repeated byte strings by blockwise suffix sorting with cover-sample ranks.

Every string of LENGTH bytes that starts earlier somewhere (smaller doc_id, or the same document and an
earlier start) is covered, wherever it is found. Sorting all suffixes of a corpus would move it many times,
so the suffixes are dealt into buckets that are sorted alone: a window of LENGTH bytes belongs to its
anchor, the 32 bytes of it with the least hash (the leftmost of equal ones). Equal windows have equal
anchors at the same place, so residues for the difference cover are counted from the anchor, and a cover of
one residue in each period of 34 serves every shift.

1. Each task finds its documents' anchors (one in some 35 bytes) and deals their hashes, with a hash of the
   168 bytes around them, by bucket. An anchor whose surroundings stood earlier is covered with all of them.
2. Of the anchors left, those whose hash occurs with other surroundings send these, once for each of the two cover
   samples (66 bytes, the 32 of the anchor among them), dealt by the sample's hash: so a frequent anchor spreads over
   as many buckets as it has neighbourhoods. In a bucket, the ranks of the samples are computed once; then the suffixes
   are sorted one shift at a time, those whose sample is alone being left out, ties of the sample's rank being ordered
   by the 34 bytes that the sample leaves. Each first of equal windows stays, the others are covered.
3. Covers are united for each document and cut out of its bytes.

An anchor is chosen by 32 bits of a hash of its bytes and then by its place, so the choice does not depend on the
block that a text is read in. Before step 1 shuffles, a task leaves out of each group of equal surroundings all
anchors that it knows to be covered but the earliest (these go by document), so a group of copies or a passage that a
third of all documents share is a few records from each task.

Memory is bounded by a bucket of anchors and a block of text (a longer text is gone through in pieces), whatever the length of repeats. Surroundings
are compared by two 64-bit hashes in step 1 (of the anchor and of all 168 bytes), by their bytes in step 2. Null text is
empty. A document is known by its doc_id and 128 bits of hash of its text. Rows of one doc_id
with different texts are different documents of which none is earlier; so are rows without doc_id, which
come after all others. Rows with equal doc_id and text have the same result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary, blocks, materialize, mix, ragged
from ._scatter import buckets_for, gather, release, scatter

LENGTH = 100
ANCHOR = 32
SHIFTS = LENGTH - ANCHOR + 1  # places of an anchor in a window
AROUND = LENGTH + SHIFTS - 1  # the bytes that windows of an anchor can have
PERIOD = 34
SAMPLE = 66  # bytes of a cover sample: LENGTH - PERIOD
SIDE = LENGTH + PERIOD  # bytes around a cover sample that its windows can have; the sample stands at PERIOD
#: Bytes of spans that may be broadcast; beyond that, a shuffled join.
BROADCAST_BYTES = 16 << 20
#: Anchors of one document whose surroundings are held at once.
PLACES = 20_000
#: Bytes of a block: hashing needs some 60 bytes of memory for each.
BLOCK = 1 << 20
NO_ID = np.iinfo(np.int64).max

#: How a document is known: its doc_id, and two hashes of its text.
WHO = ("doc", "sub", "sub2")
_WHO = [("doc", "<i8"), ("sub", "<i8"), ("sub2", "<i8")]
_ANCHORS = np.dtype([("key", "<u8"), ("c", "<u8"), *_WHO, ("pos", "<i4"), ("known", "<u1")])
#: What a cover sample stands for: a side (0, 1) of the surroundings, and the shifts low .. high of the windows on it.
_AROUND = np.dtype([("key", "<u8"), *_WHO, ("pos", "<i4"), ("side", "<i1"), ("low", "<i1"), ("high", "<i1"), ("ctx", f"V{SIDE}")])
_COVERS = np.dtype([("key", "<u8"), *_WHO, ("start", "<i4"), ("end", "<i4")])

_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2**64, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def anchors(off: np.ndarray, data: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts side by side: place of each anchor, its text, its hash, the hash of its surroundings. starts: those of the windows that count; all without."""
    n = len(data)
    none = np.zeros(0, np.int64)
    starts = ragged(off[:-1], np.maximum(np.diff(off) - LENGTH + 1, 0)) if starts is None else starts
    if not len(starts):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1])
    bits = np.uint64(32)  # of the hash count, and as many are left for the place: a text has less than 2 GB
    order = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    # the least of every SHIFTS neighbours, from minima that run forwards and backwards in blocks
    size = -(-len(order) // SHIFTS) * SHIFTS
    padded = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(order)] = order
    grid = padded.reshape(-1, SHIFTS)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[starts], ahead[starts + SHIFTS - 1])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    text = np.searchsorted(off, at, side="right") - 1
    low, high = np.maximum(off[text], at - SHIFTS + 1), np.minimum(off[text + 1], at + LENGTH)
    clip = (at - low).astype(np.uint64) * np.uint64(1 << 20) + (high - at).astype(np.uint64)
    around = mix(mix((sums[high] - sums[low]) * down[low]) + clip)
    return at, text, h[at], around


def _changes(r: np.ndarray, fields: tuple[str, ...]) -> np.ndarray:
    """Whether a row differs from the one before in any of these fields."""
    out = np.ones(len(r), bool)
    if len(r):
        out[1:] = False
        for f in fields:
            out[1:] |= r[f][1:] != r[f][:-1]
    return out


def _earlier(new: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Rows sorted by group, document and place; new: whether a group begins. Whether an earlier row of the group is an earlier place."""
    n = len(r)
    if not n:
        return np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    # places of one document: any after its first different one
    run = np.maximum.accumulate(np.where(new | _changes(r, WHO), np.arange(n), 0))
    return (r["doc"] > r["doc"][first]) | (r["pos"] > r["pos"][run])


def _sorted_by(r: np.ndarray, *fields: str) -> np.ndarray:
    return r[np.lexsort(tuple(r[f] for f in reversed((*fields, *WHO, "pos"))))]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return own.select("doc_id", F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc"), "text", F.xxhash64("text").alias("sub"), F.xxhash64("text", F.lit(1)).alias("sub2"))


def _who(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column(f).to_numpy() for f in WHO]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in blocks(batches, "text", BLOCK):
        off, data = binary(b.column("text"))
        for base, part in _pieces(off, data):
            at, text, h, around = anchors(*part)
            out = np.zeros(len(at), _ANCHORS)
            out["key"], out["c"], out["pos"] = h, around, at + base - off[text]
            for f, x in zip(WHO, _who(b), strict=True):
                out[f] = x[text]
            yield out


def _pieces(off: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, tuple]]:
    """A block as it is; a text beyond BLOCK in pieces, each with what stands around its windows. What is found doesn't depend on the cuts."""
    if len(data) <= 2 * BLOCK or len(off) > 2:
        yield 0, (off, data)
        return
    for a in range(0, len(data) - LENGTH + 1, BLOCK):
        z = min(a + BLOCK, len(data) - LENGTH + 1)
        low, high = max(0, a - SHIFTS + 1), min(len(data), z + AROUND)
        yield low, (np.array([0, high - low]), data[low:high], np.arange(a - low, z - low))


def _thinned(r: np.ndarray) -> np.ndarray:
    """What a task sends: known says that an earlier place with the same surroundings is sent as well; such an anchor goes by its document."""
    r = _sorted_by(r, "c", "key")
    r = r[_changes(r, ("c", "key", *WHO, "pos"))]  # repeated rows send the same
    r["known"] = _earlier(_changes(r, ("c", "key")), r)
    known = r["known"] == 1
    r["key"][known] = mix(r["doc"][known].view(np.uint64) + r["sub"][known].view(np.uint64))
    r["c"][known] = 0
    return r


STEP1 = "doc long, sub long, sub2 long, pos int, asks boolean"


def _columns(r: np.ndarray, *more: pa.Array) -> list[pa.Array]:
    return [*(pa.array(r[f], pa.int64()) for f in WHO), *more]


def _classified(r: np.ndarray) -> pa.RecordBatch | None:
    """Anchors whose surroundings stood earlier, and those that must be compared by bytes (asks)."""
    known, r = r[r["known"] == 1], _sorted_by(r[r["known"] == 0], "key", "c")
    new_key = _changes(r, ("key",))
    new = _changes(r, ("key", "c"))
    dup, asks = _earlier(new, r), np.zeros(len(r), bool)
    if len(r):
        group, of_key = np.cumsum(new), np.cumsum(new_key) - 1
        first, last = np.flatnonzero(new_key), np.append(np.flatnonzero(new_key)[1:], len(r)) - 1
        asks = (group[first] != group[last])[of_key] & ~dup
    keep = dup | asks
    r, asks = np.concatenate([known, r[keep]]), np.concatenate([np.zeros(len(known), bool), asks[keep]])
    if not len(r):
        return None
    return pa.RecordBatch.from_arrays(_columns(r, pa.array(r["pos"], pa.int32()), pa.array(asks, pa.bool_())), [*WHO, "pos", "asks"])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        for *who, text, places in zip(*(x.tolist() for x in _who(b)), b.column("text"), b.column("places"), strict=True):
            raw = np.frombuffer(text.as_buffer() or b"", np.uint8)
            every = places.values.to_numpy().astype(np.int64)
            padded = np.concatenate([np.zeros(SHIFTS - 1, np.uint8), raw, np.zeros(LENGTH, np.uint8)])
            for a, side in product(range(0, len(every), PLACES), (0, 1)):
                pos = every[a : a + PLACES]
                begin = pos - (SHIFTS - 1) + side * PERIOD  # where the side begins in the text
                out = np.zeros(len(pos), _AROUND)
                ctx = padded[(begin + SHIFTS - 1)[:, None] + np.arange(SIDE)]
                h = np.full(len(pos), side, np.uint64)
                for k in range(PERIOD, PERIOD + SAMPLE):
                    h = h * np.uint64(_BASE) + ctx[:, k] + np.uint64(1)
                out["key"], out["pos"], out["side"] = mix(h), pos, side
                for f, x in zip(WHO, who, strict=True):
                    out[f] = x
                out["low"] = np.clip(-begin, side, PERIOD + 1)
                out["high"] = np.clip(len(raw) - LENGTH - begin, -1, PERIOD)
                out["ctx"] = np.ascontiguousarray(ctx).view(f"V{SIDE}").ravel()
                yield out[out["low"] <= out["high"]]


def _once(r: np.ndarray) -> np.ndarray:
    """Repeated rows of a document send the same."""
    r = _sorted_by(r, "side")
    return r[_changes(r, ("side", *WHO, "pos"))]


def _column(ctx: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    """Bytes of the surroundings as strings that sort by them."""
    own = np.ascontiguousarray(np.concatenate([ctx[:, a:z] for a, z in parts], axis=1))
    return own.view(f"S{own.shape[1]}").ravel()


def sort_shifts(r: np.ndarray) -> np.ndarray:
    """For each row (a cover sample with its surroundings) and shift: whether the window there stands earlier too."""
    ctx = np.ascontiguousarray(r["ctx"]).view(np.uint8).reshape(len(r), SIDE)
    own = np.empty(len(r), [*_WHO, ("pos", "<i4")])
    for f in own.dtype.names:
        own[f] = r[f]
    covered = np.zeros((len(r), PERIOD + 1), bool)
    _, text = np.unique(_column(ctx, [(PERIOD, PERIOD + SAMPLE)]), return_inverse=True)
    rank = text.astype(np.int64) * 2 + r["side"]
    ties = np.bincount(rank)[rank] > 1
    for x in range(PERIOD + 1):
        rows = np.flatnonzero(ties & (r["low"] <= x) & (x <= r["high"]))
        if len(rows) < 2:
            continue
        _, rest = np.unique(_column(ctx[rows], [(x, PERIOD), (PERIOD + SAMPLE, x + LENGTH)]), return_inverse=True)
        same = rank[rows] * (int(rest.max()) + 1) + rest
        order = np.lexsort((*(own[f][rows] for f in ("pos", *reversed(WHO))), same))
        rows, same = rows[order], same[order]
        covered[rows, x] = _earlier(np.diff(same, prepend=-1) != 0, own[rows])
    return covered


SPANS = "doc long, sub long, sub2 long, start int, end int"


def _sorted(r: np.ndarray) -> pa.RecordBatch | None:
    covered = sort_shifts(r)
    edge = np.diff(np.pad(covered.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    if not len(row):
        return None
    base = r["pos"][row].astype(np.int64) - (SHIFTS - 1) + r["side"][row].astype(np.int64) * PERIOD
    return pa.RecordBatch.from_arrays(_columns(r[row], pa.array(base + first, pa.int32()), pa.array(base + last - 1 + LENGTH, pa.int32())), [*WHO, "start", "end"])


def _covers(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        out = np.zeros(b.num_rows, _COVERS)
        for f in (*WHO, "start", "end"):
            out[f] = b.column(f).to_numpy()
        out["key"] = mix(out["doc"].view(np.uint64) + out["sub"].view(np.uint64))
        yield out


def _united(r: np.ndarray) -> pa.RecordBatch | None:
    r = r[np.lexsort((r["start"], *(r[f] for f in reversed(WHO))))]
    n = len(r)
    new = _changes(r, WHO)
    shift = np.cumsum(new).astype(np.int64) << np.int64(32)  # documents apart from each other on one line
    start, end = r["start"] + shift, np.maximum.accumulate(r["end"] + shift)
    begins = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(begins)
    low, high = r["start"][at], (end[np.append(at[1:], n) - 1] - shift[at]).astype(np.int32)
    docs = np.flatnonzero(new[at])
    bounds = np.append(docs, len(at)).astype(np.int32)
    first = at[docs]
    return pa.RecordBatch.from_arrays(_columns(r[first], pa.ListArray.from_arrays(bounds, pa.array(low, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(high, pa.int32()))), [*WHO, "starts", "ends"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (NO_ID for null), sub, sub2, starts, ends: the byte spans of each document that stand earlier too; an end may lie past the text."""
    spark, texts = docs.sparkSession, _texts(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets_for(spark, size // 34)
    first = materialize(gather(scatter(texts, _found, buckets, _thinned), _ANCHORS, buckets, _classified, STEP1), "anchors")
    release(spark)
    asks = materialize(first.where("asks").groupBy(*WHO).agg(F.collect_list("pos").alias("places")), "asked")  # a list is as long as its document
    asked = texts.join(asks, [*WHO]).select(*WHO, "text", "places")
    n = asks.agg(F.sum(F.size("places"))).first()[0] or 0
    of_bytes = buckets_for(spark, n * 12)
    second = materialize(gather(scatter(asked, _surroundings, of_bytes, _once), _AROUND, of_bytes, _sorted, SPANS), "sorted")
    release(spark)
    spans = first.where("not asks").select(*WHO, F.greatest(F.col("pos") - (SHIFTS - 1), F.lit(0)).alias("start"), (F.col("pos") + LENGTH).alias("end")).unionByName(second)
    covers = buckets_for(spark, size // 200)
    return materialize(gather(scatter(spans, _covers, covers), _COVERS, covers, _united, "doc long, sub long, sub2 long, starts array<int>, ends array<int>"), "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans, kept_sha256."""
    spans = repeated_spans(docs, id_col, text_col)
    release(docs.sparkSession)
    n = spans.agg(F.sum(F.size("starts") * 8 + 48)).first()[0] or 0
    texts = _texts(docs, id_col, text_col)
    rows = texts.join(F.broadcast(spans) if n <= BROADCAST_BYTES else spans, [*WHO], "left").select("doc_id", "text", "starts", "ends")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            kept, figures, sha = [], [], []
            for text, starts, ends in zip(b.column("text"), b.column("starts"), b.column("ends"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.as_buffer() is not None else b""
                left, at, gone = [], 0, 0
                for s, e in zip(starts.values.to_pylist(), ends.values.to_pylist(), strict=True) if starts.is_valid else ():
                    e = min(e, len(raw))
                    left.append(raw[at:s])
                    gone += e - s
                    at = e
                left.append(raw[at:])
                kept.append(b"".join(left))
                figures.append((len(raw), gone, len(left) - 1))
                sha.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kept, pa.binary()), *(pa.array([f[k] for f in figures], pa.int64()) for k in range(3)), pa.array(sha, pa.string())], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
