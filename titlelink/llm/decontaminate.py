"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by documents: each block of documents (a few MB, or one longer document) is one
row with its terms, and for each term the list of the positions where it stands. Building it shuffles
nothing, so no frequent term or large source lands in one task, and it is stored as a Parquet table in
the shared folder. A search takes the windows of the benchmark, drops those with a term that the block
lacks, starts from the list of each window's rarest term there, adjusts it by the term's offset, and
intersects it with the next rarer lists in turn, by binary search, until every term has agreed: these are
the exact phrase matches. Proximity matches ask only that every term of the window stands within `slop`
words of an occurrence of its rarest term in the same document, in any order.

The benchmark is read in parts of at most PART_BYTES of text, each sent over the index and its result written before the
next is read, so its size bounds nothing; spans of the parts are united for each document. Equal windows are searched
once for all their items, and occurrences of the rarest terms are gone through STEP at a time, so a document or an item that
repeats one word takes no more memory than others.

Words: A-Z lower-cased, runs of ASCII digits, a-z and of non-ASCII characters. Null or wordless texts
have no words and no hits. A benchmark item of fewer than `size` words is one window, one without words
or without item_id none (the registered SQL asks for the latter; `drop_contaminated` heeds such items). Repeated items and rows are judged each for itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BLOCK_BYTES, WORD_BYTES, binaries, blocks, materialize, ragged, without, words

PART_BYTES = 8 << 20
#: Occurrences of rarest terms that are held at once.
STEP = 500_000
WINDOW = 10
SLOP = 10

INDEX = "doc_ids array<long>, ends array<long>, terms string, ptr binary, postings binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each block: its documents, where each one's words end, its terms, and each term's positions (int32, ascending)."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK_BYTES):
            at, flat = words(b.column("text"), WORD_BYTES)
            coded = flat.dictionary_encode()
            ids = coded.indices.to_numpy()
            postings = np.argsort(ids, kind="stable").astype(np.int32)
            ptr = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(coded.dictionary)))]).astype(np.int32)
            terms = pc.binary_join(pa.ListArray.from_arrays(np.array([0, len(coded.dictionary)], np.int32), coded.dictionary.cast(pa.string())), "\n")
            of_docs = np.array([0, b.num_rows], np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(of_docs, b.column("doc_id")), pa.ListArray.from_arrays(of_docs, pa.array(at[1:], pa.int64())), terms, binaries([ptr.tobytes()]), binaries([postings.tobytes()])], ["doc_ids", "ends", "terms", "ptr", "postings"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(indexed, INDEX)


class Windows:
    """The distinct windows of some items: their terms as numbers, grouped by length, with the items that have each."""

    def __init__(self, items: list[tuple[str, str]], size: int) -> None:
        at, flat = words(pa.array([t for _, t in items], pa.string()), WORD_BYTES)
        coded = flat.dictionary_encode()
        ids, self.terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.string())
        self.names = [x for x, _ in items]
        found: dict[int, tuple[list, list]] = {}
        for k in range(len(items)):
            own = ids[at[k] : at[k + 1]]
            n = min(size, len(own))
            if n:
                rows, of = found.setdefault(n, ([], []))
                rows.append(np.lib.stride_tricks.sliding_window_view(own, n))
                of.append(np.full(len(own) - n + 1, k))
        self.by_length = {}
        for n, (rows, of) in found.items():
            distinct, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            which, item = np.unique(np.stack([which.ravel(), np.concatenate(of)]), axis=1)
            self.by_length[n] = distinct, np.searchsorted(which, np.arange(len(distinct) + 1)), item


def _member(keys: np.ndarray, sought: np.ndarray) -> np.ndarray:
    i = np.searchsorted(keys, sought)
    return (i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] == sought) if len(keys) else np.zeros(len(sought), bool)


def _united(starts: np.ndarray, stops: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that overlap or touch within a document as one, ascending."""
    order = np.lexsort((stops, starts))
    starts, stops, docs = starts[order], np.maximum.accumulate(stops[order]) if len(order) else stops, docs[order]
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] > stops[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(new)
    return starts[at], stops[np.append(at[1:], len(starts))[: len(at)] - 1], docs[at]


def search_block(row: dict, windows: Windows, slop: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """The spans that phrase matches hit (start, stop, document); pairs (document, item) of phrase and of proximity matches."""
    ptr, postings = np.frombuffer(row["ptr"], np.int32).astype(np.int64), np.frombuffer(row["postings"], np.int32).astype(np.int64)
    ends = np.asarray(row["ends"], np.int64)
    total = int(ends[-1]) if len(ends) else 0
    firsts = np.concatenate([[0], ends])
    none = np.zeros(0, np.int64)
    spans, pairs, near = (none, none, none), [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
    here = pc.index_in(windows.terms, value_set=row["terms"])
    here = pc.fill_null(here, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    n_terms = len(ptr) - 1
    # one sorted list of (term, position) serves as every term's list
    keys = np.repeat(np.arange(n_terms), np.diff(ptr)) * total + postings

    def of_items(doc: np.ndarray, win: np.ndarray, at: np.ndarray, item: np.ndarray) -> np.ndarray:
        doc, win = np.unique(np.stack([doc, win]), axis=1)
        many = at[win + 1] - at[win]
        return np.unique(np.stack([np.repeat(doc, many), item[ragged(at[win], many)]]), axis=1)

    for n, (rows, at, item) in windows.by_length.items():
        terms = here[rows]
        there = np.flatnonzero((terms >= 0).all(axis=1))
        terms = terms[there]
        if not len(terms):
            continue
        df = ptr[terms + 1] - ptr[terms]
        order = np.argsort(df, axis=1, kind="stable")
        rare = terms[np.arange(len(terms)), order[:, 0]]
        upto = np.cumsum(ptr[rare + 1] - ptr[rare])
        for low_at in range(0, int(upto[-1]), STEP):
            k = np.arange(low_at, min(low_at + STEP, int(upto[-1])))
            of_window = np.searchsorted(upto, k, side="right")
            seat = postings[ptr[rare[of_window] + 1] - (upto[of_window] - k)]
            doc = np.searchsorted(ends, seat, side="right")
            low, high = firsts[doc], ends[doc]
            # phrases: lists adjusted by each term's offset, from the rarest on
            start = seat - order[of_window, 0]
            ok = (start >= low) & (start + n <= high)
            s, win, d = start[ok], of_window[ok], doc[ok]
            for j in range(1, n):
                if not len(s):
                    break
                off = order[win, j]
                same = _member(keys, terms[win, off] * total + s + off)
                s, win, d = s[same], win[same], d[same]
            if len(s):
                spans = _united(np.concatenate([spans[0], s]), np.concatenate([spans[1], s + n]), np.concatenate([spans[2], d]))
                pairs.append(of_items(d, there[win], at, item))
            # proximity: every term within slop words of the rarest one's seat
            win, d, lo, hi = of_window, doc, np.maximum(low, seat - slop), np.minimum(high - 1, seat + slop)
            for j in range(1, n):
                if not len(win):
                    break
                term = terms[win, order[win, j]]
                i = np.searchsorted(keys, term * total + lo)
                same = (i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] <= term * total + hi)
                win, d, lo, hi = win[same], d[same], lo[same], hi[same]
            if len(win):
                near.append(of_items(d, there[win], at, item))
    return spans, *(np.unique(np.concatenate(x, axis=1), axis=1) for x in (pairs, near))


def _lists(of: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    """Values of documents (ascending) as a list for each of n documents."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), values)


FOUND = "doc_id long, n_words long, starts array<long>, ends array<long>, item_ids array<string>, near_ids array<string>"


def search(index: DataFrame, items: list[tuple[str, str]], size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """For every document: its words, the word spans that windows hit (united), the items of phrase and of proximity matches."""
    windows = Windows(items, size)
    names = np.array(windows.names, dtype=object)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in ("ptr", "postings")} | {c: b.column(c)[k].values for c in ("doc_ids", "ends")}
                row["terms"] = pc.split_pattern(b.column("terms").slice(k, 1), "\n").flatten()
                ends = np.asarray(row["ends"], np.int64)
                first = np.concatenate([[0], ends])[:-1]
                (start, stop, of), pairs, near = search_block(row, windows, slop)
                named = []
                for doc, item in (pairs, near):
                    out: list = [[] for _ in ends]
                    for d, x in zip(doc.tolist(), item.tolist(), strict=True):
                        out[d].append(names[x])
                    named.append(pa.array([sorted(set(x)) for x in out], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays([row["doc_ids"].cast(pa.int64()), pa.array(ends - first, pa.int64()), *(_lists(of, pa.array(x - first[of], pa.int64()), len(ends)) for x in (start, stop)), *named], ["doc_id", "n_words", "starts", "ends", "item_ids", "near_ids"])

    return index.mapInArrow(found, FOUND)


def parts_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = PART_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in parts of bounded size."""
    part, size = [], 0
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    for r in items.toLocalIterator():
        if part and size + len(r["t"]) > most:
            yield part
            part, size = [], 0
        part.append((r["i"], r["t"]))
        size += len(r["t"])
    yield part


def _unite(starts: list, ends: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """A row of `search` for every document, over the whole benchmark."""
    index, parts = materialize(build_index(docs), "postings"), parts_of(benchmark)
    part, ahead = next(parts), next(parts, None)
    if ahead is None:
        return search(index, part, size, slop)
    # several parts: the blocks come in the same order each time, so a row is known by its block and place
    rows = None
    while part is not None:
        f = materialize(search(index, part, size, slop).withColumn("row", F.monotonically_increasing_id()), "part")
        rows = f if rows is None else rows.unionByName(f)
        part, ahead = ahead, next(parts, None)

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                spans = _unite(sum(r["starts"], []), sum(r["ends"], []))
                out.append({"doc_id": r["doc_id"], "n_words": r["n_words"], "starts": [s for s, _ in spans], "ends": [e for _, e in spans], "item_ids": sorted(set(sum(r["item_ids"], []))), "near_ids": sorted(set(sum(r["near_ids"], [])))})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("item_ids", pa.list_(pa.string())), ("near_ids", pa.list_(pa.string()))]))

    each = ("starts", "ends", "item_ids", "near_ids")
    return rows.groupBy("row", "doc_id", "n_words").agg(*(F.collect_list(c).alias(c) for c in each)).mapInArrow(united, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near."""
    hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.size("item_ids") > 0).alias("contaminated"), F.size("near_ids").cast("long").alias("n_near"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs without any hit, with all their columns; rows of one doc_id are judged together. Here items without item_id count too."""
    named = benchmark.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    bad = contamination(docs, named, size).where(F.size("item_ids") > 0).select("doc_id").distinct()
    return without(docs, materialize(bad, "contaminated"), [("doc_id", "doc_id")])
