"""N-gram Jaccard join: exact similarity self-join of documents by word shingles, with its components.

Documents of the same shingle set are one record. Records are joined through inverted lists of their
prefixes: in one global order of shingles, two sets that are similar enough share a shingle among the
first |x| - ceil(t |x|) + 1 of each. The order is that of a hash, but shingles with long lists (LONGEST
of them at most, counted over all documents) come last, so a passage that thousands of documents share
stands in few prefixes. Each list gives links from a leader to its other members first, so a group of
near copies gives as many pairs as it has members; only members that are then still in different
components are paired with each other. Pairs are bounded by the overlap of their prefixes, and the rest
go to the T-occurrence search: a leader's shingles against the inverted lists of its partners, at most
PARTNERS at once; the short lists are merged into counts, the DivideSkip long ones are probed by binary
search, and partners that reach the overlap that the threshold asks for are links.

Words lower-case A-Z and stand between ASCII white space. Null, empty and wordless texts have no
shingles and no links. A text of fewer words than a shingle has its whole sequence as the only one.
Repeated rows and rows without doc_id: each keeps its row; a null id is reached by no link and stays null.
Rows that share a doc_id but not their text are documents of their own: a record has a key of its own and is found
again by doc_id and the 64-bit hash of its text, so each text keeps its links, and its row its component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, LOWER_BYTES, blocks, materialize, mix, ragged, without, words
from ._components import components
from ._scatter import buckets_for, gather, release, scatter
from ._tokens import hashes

WORDS = 4
PERCENT = 85
#: A list is long from so many members on; the longest LONGEST of them (2 MB of hashes) are sent to all tasks.
LONG = 24
LONGEST = 1 << 18
PARTNERS = 128
#: Leaders of one list that the first round tries for each member; what they don't link is paired in the second.
LEADERS = 8
LAST = np.uint64(1 << 63)

_KEYS = np.dtype([("key", "<u8")])
_POSTINGS = np.dtype([("key", "<u8"), ("id", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def shingles(col: pa.Array, size: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes (63 bits) of its shingles."""
    at, flat = words(col, LOWER_BYTES)
    coded = flat.dictionary_encode()
    h = hashes(coded.dictionary)[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(rolled)] + np.uint64(k))
    out = []
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if z - a >= size:
            own = rolled[a : z - size + 1]
        elif z > a:
            x = np.zeros(1, np.uint64)
            for k in range(a, z):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k] + np.uint64(17))
            own = x
        else:
            own = h[:0]
        out.append(np.unique(own >> np.uint64(1)))
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def needed(nx: np.ndarray, ny: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least intersection of sets of these sizes that makes a link: 100 i >= percent (nx + ny - i)."""
    return -(-percent * (nx + ny) // (100 + percent))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _digest(own: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None


def _longest(texts: DataFrame, records: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> np.ndarray:
    """Sorted, the keys that are most frequent among the records, LONGEST at most."""

    def counted(r: np.ndarray) -> pa.RecordBatch | None:
        key, n = np.unique(r["key"], return_counts=True)
        long = n >= LONG
        return pa.RecordBatch.from_arrays([pa.array(key[long].astype(np.int64), pa.int64()), pa.array(n[long], pa.int64())], ["h", "n"]) if long.any() else None

    spark = texts.sparkSession
    # a sixteenth of a split's bytes are records of prefixes, about
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    buckets = buckets_for(spark, texts.rdd.getNumPartitions() * split // 16)
    found = gather(scatter(texts, records, buckets), _KEYS, buckets, counted, "h long, n long")
    out = np.sort(np.array([r["h"] for r in found.orderBy(F.desc("n"), "h").limit(LONGEST).select("h").collect()], np.uint64))
    release(spark)
    return out


def _among(sought: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(sought):
        return np.zeros(len(sought), bool)
    return known[np.minimum(np.searchsorted(known, sought), len(known) - 1)] == sought


def long_lists(texts: DataFrame, percent: int, size: int) -> np.ndarray:
    """Sorted hashes of the shingles that come last: those with long lists over all documents' prefixes and half
    as much again, and those with long lists over all shingles of the documents that have one of the first kind."""

    def records(wanted: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]:
        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for b in blocks(batches):
                part = [wanted(s) for s in shingles(b.column("text"), size)]
                out = np.zeros(sum(map(len, part)), _KEYS)
                out["key"] = np.concatenate(part) if part else 0
                yield out

        return keys

    def head(s: np.ndarray) -> np.ndarray:
        return s[: prefix_length(len(s), percent) * 3 // 2]

    first = _longest(texts, records(head))
    if not len(first):
        return first
    return np.union1d(first, _longest(texts, records(lambda s: s if _among(head(s), first).any() else s[:0])))


def _ordered(own: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The shingles in the global order: their hashes, with the top bit set for those that come last."""
    late = _among(own, last)
    return np.concatenate([own[~late], own[late] | LAST])


def _bounded(pairs: DataFrame, records: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b that their prefixes still allow, with both sizes."""
    x = records.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"))
    y = records.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy().astype(np.int64), batch.column("nb").to_numpy().astype(np.int64)
            want, ok = needed(na, nb, percent), np.zeros(batch.num_rows, bool)
            for k, (p, q) in enumerate(zip(batch.column("pa"), batch.column("pb"), strict=True)):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                top = min(p[-1], q[-1])  # up to here both sets are known
                kp, kq = int(np.searchsorted(p, top, side="right")), int(np.searchsorted(q, top, side="right"))
                common = len(np.intersect1d(p[:kp], q[:kq], assume_unique=True))
                ok[k] = common + min(na[k] - kp, nb[k] - kq) >= want[k]
            if ok.any():
                yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(ok))

    return pairs.join(x, "a").join(y, "b").mapInArrow(kept, "a long, b long, na int, nb int")


def t_occurrence(query: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """DivideSkip: which sets share enough of the query's elements. Sorted arrays of distinct elements."""
    if not sets:
        return np.zeros(0, bool)
    sizes = np.array([len(s) for s in sets], np.int64)
    want = needed(np.full(len(sets), len(query)), sizes, percent)
    element = np.concatenate([np.searchsorted(query, s) for s in sets])
    every, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    hit = (element < len(query)) & (query[np.minimum(element, len(query) - 1)] == every)
    element, of = element[hit], of[hit]
    lengths = np.bincount(element, minlength=len(query))
    t = int(want.min())
    # so many of the longest lists are left out of the merge that t still asks for something from the short ones
    n_long = min(max(0, t - 1), int(t / (0.01 * np.log2(max(2, lengths.max())) + 1)))
    long = np.zeros(len(query), bool)
    long[np.argsort(-lengths, kind="stable")[:n_long]] = True
    count = np.bincount(of[~long[element]], minlength=len(sets))
    probe = np.flatnonzero(count >= want - n_long)
    rest = query[long]
    for k in probe:
        i = np.minimum(np.searchsorted(sets[k], rest), len(sets[k]) - 1)
        count[k] += int((sets[k][i] == rest).sum())
    out = np.zeros(len(sets), bool)
    out[probe] = count[probe] >= want[probe]
    return out


def _verified(pairs: DataFrame, records: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The links among pairs a, b of keys, by whole shingle sets."""
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    members = materialize(records.select("key", F.col("rep").alias("doc_id"), "th", "digest").join(keys, "key"), "members")
    n_members = members.count()
    own = texts.join(F.broadcast(members) if n_members <= BROADCAST_ROWS else members, ["doc_id", "th"]).select("key", "digest", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            own = shingles(b.column("text"), size)
            same = [_digest(s) == d for s, d in zip(own, b.column("digest").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([s.tobytes() for s in own], pa.binary())], ["id", "s"]).filter(pa.array(same, pa.bool_()))

    own = materialize(own.mapInArrow(sets, "id long, s binary"), "sets")
    if own.count() > n_members:  # repeated rows
        own = materialize(own.dropDuplicates(["id"]), "sets")
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("chunks"))
    partners = pairs.select("a", "b").join(chunks, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int"))
    partners = partners.join(own, partners["b"] == own["id"]).select("a", "chunk", "b", "s")
    leaders = chunks.join(own, chunks["a"] == own["id"]).select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("b"), "s")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, query, ids, found = None, None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if ids and query is not None:
                good = t_occurrence(query, found, percent)
                if good.any():
                    b = np.array(ids, np.int64)[good]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), now[0]), pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for a, chunk, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "b", "s")), strict=True):
                if (a, chunk) != now:
                    yield from done()
                    now, query, ids, found = (a, chunk), None, [], []
                s = np.frombuffer(s, np.uint64)
                if b is None:
                    query = s
                else:
                    ids.append(b)
                    found.append(s)
        yield from done()

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = leaders.unionByName(partners).repartition(n, "a", "chunk").sortWithinPartitions("a", "chunk", F.asc_nulls_first("b"))
    return materialize(both.mapInArrow(linked, "a long, b long"), "similar")


def _grouped(docs: DataFrame, percent: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: doc_id, th (hash of its text), n_shingles, and the doc_id and th of its component's least member,
    null for a document without shingles or id."""
    spark, texts = docs.sparkSession, _texts(docs, id_col, text_col)
    last = long_lists(texts, percent, size)
    release(spark)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            own = shingles(b.column("text"), size)
            prefixes = [_ordered(s, last)[: prefix_length(len(s), percent)] for s in own]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array([len(s) for s in own], pa.int32()), pa.array([_digest(s) for s in own], pa.binary()), pa.array([p.tobytes() for p in prefixes], pa.binary())], ["doc_id", "th", "n", "digest", "prefix"]
            )

    all_docs = materialize(texts.mapInArrow(sketched, "doc_id long, th long, n int, digest binary, prefix binary"), "sketches")
    classes = all_docs.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("least"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    classes = classes.select(F.monotonically_increasing_id().alias("key"), F.col("least.doc_id").alias("rep"), F.col("least.th").alias("th"), "digest", "n", "prefix")
    records = materialize(classes, "records")
    release(spark)
    total = records.agg(F.sum(F.length("prefix") / 8)).first()[0] or 0

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            prefixes = [np.frombuffer(p.as_buffer(), np.uint64) for p in b.column("prefix")]
            lens = np.array([len(p) for p in prefixes], np.int64)
            out = np.zeros(int(lens.sum()), _POSTINGS)
            out["key"] = np.concatenate(prefixes) if prefixes else 0
            out["pos"] = ragged(np.zeros(len(lens), np.int64), lens)
            out["id"], out["n"] = np.repeat(b.column("key").to_numpy(), lens), np.repeat(b.column("n").to_numpy(), lens)
            yield out

    def listed(records: np.ndarray) -> pa.RecordBatch | None:
        """Members of lists of two or more, each with a leader: the member with the least before this shingle that
        still allows a link, from the sizes and what stands before it in both (the first common shingle of a link does)."""
        records = records[np.lexsort((records["id"], records["n"], records["pos"], records["key"]))]
        key = records["key"]
        run = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(key) else np.zeros(0, np.int64)
        several = np.bincount(run)[run] > 1 if len(key) else np.zeros(0, bool)
        records = records[several]
        if not len(records):
            return None
        lead, now, leaders = records["id"].copy(), None, []
        for i, (k, x, n, p) in enumerate(zip(*(records[f].tolist() for f in ("key", "id", "n", "pos")), strict=True)):
            if k != now:
                now, leaders = k, []
            for y, m, q in leaders:
                want = -(-percent * (n + m) // (100 + percent))
                if min(n, m) >= want and n - p >= want and m - q >= want:
                    lead[i] = y
                    break
            else:
                if len(leaders) < LEADERS:
                    leaders.append((x, n, p))
        return pa.RecordBatch.from_arrays([pa.array(records["key"].view(np.int64), pa.int64()), pa.array(records["id"], pa.int64()), pa.array(records["n"], pa.int32()), pa.array(records["pos"], pa.int32()), pa.array(lead, pa.int64())], ["h", "id", "n", "pos", "lead"])

    buckets = buckets_for(spark, int(total))
    lists = materialize(gather(scatter(records.select("key", "n", "prefix"), postings, buckets), _POSTINGS, buckets, listed, "h long, id long, n int, pos int, lead long"), "lists")
    release(spark)

    # first each member with its leader, then members of a list that are in different components
    first = materialize(lists.where("lead <> id").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = _verified(materialize(_bounded(first, records, percent), "allowed"), records, texts, percent, size)
    comp = components(links)
    member = lists.join(comp, "id", "left").select("h", "id", "n", "pos", F.coalesce("component", "id").alias("c"))
    split = member.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("h")
    member = materialize(member.join(split, "h"), "split")
    x = member.select("h", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("ia"), F.col("c").alias("ca"))
    y = member.select("h", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("ib"), F.col("c").alias("cb"))
    want = F.expr(f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    allowed = (F.least("na", "nb") >= want) & (F.col("na") - F.col("ia") >= want) & (F.col("nb") - F.col("ib") >= want)
    across = x.join(y, "h").where((F.col("ca") < F.col("cb")) & allowed)
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tested = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = materialize(across.join(tested, ["a", "b"], "left_anti"), "pairs")
    if not second.isEmpty():
        more = _verified(materialize(_bounded(second, records, percent), "allowed"), records, texts, percent, size)
        if not more.isEmpty():
            links = links.unionByName(more)
            comp = components(links)
    release(spark)
    linked = records.select("key", "rep", "th", "digest").join(comp.withColumnRenamed("id", "key"), "key")
    heads = linked.groupBy("component").agg(F.min(F.struct("rep", "th")).alias("head"))
    heads = linked.join(heads, "component").select("key", F.col("head.rep").alias("head"), F.col("head.th").alias("head_th"))
    known = records.join(heads, "key", "left").select("digest", F.coalesce("head", "rep").alias("head"), F.coalesce("head_th", "th").alias("head_th"))
    known = materialize(known, "classes")
    rows = all_docs.select("doc_id", "th", F.col("n").cast("long").alias("n_shingles"), "digest").join(known, "digest", "left")
    with_id = F.col("doc_id").isNotNull()
    return rows.select("doc_id", "th", "n_shingles", F.when(with_id, F.col("head")).alias("head"), F.when(with_id, F.col("head_th")).alias("head_th"))


def similar_groups(docs: DataFrame, percent: int = PERCENT, size: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return _grouped(docs, percent, size, id_col, text_col).select("doc_id", "n_shingles", F.coalesce("head", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, with all its columns: that of the smallest doc_id, of one id's texts that of the least
    hash, of repeated rows any one. Rows without id or shingles stay."""
    th = "__hash_of_text"
    while th in docs.columns:
        th += "_"
    found = _grouped(docs, PERCENT, WORDS, id_col, text_col).where("head is not null")
    stays = (F.col("doc_id") == F.col("head")) & (F.col("th") == F.col("head_th"))
    found = materialize(found.groupBy("doc_id", "th").agg(F.first(stays).alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "near-copies")
    on = [(id_col, "doc_id"), (th, "th")]
    rows = without(docs.withColumn(th, F.xxhash64(F.col(text_col).cast("string"))), found.where("not stays"), on)
    twice = found.where("stays")
    if not twice.isEmpty():
        rows = without(rows, twice, on).unionByName(without(rows, twice, on, "left_semi").dropDuplicates([id_col, th]))
    return rows.drop(th)
