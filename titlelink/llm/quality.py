"""Quality: random-indexing word vectors, pooled per document, into a two-layer numpy network.

Every word (a run of letters and digits, A-Z lower-cased) has a sparse random index vector of its own, derived from its
64-bit hash without a table. A word's vector is the mean of the index vectors of all words that stand within two words
of it anywhere in the corpus, centred on the corpus mean. Tasks sum the index vectors around each word over
a block of documents (BLOCK bytes of text, or one longer document) and shuffle these sums by word; a word's
total goes back to every block that has the word, where it meets the documents' word counts. So no table of
words is held anywhere, however many there are, and none is stored: the centre, which is known last, is taken off the
pooled means and squares instead of off each vector. A document is pooled into the mean and the spread of its
words' vectors, and ten shares of its own that no word vector holds (of the shapes of what stands between white space,
distinct ones, repeated neighbours, length); the README says what each part adds. A network with one hidden layer learns from at most
SAMPLE labelled rows, and a temperature, fitted on a fifth of them that it hasn't seen, calibrates its probabilities.

The texts are read twice; a block that isn't the same each time (rows that a source gives in another order)
ends the run with an error instead of mixing up words.

Words of one 64-bit hash count as one word. Word statistics cover all documents and whole texts. Labels, lang, source and doc_id are no inputs of a
score. Labels with null doc_id or mark are ignored; of repeated labels the highest counts. Repeated rows of an id are
learnt from once (the row with the least pooled numbers) and get a score each. Null, empty
and wordless texts are pooled as zeros and scored like any other. Without labels every score is 0.5,
with those of one kind only it is that kind. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SAME_BYTES, WORD_BYTES, binary, blocks, materialize, mix, small_batches, trim, words
from ._scatter import release
from ._tokens import hashes
from .toxicity import remainder

SAMPLE = 8000
DIM = 48
ONES = 8
#: Bytes of text whose words are summed before they are shuffled.
BLOCK = 32 << 20
#: Words (each counted once in a block) of a bucket, about, and bytes of a stored table for each.
BUCKET_WORDS = 150_000
BYTES_A_WORD = 32
#: Entries of a vector are exact for words of so many neighbours at most, and rounded to such a share for others.
FINE = 512
#: Words are told apart by how many neighbours they have when their sums are coded.
KINDS = np.array([4, 8, 12, 16, 24, 32, 48, 64, 128, 256, 512, 1024, 4096, 1 << 14, 1 << 17])
#: Words whose vectors are held at once in pooling and summing.
CHUNK = 100_000
#: What the network may see of a text's numbers.
WORD_VECTORS, SHARES, ALL = slice(0, 2 * DIM), slice(2 * DIM, None), slice(None)
N_SHARES = 10
HIDDEN = 32
EPOCHS = 60


def index_vectors(h: np.ndarray, seed: int = 11) -> np.ndarray:
    """Of words by their hashes: ONES entries of +1 or -1, one in each ONES-th of the dimensions."""
    wide = DIM // ONES
    out, x, rows = np.zeros((len(h), DIM), np.int8), mix(h + np.uint64(seed)), np.arange(len(h))
    for k in range(ONES):
        digit = (x % np.uint64(2 * wide)).astype(np.int64)
        x = x // np.uint64(2 * wide)
        out[rows, k * wide + digit // 2] = 1 - 2 * (digit % 2)
    return out


def shapes_of(distinct: pa.Array) -> np.ndarray:
    """Of each word: plain 0, shouting 1, several symbols 2, digits 3, symbols only 4, other 5."""
    off, data = binary(distinct)
    lens = np.diff(off)

    def many(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag)])
        return sums[off[1:]] - sums[off[:-1]]

    upper, lower = many((data >= 65) & (data <= 90)), many(((data >= 97) & (data <= 122)) | (data >= 128))
    digit = many((data >= 48) & (data <= 57))
    symbol = lens - upper - lower - digit
    return np.select([symbol == lens, (upper >= 2) & (lower == 0), symbol >= 2, digit > 0, lower + upper + symbol == lens], [4, 1, 2, 3, 0], 5)


def shares(col: pa.Array) -> np.ndarray:
    """N_SHARES numbers for each text, of what stands between white space: shares of each shape, of distinct ones, of those that repeat the one before, logs of both counts."""
    at, flat = words(col, SAME_BYTES)
    coded = flat.dictionary_encode()
    ids, shape_of = coded.indices.to_numpy().astype(np.int64), shapes_of(coded.dictionary)
    lens = np.diff(at)
    doc, n = np.repeat(np.arange(len(lens)), lens), np.maximum(lens, 1)
    distinct = _bags(at, ids, len(coded.dictionary))[0]
    again = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    shapes = np.bincount(doc * 6 + shape_of[ids], minlength=len(lens) * 6).reshape(len(lens), 6)
    repeated = np.bincount(doc[1:][again], minlength=len(lens))
    return np.column_stack([shapes / n[:, None], distinct / n, repeated / n, np.log1p(lens), np.log1p(distinct)])


def _sums(ids: np.ndarray, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its neighbours within two words, and the sum of their index vectors."""
    own, n, out = index_vectors(h), np.zeros(len(h), np.int64), np.zeros((len(h), DIM), np.int32)
    for lo in range(0, len(ids), CHUNK):
        a, z = max(0, lo - 2), min(len(ids), lo + CHUNK + 2)
        r, d = own[ids[a:z]], doc[a:z]
        s, m = np.zeros_like(r), np.zeros(len(r), np.int64)
        for gap in (1, 2):
            same = (d[gap:] == d[:-gap]).astype(np.int8)
            s[gap:] += r[:-gap] * same[:, None]
            s[:-gap] += r[gap:] * same[:, None]
            m[gap:] += same
            m[:-gap] += same
        inner = slice(lo - a, lo - a + min(CHUNK, len(ids) - lo))
        mine = ids[a:z][inner]
        order = np.argsort(mine)  # ties in any order: whole numbers add up to the same
        first = np.flatnonzero(np.diff(mine[order], prepend=-1))
        to = mine[order][first]
        out[to] += np.add.reduceat(s[inner][order], first, axis=0, dtype=np.int32)
        n[to] += np.add.reduceat(m[inner][order], first)
    return n, out


def _bags(at: np.ndarray, ids: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text: how many, which, and how often."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key, many = np.unique(doc * max(1, n_words) + ids, return_counts=True)
    return np.bincount(key // max(1, n_words), minlength=len(at) - 1), key % max(1, n_words), many


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """A number for each BLOCK of text, the same each time the rows are read, and its parts."""
    parts, k = blocks(batches), 0
    ahead = next(parts, None)

    def block() -> Iterator[pa.RecordBatch]:
        nonlocal ahead
        size = 0
        while ahead is not None and size < BLOCK:
            now = ahead
            size += now.column("text").nbytes
            yield now
            ahead = next(parts, None)

    while ahead is not None:
        yield (ahead.column("part")[0].as_py() << 32) + k, block()
        k += 1


def _coded(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of each text's words, the words' numbers, their hashes."""
    at, flat = words(part.column("text"), WORD_BYTES)
    coded = flat.dictionary_encode()
    return at, coded.indices.to_numpy().astype(np.int64), hashes(coded.dictionary)


def _ints(x: np.ndarray) -> bytes:
    """Whole numbers, sign last, lowest bytes of all first; bytes that are zero throughout are left out."""
    z = ((x.astype(np.int64) << 1) ^ (x.astype(np.int64) >> 63)).view(np.uint64)
    width = (int(z.max()).bit_length() + 7) // 8 if z.size else 0
    return bytes([width]) + b"".join((z >> np.uint64(8 * k)).astype(np.uint8).tobytes() for k in range(width))


def _ints_from(raw: bytes, at: int, count: int) -> tuple[np.ndarray, int]:
    z, width = np.zeros(count, np.uint64), raw[at]
    for k in range(width):
        z |= np.frombuffer(raw, np.uint8, count, at + 1 + k * count).astype(np.uint64) << np.uint64(8 * k)
    return (z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64), at + 1 + width * count


def _numbers(x: np.ndarray) -> bytes:
    """Whole numbers, sign last: of each the top 8 bits that the largest one needs by a Huffman tree, the bits below as they are."""
    z = ((x << 1) ^ (x >> 63)).view(np.uint64)
    low = max(0, int(z.max()).bit_length() - 8) if z.size else 0
    tree = zlib.compressobj(6, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    top = tree.compress((z >> np.uint64(low)).astype(np.uint8).tobytes()) + tree.flush()
    return bytes([low]) + b"".join(np.packbits((z >> np.uint64(k)).astype(np.uint8) & 1).tobytes() for k in range(low)) + top


def _numbers_from(raw: bytes, count: int) -> np.ndarray:
    low, size = raw[0], -(-count // 8)
    z = np.frombuffer(zlib.decompress(raw[1 + low * size :], -15), np.uint8).astype(np.uint64) << np.uint64(low)
    for k in range(low):
        z |= np.unpackbits(np.frombuffer(raw, np.uint8, size, 1 + k * size), count=count).astype(np.uint64) << np.uint64(k)
    return (z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64)


def _sealed(head: bytes, n: np.ndarray, s: np.ndarray) -> bytes:
    """A head (which says n) and sums. Sums of words with like counts are of like size and are coded by Huffman trees of their own."""
    parts, kind = [zstandard.ZstdCompressor(level=3).compress(head)], np.searchsorted(KINDS, n)
    for k in np.unique(kind):
        parts.append(_numbers(s[kind == k].ravel().astype(np.int64)))
    return np.array([len(parts), *map(len, parts)], np.uint32).tobytes() + b"".join(parts)


def _opened(payload: bytes) -> tuple[bytes, Callable[[np.ndarray], np.ndarray]]:
    """The head, and what gives the sums once n is known."""
    many = int(np.frombuffer(payload, np.uint32, 1)[0])
    ends = 4 + 4 * many + np.cumsum([0, *np.frombuffer(payload, np.uint32, many, 4).tolist()])
    parts = [payload[a:z] for a, z in zip(ends, ends[1:], strict=False)]

    def sums(n: np.ndarray) -> np.ndarray:
        out, kind = np.empty((len(n), DIM), np.int64), np.searchsorted(KINDS, n)
        for k, part in zip(np.unique(kind), parts[1:], strict=True):
            rows = np.flatnonzero(kind == k)
            out[rows] = _numbers_from(part, len(rows) * DIM).reshape(len(rows), DIM)
        return out

    return zstandard.ZstdDecompressor().decompress(parts[0]), sums


def _by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of a block's words by bucket and hash, and where each bucket ends."""
    to = (h % np.uint64(buckets)).astype(np.int64)
    return np.lexsort((h, to)), np.cumsum(np.bincount(to, minlength=buckets))


def _check(h: np.ndarray) -> bytes:
    """How many words, and their hashes in one."""
    return np.array([len(h), np.bitwise_xor.reduce(h) if len(h) else 0], np.uint64).tobytes()


ROWS = "block long, bucket int, payload binary"


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    blocks_, buckets, payloads = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(blocks_, pa.int64()), pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary())], ["block", "bucket", "payload"])


def _asked(texts: DataFrame, buckets: int) -> DataFrame:
    """For each block and bucket the block's words: hashes, neighbours, sums of index vectors."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in _grouped(batches):
            h, slot, used = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0  # sorted hashes, and where each one's sums are
            n, s = np.zeros(1 << 12, np.int64), np.zeros((1 << 12, DIM), np.int32)
            for part in parts:
                at, ids, own = _coded(part)
                m, t = _sums(ids, np.repeat(np.arange(part.num_rows), np.diff(at)), own)
                i = np.searchsorted(h, own)
                new = (h[np.minimum(i, len(h) - 1)] != own) if len(h) else np.ones(len(own), bool)
                fresh = np.unique(own[new])
                i = np.searchsorted(h, fresh)
                h, slot = np.insert(h, i, fresh), np.insert(slot, i, np.arange(used, used + len(fresh)))
                used += len(fresh)
                if used > len(n):
                    n, s = (np.concatenate([x[: used - len(fresh)], np.zeros((used + used // 2, *x.shape[1:]), x.dtype)]) for x in (n, s))
                to = slot[np.searchsorted(h, own)]
                n[to] += m
                s[to] += t
            n, s = n[slot], s[slot]
            order, ends = _by_bucket(h, buckets)
            out, a = [], 0
            for b, z in enumerate(ends.tolist()):
                if z > a:
                    own = order[a:z]
                    gaps = np.diff((h[own] // np.uint64(buckets)).astype(np.int64), prepend=0)  # ascending; the bucket says the rest of each hash
                    out.append((block, b, _sealed(_check(h[own]) + _ints(gaps) + _ints(n[own]), n[own], s[own])))
                a = z
            yield _rows(out)
            del h, n, s
            trim()

    return texts.mapInArrow(asked, ROWS)


def _answered(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """For each block of a bucket its words' totals over all blocks, from FINE neighbours on as FINE-ths of them; and under block -1 the sum of all the bucket's words."""

    def done(bucket: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = []
        for _, payload in held:
            raw, sums = _opened(payload)
            count = int(np.frombuffer(raw, np.int64, 1)[0])
            gaps, at = _ints_from(raw, 16, count)
            n, at = _ints_from(raw, at, count)
            parts.append((np.cumsum(gaps).astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket), n, sums(n)))
        h, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n, s, a = np.zeros(len(h), np.int64), np.zeros((len(h), DIM), np.int64), 0
        for own, m, t in parts:
            to = place[a : a + len(own)]
            n[to] += m
            s[to] += t
            a += len(own)
        yield _rows([(-1, bucket, np.append(s.sum(axis=0), n.sum()).astype(np.float64).tobytes())])
        many = np.flatnonzero(n > FINE)
        s[many] = np.rint(s[many] * (FINE / n[many, None]))
        a, out = 0, []
        for (block, _), (own, _, _) in zip(held, parts, strict=True):
            to = place[a : a + len(own)]
            out.append((block, bucket, _sealed(_check(own) + _ints(n[to]), n[to], s[to])))
            a += len(own)
        yield _rows(out)

    now, held = None, []
    for b in batches:
        for block, bucket, payload in zip(*(b.column(c).to_pylist() for c in ("block", "bucket", "payload")), strict=True):
            if bucket != now and held:
                yield from done(now, held)
                held = []
                trim()
            now = bucket
            held.append((block, payload))
    if held:
        yield from done(now, held)


def _counted(texts: DataFrame, buckets: int) -> DataFrame:
    """For each block (in bucket -1) its documents' word counts; words are numbered in the order of the answers."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for block, parts in _grouped(batches):
            held, doc_ids, extra = [], [], []
            for part in parts:
                at, ids, own = _coded(part)
                held.append((own, np.diff(at), *_bags(at, ids, len(own))))
                extra.append(shares(part.column("text")))
                doc_ids += part.column("doc_id").to_pylist()
            h = np.unique(np.concatenate([x[0] for x in held]))
            order, ends = _by_bucket(h, buckets)
            rank = np.empty(len(h), np.int64)
            rank[order] = np.arange(len(h))
            number = np.concatenate([rank[np.searchsorted(h, own)][of] for own, _, _, of, _ in held])
            distinct, many = np.concatenate([x[2] for x in held]), np.concatenate([x[4] for x in held])
            lens = np.concatenate([x[1] for x in held])
            again = np.argsort(np.repeat(np.arange(len(distinct)), distinct) * max(1, len(h)) + number)
            checks = {b: _check(h[order[a:z]]) for b, (a, z) in enumerate(zip([0, *ends.tolist()], ends.tolist(), strict=False)) if z > a}
            bag = {"doc_ids": doc_ids, "checks": checks, "n": len(number), "docs": len(distinct), "shares": np.concatenate(extra).astype(np.float32)}
            bag |= {k: _ints(x) for k, x in (("distinct", distinct), ("lens", lens), ("number", np.diff(number[again], prepend=0)), ("many", many[again]))}
            yield _rows([(block, -1, pack(pickle.dumps(bag)))])
            del held, h
            trim()

    return texts.mapInArrow(counted, ROWS)


def pooled(distinct: np.ndarray, lens: np.ndarray, number: np.ndarray, many: np.ndarray, vectors: np.ndarray, known: np.ndarray) -> np.ndarray:
    """2 * DIM + 1 numbers for each text: mean and variance of its words' vectors, and the share of words that have one (known)."""
    out, doc = np.zeros((len(lens), 2 * DIM + 1)), np.repeat(np.arange(len(lens)), distinct)
    for lo in range(0, len(number), CHUNK):
        d, v, c = doc[lo : lo + CHUNK], vectors[number[lo : lo + CHUNK]], many[lo : lo + CHUNK, None].astype(np.float32)
        first = np.flatnonzero(np.diff(d, prepend=-1))
        w = v * c
        out[d[first], :DIM] += np.add.reduceat(w, first, axis=0)
        out[d[first], DIM:-1] += np.add.reduceat(v * w, first, axis=0)
        out[d[first], -1] += np.add.reduceat(known[number[lo : lo + CHUNK]] * c[:, 0], first)
    out /= np.maximum(lens, 1)[:, None]
    out[:, DIM:-1] -= out[:, :DIM] ** 2
    return out


def _rounded(x: np.ndarray) -> np.ndarray:
    """float32 with 13 bits of mantissa; the zeros after them take no disk."""
    return ((x.astype(np.float32).view(np.uint32) + np.uint32(512)) & np.uint32(0xFFFFFC00)).view(np.float32)


def centred(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Mean and spread of the centred vectors, and the shares, from what a table of features() holds for each text."""
    mean, variance, known = x[:, :DIM], x[:, DIM : 2 * DIM], x[:, 2 * DIM : 2 * DIM + 1]
    spread = np.sqrt(np.maximum(variance + (1 - known) * centre * (known * centre - 2 * mean), 0))
    return np.concatenate([mean - known * centre, spread, x[:, 2 * DIM + 1 :]], axis=1)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's word counts meet the words' totals: a row for each text, and one (total) for each bucket."""
    unpack = zstandard.ZstdDecompressor().decompress
    now = bag = vectors = known = None
    filled = 0

    def out(totals: list, doc_ids: list, x: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(totals, pa.binary()), pa.array(doc_ids, pa.int64()), pa.array(x, pa.binary())], ["total", "doc_id", "x"])

    def done() -> Iterator[pa.RecordBatch]:
        if now is None:
            return
        if bag is None or bag["checks"]:
            raise RuntimeError(f"block {now}: words without a vector; the texts weren't the same when read again")
        distinct, lens = (_ints_from(bag[k], 0, bag["docs"])[0] for k in ("distinct", "lens"))
        number, many = np.cumsum(_ints_from(bag["number"], 0, bag["n"])[0]), _ints_from(bag["many"], 0, bag["n"])[0]
        x = _rounded(np.concatenate([pooled(distinct, lens, number, many, vectors, known), bag["shares"]], axis=1))
        yield out([None] * bag["docs"], bag["doc_ids"], [r.tobytes() for r in x])

    for b in batches:
        for block, bucket, payload in zip(b.column("block").to_pylist(), b.column("bucket").to_pylist(), b.column("payload"), strict=True):
            if block == -1:
                yield out([payload.as_py()], [None], [None])
                continue
            if block != now:
                yield from done()
                trim()
                now, bag, filled = block, None, 0
            if bucket == -1:
                bag = pickle.loads(unpack(payload.as_buffer()))
                size = sum(int(np.frombuffer(c, np.int64, 1)[0]) for c in bag["checks"].values())
                vectors, known = np.zeros((size, DIM), np.float32), np.zeros(size, np.float32)
                continue
            raw, sums = _opened(payload.as_py())
            if bag is None or bag["checks"].pop(bucket, None) != raw[:16]:
                raise RuntimeError(f"block {block}: other words than before; the texts weren't the same when read again")
            count = int(np.frombuffer(raw, np.int64, 1)[0])
            near, _ = _ints_from(raw, 16, count)
            vectors[filled : filled + count] = sums(near) / np.clip(near, 1, FINE)[:, None]
            known[filled : filled + count] = near > 0
            filled += count
    yield from done()


def features(texts: DataFrame) -> DataFrame:
    """doc_id, x (float32: mean and spread of the word vectors, shares) of each text. Words' sums go to buckets, and their totals back to the blocks."""
    spark = texts.sparkSession
    small_batches(spark)
    release(spark)
    texts = texts.withColumn("part", F.spark_partition_id())  # of the scan itself: a union numbers its tasks anew
    n, split = texts.rdd.getNumPartitions(), int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-n * split // (BYTES_A_WORD * BUCKET_WORDS)))
    answers = _asked(texts, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _answered(batches, buckets), ROWS)
    rows = answers.unionByName(_counted(texts, buckets)).repartition(max(least, n), "block").sortWithinPartitions("block", "bucket")
    pools = materialize(rows.mapInArrow(_joined, "total binary, doc_id long, x binary"), "pooled")
    del rows, answers
    release(spark)
    total = np.sum([np.zeros(DIM + 1), *(np.frombuffer(r["total"]) for r in pools.where("total is not null").select("total").collect())], axis=0)  # a row for each bucket
    centre = total[:DIM] / max(1.0, total[DIM])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.float32).reshape(b.num_rows, 2 * DIM + 1 + N_SHARES).astype(float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r.tobytes() for r in centred(x, centre).astype(np.float32)], pa.binary())], ["doc_id", "x"])

    return pools.where("total is null").select("doc_id", "x").mapInArrow(moved, "doc_id long, x binary")


class Network:
    """tanh layer, logistic output, temperature. Inputs are standardized by what it has learnt from."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        order = rng.permutation(len(y))
        held, learn = order[: len(y) // 5], order[len(y) // 5 :]
        z = self._in(x)
        d = x.shape[1]
        self.p = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for _ in range(EPOCHS):
            rng.shuffle(learn)
            for i in range(0, len(learn), 128):
                rows = learn[i : i + 128]
                h = np.tanh(z[rows] @ self.p[0] + self.p[1])
                err = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - y[rows]) / len(rows)
                back = np.outer(err, self.p[2]) * (1 - h * h)
                grads = [z[rows].T @ back + 1e-4 * self.p[0], back.sum(axis=0), h.T @ err + 1e-4 * self.p[2], np.array([err.sum()])]
                t += 1
                for k, g in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        if len(held):
            raw, want = self.raw(x[held]), y[held]
            temps = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
            self.temperature = float(min(temps, key=lambda s: np.mean(np.logaddexp(0, raw / s) - want * raw / s)))

    def _in(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._in(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x) / self.temperature))


def score(docs: DataFrame, labels: DataFrame, mod: int = 4, hold: int = 2, label: str = "quality", inputs: slice = ALL) -> DataFrame:
    """doc_id and the probability of label 1; word vectors and network are trained first."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(F.col("doc_id"), mod) != hold))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    known = docs.sparkSession.createDataFrame(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect(), "doc_id long, y int")
    pools = features(texts)
    rows = sorted(pools.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect())  # SAMPLE ids
    y = np.array([r["y"] for r in rows], float)
    network = Network(np.stack([np.frombuffer(r["x"], np.float32) for r in rows])[:, inputs].astype(float), y) if len(set(y.tolist())) == 2 else None
    constant = float(y.mean()) if len(y) else 0.5

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), np.float32).reshape(b.num_rows, 2 * DIM + N_SHARES)[:, inputs].astype(float)
            p = network.probability(x) if network else np.full(b.num_rows, constant)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    return pools.mapInArrow(scored, "doc_id long, score double")
