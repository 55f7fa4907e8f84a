"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

The labelled table is small: of the distinct hosts and paths on which a rule decides, at most SAMPLE of each
verdict, those with the least hash. The model sees 3- to 5-grams of the host and of the path, each hashed into 2**BITS
cells, and is trained in numpy on the driver. Scoring reads the url column alone
and shuffles nothing; the sample shuffles a few distinct hosts and paths.

A null url, one without "://" and an empty one have an empty host and path; the model judges them by its
bias. Without urls of both verdicts to learn from, the verdict of urls outside the rules is allow. Rules of equal
length that fit the same url: the later one in the list holds. Repeated urls and repeated rows each get their row, with
the same verdict, and are learnt from once. Other columns, the page's html among them, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import binary, least_distinct, mix, ragged

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SAMPLE = 4096
BITS = 14
EPOCHS = 60


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and cells of every n-gram; ^ and $ stand at the ends, and host and path have cells of their own salt."""
    rows, cells = [], []
    for salt, col in ((1, hosts), (2, paths)):
        off, data = binary(col)
        lens = np.diff(off) + 2
        at = np.concatenate([[0], np.cumsum(lens)])
        padded = np.full(at[-1], ord("$"), np.uint64)
        padded[at[:-1]] = ord("^")
        padded[ragged(at[:-1] + 1, lens - 2)] = data
        for n in (3, 4, 5):
            many = np.maximum(lens - n + 1, 0)
            start = ragged(at[:-1], many)
            h = np.full(len(start), n * 8 + salt, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + padded[start + k]
            rows.append(np.repeat(np.arange(len(lens)), many))
            cells.append((mix(h) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(cells)


def margins(hosts: pa.Array, paths: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    rows, cells = features(hosts, paths)
    n = len(hosts)
    count = np.maximum(np.bincount(rows, minlength=n), 1)
    return np.bincount(rows, weights[cells], minlength=n) / np.sqrt(count) + bias


def train(hosts: list[str], paths: list[str], blocked: np.ndarray) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent with Adagrad steps and a little decay."""
    rows, cells = features(pa.array(hosts, pa.string()), pa.array(paths, pa.string()))
    value = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(hosts)), 1))[rows]
    w, b, gw, gb = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-8), 1e-8
    each = np.where(blocked, 0.5 / max(1, blocked.sum()), 0.5 / max(1, (~blocked).sum()))
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-(np.bincount(rows, w[cells] * value, minlength=len(hosts)) + b)))
        d = (p - blocked) * each
        g = np.bincount(cells, d[rows] * value, minlength=len(w)) + 1e-5 * w
        gw += g * g
        gb += d.sum() ** 2
        w -= 0.3 * g / np.sqrt(gw)
        b -= 0.3 * d.sum() / np.sqrt(gb)
    return w, float(b)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of block, by the model)."""
    urls = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("u"))
    urls = urls.select("page_id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"))
    known: list = []
    for what in ("allow", "block"):
        known += [(r["host"], r["path"], what) for r in least_distinct(urls.where(F.col("said") == what).select("host", "path"), SAMPLE)]
    blocked = np.array([x == "block" for _, _, x in known], bool)
    fitted = train([h for h, _, _ in known], [p for _, p, _ in known], blocked) if blocked.any() and not blocked.all() else (np.zeros(1 << BITS), -1.0)
    weights, bias = fitted[0].astype(np.float32), fitted[1]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = margins(b.column("host"), b.column("path"), weights.astype(float), bias) if b.num_rows else np.zeros(0)
            said = [r or ("block" if x >= 0 else "allow") for r, x in zip(b.column("said").to_pylist(), m, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(said, pa.string()), pa.array(1 / (1 + np.exp(-m)), pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    kind = urls.schema["page_id"].dataType.simpleString()
    return urls.mapInArrow(scored, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
