"""Entities, listings and the rest derived from whole test tables, as SQL that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("orders", "customer", "nation", "lineitem", "events", "documents", "pages")

ENTITIES = """
SELECT o_orderkey AS entity_id, n_name || ' House' || CAST(c_custkey AS VARCHAR(20)) AS publisher,
       {add(DATE '1990-01-01', CAST((o_orderkey * 7919) % 21900 AS INT))} AS d,
       'p' || CAST(p1 AS VARCHAR(20)) || ' p' || CAST(p2 AS VARCHAR(20)) || ' ' || CAST(o_orderkey AS VARCHAR(20)) AS title,
       'Agent' || CAST(p1 AS VARCHAR(20)) AS person1,
       CASE WHEN p2 <> p1 THEN 'Agent' || CAST(p2 AS VARCHAR(20)) END AS person2
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN (SELECT l_orderkey, min(l_partkey) AS p1, max(l_partkey) AS p2 FROM lineitem GROUP BY l_orderkey) li ON l_orderkey = o_orderkey
"""

LISTINGS = """
SELECT entity_id AS listing_id, CASE entity_id % 8
 WHEN 0 THEN replace(publisher, ' ', '.') || '.' || {fmt(d, 'yy.MM.dd')} || '.' || replace(title, ' ', '.') || '.XXX.1080p'
 WHEN 1 THEN '[' || replace(publisher, ' ', '') || '] ' || person1 || ' - ' || title || ' (Grp)'
 WHEN 2 THEN '[' || replace(publisher, ' ', '') || '] ' || person1 || ' - ' || title || ' (' || {fmt({add(d, 2)}, 'yyyy-MM-dd')} || ') [1080p]'
 WHEN 3 THEN person1 || ' and ' || coalesce(person2, 'Nobody') || ' - ' || title || ' (' || {fmt(d, 'dd.MM.yyyy')} || ') 2160p x265'
 WHEN 4 THEN replace(publisher, ' ', '.') || '.' || {fmt({add(d, 30)}, 'yyyy-MM-dd')} || '.' || replace(title, ' ', '.') || '.720p.WEB-DL'
 WHEN 5 THEN '[' || replace(publisher, ' ', '') || '] ' || person1 || ' - ' || title || ' [' || {fmt(d, 'dd-MM-yy')} || '] [1080p]'
 WHEN 6 THEN '[' || replace(publisher, ' ', '') || '] Quite Unrelated Clip Name [' || {fmt(d, 'yy-MM-dd')} || '] [1080]'
 ELSE 'Some.Other.House0.' || {fmt(d, 'yyyy-MM-dd')} || '.' || replace(title, ' ', '.') END AS title
FROM ({entities}) e
"""

_FORMATS = {"yy.MM.dd": "%y.%m.%d", "yyyy-MM-dd": "%Y-%m-%d", "dd.MM.yyyy": "%d.%m.%Y", "dd-MM-yy": "%d-%m-%y", "yy-MM-dd": "%y-%m-%d"}


def dialect(sql: str, duck: bool) -> str:
    """Fills in entities, date additions and date formats."""
    import re

    sql = sql.replace("{entities}", ENTITIES)
    while m := re.search(r"\{add\(((?:[^{}])*), ((?:[^{},]|\([^{}]*\))+)\)\}", sql):
        sql = sql[: m.start()] + (f"CAST({m[1]} + {m[2]} AS DATE)" if duck else f"date_add({m[1]}, {m[2]})") + sql[m.end() :]
    while m := re.search(r"\{fmt\(([^{}]*), '([^'{}]*)'\)\}", sql):
        sql = sql[: m.start()] + (f"strftime({m[1]}, '{_FORMATS[m[2]]}')" if duck else f"date_format({m[1]}, '{m[2]}')") + sql[m.end() :]
    return sql


def _views(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The tables are named for this one statement, by its arguments."""
    import re

    names = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    frames = {f"t_{t}": spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}
    for t in names:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{t_{t}}}", sql)
    return spark.sql(sql, **frames)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _views(spark, sf_dir, dialect(ENTITIES, False))
    e = e.repartition("entity_id")  # the test tables are one file each
    return e.select("entity_id", "publisher", F.array(F.concat("publisher", F.lit(" XXX"))).alias("aliases"), F.col("d").alias("date"), "title", F.array_compact(F.array("person1", "person2")).alias("people"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, dialect(LISTINGS, False)).repartition("listing_id")


def with_duck(sql: str) -> str:
    """DuckDB SQL with the views e (entities) and l (listings) in front."""
    return f"WITH RECURSIVE e AS ({dialect(ENTITIES, True)}), l AS ({dialect(LISTINGS, True)}) {sql}"
