"""Search sessions: bounded views, status, and correlation of grabs and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings


def newest(sessions: DataFrame, by: list[str], order: list, keep: int = DEFAULTS.sessions) -> DataFrame:
    """The `keep` newest rows of each key; the bound is the feature."""
    return sessions.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= keep)


def capped_candidates(candidates: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """candidates: session_id, seq, confidence, matched. All matched ones stay, the best others fill up to the cap."""
    w = Window.partitionBy("session_id").orderBy(F.desc("matched"), F.desc("confidence"), "seq")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("matched") | (F.col("rank") <= settings.candidates))


def session_counts(candidates: DataFrame) -> DataFrame:
    """candidates: session_id, confidence, matched, rewritten (the title that was given out, if any)."""
    rewritten = F.count("rewritten").alias("rewritten")
    return candidates.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("dropped"), rewritten, F.max("confidence").alias("best"))


def status(counts: DataFrame) -> DataFrame:
    """error before rss before passthrough before matched or empty. counts: session_id, error, mode, matched."""
    return counts.withColumn("status", F.when(F.col("error").isNotNull(), "error").when(F.col("mode") == "rss", "rss").when(F.col("mode") == "passthrough", "passthrough").when(F.col("matched") > 0, "matched").otherwise("empty"))


def correlate_grabs(grabs: DataFrame, candidates: DataFrame) -> DataFrame:
    """grabs: grab_id, title, size; candidates: session_id, title, rewritten, guid, size. The newest session with a
    candidate of the title; its guid if unique, else unique by size, else null. Grabs without a session come with null."""
    c = candidates.select("session_id", "guid", F.col("size").alias("c_size"), F.explode(F.array_distinct(F.array_compact(F.array("title", "rewritten")))).alias("title")).where("title <> ''")
    hits = grabs.where("title <> ''").join(c, "title").select("grab_id", "session_id", "guid", (F.col("size") == F.col("c_size")).alias("same")).distinct()
    each = hits.groupBy("grab_id", "session_id").agg(F.collect_set("guid").alias("guids"), F.collect_set(F.when(F.col("same"), F.col("guid"))).alias("sized"))
    w = Window.partitionBy("grab_id").orderBy(F.desc("session_id"))
    top = each.withColumn("rank", F.row_number().over(w)).where("rank = 1")
    guid = F.when(F.size("guids") == 1, F.element_at("guids", 1)).when(F.size("sized") == 1, F.element_at("sized", 1))
    return grabs.select("grab_id").join(top.select("grab_id", "session_id", guid.alias("guid")), "grab_id", "left")


def correlate_imports(imports: DataFrame, grabs: DataFrame) -> DataFrame:
    """imports: import_id, download_id; grabs: grab_id, session_id, download_id. The first grab of the newest session."""
    w = Window.partitionBy("import_id").orderBy(F.desc_nulls_last("session_id"), "grab_id")
    hit = imports.where("download_id <> ''").join(grabs, "download_id").withColumn("rank", F.row_number().over(w)).where("rank = 1")
    return imports.select("import_id").join(hit.select("import_id", "grab_id", "session_id"), "import_id", "left")


def badges(candidates: DataFrame, grabs: DataFrame) -> DataFrame:
    """The last grab of each guid beside its candidate."""
    w = Window.partitionBy("guid").orderBy(F.desc("grab_id"))
    last = grabs.where("guid is not null").withColumn("rank", F.row_number().over(w)).where("rank = 1").select("guid", "grab_id")
    return candidates.join(last, "guid", "left")


def early_stop(fired: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """fired: search_id, variant, best. The variants that run: those before which no confidence reached the threshold."""
    before = F.max("best").over(Window.partitionBy("search_id").orderBy("variant").rowsBetween(Window.unboundedPreceding, -1))
    return fired.where("true").withColumn("before", before).where(F.coalesce("before", F.lit(0)) < settings.threshold).drop("before")


def variant_trace(planned: DataFrame, fired: DataFrame) -> DataFrame:
    """planned: search_id, place, text. fired: search_id, seq, text, results. One row per search and text: place, text, fired, results.
    First the fired ones in the order of their first firing, each with its last count, then those that were planned only."""
    own = fired.groupBy("search_id", "text").agg(F.min("seq").alias("at"), F.max_by("results", "seq").alias("results"), F.lit(True).alias("fired"))
    left = planned.join(own, ["search_id", "text"], "left_anti").groupBy("search_id", "text").agg(F.min("place").alias("at"))
    left = left.select("search_id", "text", "at", F.lit(None).cast(own.schema["results"].dataType).alias("results"), F.lit(False).alias("fired"))
    place = F.row_number().over(Window.partitionBy("search_id").orderBy(F.desc("fired"), "at", "text")) - 1
    return own.unionByName(left).select("search_id", place.alias("place"), "text", "fired", "results")


def gated(fired: DataFrame, budget_seconds: float = DEFAULTS.search_seconds) -> DataFrame:
    """fired: search_id, variant, granted, elapsed (seconds at which it would start). The variants before the first that gets
    no token or starts after the time budget; what they found is kept."""
    stop = ~F.coalesce("granted", F.lit(False)) | (F.coalesce("elapsed", F.lit(0.0)) > budget_seconds)
    first = F.max(stop.cast("int")).over(Window.partitionBy("search_id").orderBy("variant").rowsBetween(Window.unboundedPreceding, 0))
    return fired.withColumn("stopped", first).where("stopped = 0").drop("stopped")


def grab_records(correlated: DataFrame) -> DataFrame:
    """correlated: grab_id, session_id, guid, download_id. One record for each download of a session: the last grab and its
    guid, in the place of the first; grabs without a download id stay apart. Grabs without a session are no records."""
    own = F.when(F.coalesce("download_id", F.lit("")) != "", F.col("download_id"))
    c = correlated.where("session_id is not null").withColumns({"own": own, "apart": F.when(own.isNull(), F.col("grab_id"))})
    each = c.groupBy("session_id", "own", "apart").agg(F.min("grab_id").alias("place"), F.max_by(F.struct("grab_id", "guid"), "grab_id").alias("last"))
    return each.select("session_id", F.col("own").alias("download_id"), "place", "last.grab_id", "last.guid")


def orphans(correlated: DataFrame, keep: int = DEFAULTS.orphans) -> DataFrame:
    """The newest grabs without a session; the bound is the feature."""
    return correlated.where("session_id is null").orderBy(F.desc("grab_id")).limit(keep)


def stamped(records: DataFrame, imports: DataFrame) -> DataFrame:
    """records: what grab_records gives. imports: import_id, download_id, dry_run. Each record with its last import, null without one:
    an import belongs to the newest session that has its download, to the first record of it there."""
    w = Window.partitionBy("download_id").orderBy(F.desc("session_id"), "place")
    owner = records.where("download_id is not null").withColumn("rank", F.row_number().over(w)).where("rank = 1").select("session_id", "place", "download_id")
    last = imports.where("download_id <> ''").groupBy("download_id").agg(F.max_by(F.struct("import_id", "dry_run"), "import_id").alias("last"))
    own = owner.join(last, "download_id").select("session_id", "place", "last.import_id", "last.dry_run")
    return records.join(own, ["session_id", "place"], "left")


def unmatched(grabs: DataFrame, imports: DataFrame, keep: int = DEFAULTS.orphans) -> DataFrame:
    """What no session lists, newest first. grabs: at, grab_id, download_id, without a session. imports: at, import_id, download_id,
    dry_run, of which no session has the download. Each grab is an entry; an import goes to the newest entry of its download so far
    and is an entry of its own if there is none or it has no download id. The bound is the feature; an import whose entry has
    left the ring goes with it. Rows: at, download_id, grab_id, and the last import's import_id and dry_run."""
    own = F.nullif(F.col("download_id"), F.lit(""))
    kind = imports.schema["import_id"].dataType
    rows = grabs.select("at", own.alias("download_id"), "grab_id", F.lit(None).cast(kind).alias("import_id"), F.lit(None).cast("boolean").alias("dry_run"))
    rows = rows.unionByName(imports.select("at", own.alias("download_id"), F.lit(None).cast(grabs.schema["grab_id"].dataType).alias("grab_id"), "import_id", "dry_run"))
    # rows without a download id stay apart, so none of them meet in one window
    apart = F.when(F.col("download_id").isNull(), F.struct("grab_id", "import_id"))
    w = Window.partitionBy("download_id", "apart").orderBy("at", F.col("grab_id").isNull(), "grab_id", "import_id")
    rows = rows.withColumn("apart", apart).withColumn("begins", F.col("grab_id").isNotNull() | (F.row_number().over(w) == 1))
    rows = rows.withColumn("entry", F.sum(F.col("begins").cast("int")).over(w))
    last = F.max_by(F.when(F.col("import_id").isNotNull(), F.struct("import_id", "dry_run")), F.when(F.col("import_id").isNotNull(), F.struct("at", "import_id")))
    each = rows.groupBy("download_id", "apart", "entry").agg(F.min("at").alias("at"), F.max("grab_id").alias("grab_id"), last.alias("last"))
    each = each.select("at", "download_id", "grab_id", "last.import_id", "last.dry_run")
    return each.orderBy(F.desc("at"), F.desc("grab_id"), F.desc("import_id"), F.desc("download_id")).limit(keep)


def pills(records: DataFrame) -> DataFrame:
    """records: session_id, dry_run (of its import; null: none yet). A session's counted labels, the strongest first."""
    imported = F.col("dry_run").isNotNull()
    kinds = {"Imported": imported & ~F.col("dry_run"), "Would import (dry-run)": imported & F.col("dry_run"), "Grabbed": ~imported}
    each = records.groupBy("session_id").agg(*(F.count_if(c).alias(name) for name, c in kinds.items()))
    labels = [F.when(F.col(f"`{name}`") > 1, F.concat(F.lit(f"{name} \u00d7"), F.col(f"`{name}`").cast("string"))).when(F.col(f"`{name}`") == 1, name) for name in kinds]
    return each.select("session_id", F.array_compact(F.array(*labels)).alias("pills"))


def snapshot(sessions: DataFrame, children: dict[str, DataFrame], order: str = "session_id", keep: int = DEFAULTS.sessions) -> DataFrame:
    """The newest sessions as JSON, each with its children (name: a table with session_id and seq) in order of seq. Only
    what belongs to the kept sessions is gathered."""
    kept = sessions.orderBy(F.desc(order)).limit(keep)
    out = kept
    for name, rows in children.items():
        own = rows.join(F.broadcast(kept.select("session_id")), "session_id", "left_semi")  # `keep` rows
        items = F.struct("seq", *[c for c in rows.columns if c not in ("session_id", "seq")])
        out = out.join(own.groupBy("session_id").agg(F.array_sort(F.collect_list(items)).alias(name)), "session_id", "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    return out.select("session_id", F.to_json(F.struct(*out.columns)).alias("json"))


def document(kept: DataFrame, entries: DataFrame, state: DataFrame, order: str = "session_id") -> DataFrame:
    """One JSON document of what snapshot and unmatched keep and of health's row (each bounded): sessions and unmatched_grabs newest
    first, index_size and index_age."""
    heads = kept.agg(F.reverse(F.array_sort(F.collect_list(F.struct(order, "json")))).alias("s"))
    heads = heads.select(F.concat(F.lit("["), F.array_join(F.transform("s", lambda x: x["json"]), ","), F.lit("]")).alias("sessions"))
    lost = entries.agg(F.reverse(F.array_sort(F.collect_list(F.struct(*entries.columns)))).alias("g")).select(F.to_json("g").alias("lost"))
    index = state.select("index_size", "index_age")
    # each side is one row
    one = F.lit(1).alias("one")
    whole = heads.select("*", one).join(lost.select("*", one), "one").join(index.select("*", one), "one")
    return whole.select(F.format_string('{"sessions":%s,"unmatched_grabs":%s,"index_size":%s,"index_age":%s}', "sessions", "lost", F.col("index_size").cast("string"), F.coalesce(F.col("index_age").cast("string"), F.lit("null"))).alias("json"))


def health(entities: DataFrame, built_at: Column, now: Column) -> DataFrame:
    """Size and age in seconds of the catalog that is matched against, and its distinct publisher names."""
    from ..functions import text as T

    names = entities.select("entity_id", F.explode(F.concat(F.array("publisher"), "aliases")).alias("n")).select("entity_id", F.nullif(T.squash(F.col("n")), F.lit("")).alias("n"))
    return names.agg(F.countDistinct("entity_id").alias("index_size"), F.countDistinct("n").alias("names")).select("index_size", "names", (now - built_at).alias("index_age"))
