"""Rules of the linkage engine on small tables in neutral names, and every SQL oracle at the smallest scale."""

import datetime as dt
import glob
import json
import os
import re

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from titlelink.functions import dates as D
from titlelink.functions import text as T
from titlelink.functions.ratio import lcs, token_set_ratio
from titlelink.operators import linkage, sessions, token_bucket
from titlelink.sources import feed

DATA = "/root/testdata/sf0.001"
ENTITY = (0, "North Light", ["North Light XXX"], dt.date(2026, 7, 14), "The Long Quiet Harbor", ["Ann O'Vale", "Bo Reed"])
SCHEMA = "entity_id long, publisher string, aliases array<string>, date date, title string, people array<string>"


def outcome(spark, title, entity=ENTITY, others=()):
    rows = [entity, *[(k + 1, name, [], dt.date(1999, 1, 1), "Zed Zulu", []) for k, name in enumerate(others)]]
    e = spark.createDataFrame(rows, SCHEMA)
    l = spark.createDataFrame([(7, title)], "listing_id long, title string")
    return linkage.score(spark.createDataFrame([(7, 0, False)], "listing_id long, entity_id long, by_date boolean"), l, e).first()


@pytest.mark.parametrize(
    ("title", "confidence", "veto"),
    [
        ("North.Light.26.07.14.The.Long.Quiet.Harbor.XXX.1080p", 100, None),
        ("[NorthLight] Ann O'Vale - The Long Quiet Harbor", 100, None),
        ("Ann OVale - Long Quiet Harbor The", 75, None),
        ("North.Light.26.07.14", 75, None),
        ("North Light and nothing", 35, None),
        ("North.Light.The.Long.Quiet.Harbor.2026-07-16", 75, None),
        ("North.Light.The.Long.Quiet.Harbor.2026-07-18", 0, "date-mismatch"),
        ("South.Bay.26.07.14.The.Long.Quiet.Harbor", 0, "site-mismatch"),
        ("[NorthLight] Mud Pizza Skimp Jazz Dump 26.07.14", 0, "foreign-title"),
        ("North.Light.The.Long.Quiet.Harbor.14-07-26", 75, None),
    ],
)
def test_scoring_rules(spark, title, confidence, veto):
    r = outcome(spark, title, others=("South Bay",))
    assert (r.confidence, r.veto) == (confidence, veto)


def test_numeric_sibling_is_told_apart(spark):
    entity = (0, "North Light", [], dt.date(2026, 7, 14), "Case File No 2658", [])
    assert outcome(spark, "North.Light.Case.File.No.2658", entity).confidence == 75
    assert outcome(spark, "North.Light.Case.File.No.8004", entity).confidence < 75


@pytest.mark.parametrize(("text", "primary", "secondary"), [("a 26-07-14 b", {"2026-07-14"}, {"2014-07-26"}), ("x.2026.02.30", set(), set()), ("05.06.2001", {"2001-06-05"}, {"2001-05-06"}), ("120260714", set(), set()), ("", set(), set())])
def test_dates(spark, text, primary, secondary):
    p, s = D.extract_dates(F.col("t"))
    r = spark.createDataFrame([(text,)], "t string").select(p.alias("p"), s.alias("s")).first()
    assert ({str(x) for x in r.p}, {str(x) for x in r.s}) == (primary, secondary)


def test_text_functions(spark):
    r = spark.createDataFrame([("[Big-Mat] O'Neil 2 (1080p) WEB-DL h.265", "a/b/")], "t string, p string").select(T.squash(F.col("t")).alias("s"), T.content_tokens(F.col("t")).alias("c"), T.quality_tokens(F.col("t")).alias("q"), T.basename(F.col("p")).alias("b"), T.ngrams(T.tokenize(F.lit(""))).alias("g"), T.suffix_alias(F.lit("Ma XXX")).alias("a"), T.suffix_alias(F.lit("Mate.xxx")).alias("a2")).first()
    assert r.s == "bigmatoneil21080pwebdlh265" and r.c == ["big", "mat", "o", "neil", "h"] and r.q == ["1080p", "WEB-DL", "x265"] and r.b == "a/b/" and r.g == [] and r.a is None and r.a2 == "Mate"


def test_sizes_are_rounded_as_c_rounds_them(spark):
    sizes = [1_125_000_000, 1_005_000_000, 1_015_000_000, 1_375_000_000, 2_675_000_000, 1_995_000_000, 999_999_999_999, 1_000_000_000, (1 << 63) - 1, *range(1_005_000_000, 1_700_000_000_000, 17_210_000_000)]
    rows = spark.createDataFrame([(s,) for s in sizes], "s long").select("s", T.size_text(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in rows} == {s: f"{s / 1e9:.2f} GB" for s in sizes}


def test_ratio_is_indel():
    assert lcs("abcde", "xaybzc") == 3 and lcs("", "a") == 0
    assert token_set_ratio(["a", "b"], ["a", "b", "c"]) == 100.0
    assert token_set_ratio([], ["a"]) == 0.0
    assert abs(token_set_ratio(["abcd"], ["abxd"]) - 75.0) < 1e-9


def test_blocking_loses_no_match(spark):
    e, l = entry_carriers(spark)
    found = {(r.listing_id, r.entity_id) for r in linkage.score(linkage.candidates(l, e), l, e).where("confidence >= 75").collect()}
    every = l.select("listing_id").crossJoin(e.select("entity_id")).withColumn("by_date", F.lit(False))  # brute force, small tables
    brute = {(r.listing_id, r.entity_id) for r in linkage.score(every, l, e).where("confidence >= 75").collect()}
    assert found == brute and found


@pytest.mark.parametrize("cap", [1000, 3, 1])
def test_pruned_pairs_lose_no_match(spark, cap):
    from dataclasses import replace

    from titlelink.config import DEFAULTS

    settings = replace(DEFAULTS, token_only_cap=cap)
    e, l = entry_carriers(spark, 400)
    crowd = [(10_000 + k, "Hot House", ["Hot House XXX"], dt.date(2001, 1, 1 + k % 27), f"Same Words {k % 3}", ["Ann Vale", "Ann Vale"] if k % 2 else ["Bo Reed"]) for k in range(60)]
    e = e.unionByName(spark.createDataFrame(crowd, SCHEMA))
    titles = [f"Hot.House.2001-01-{1 + k % 27:02d}.Same.Words.{k % 3}" if k % 2 else f"[HotHouse] Ann Vale and Bo Reed - Same Words {k % 3}" for k in range(30)]
    l = l.unionByName(spark.createDataFrame([(20_000 + k, t) for k, t in enumerate(titles)], "listing_id long, title string"))
    full = linkage.score(linkage.candidates(l, e, settings), l, e, settings).where("confidence > 65")
    pruned = linkage.score(linkage.strong_candidates(l, e, settings), l, e, settings).where("confidence > 65")
    rows = lambda df: sorted(map(str, df.select("listing_id", "entity_id", "by_date", "confidence", "strong", "veto").collect()))
    assert rows(full) == rows(pruned) and rows(full)


@pytest.mark.parametrize("cap", [1000, 4])
def test_cut_lists_keep_the_candidates(spark, cap):
    from dataclasses import replace

    from titlelink.config import DEFAULTS

    e, l = entry_carriers(spark, 300)
    e = e.withColumn("people", F.concat("people", F.array(F.lit("Agent5"))))  # a person whom every entity has
    dated = {(r.listing_id, r.entity_id) for r in linkage.date_pairs(l, e).collect()}
    by_listing = {}
    for r in linkage.token_pairs(l, e).collect():
        if (r.listing_id, r.entity_id) not in dated:
            by_listing.setdefault(r.listing_id, []).append(r.entity_id)
    want = dated | {(i, x) for i, own in by_listing.items() for x in sorted(own)[:cap]}
    got = linkage.candidates(l, e, replace(DEFAULTS, token_only_cap=cap)).collect()
    assert {(r.listing_id, r.entity_id) for r in got} == want and len(got) == len(want)
    assert {(r.listing_id, r.entity_id) for r in got if r.by_date} == dated


def entry_carriers(spark, most=150):
    from titlelink.plans.carriers import entities, listings

    return entities(spark, DATA).where(F.col("entity_id") < most), listings(spark, DATA).where(F.col("listing_id") < most)


@pytest.mark.parametrize("cap", [1000, 4])
def test_counts_of_candidates_without_the_date_pairs(spark, cap):
    from dataclasses import replace

    from titlelink.config import DEFAULTS

    e, l = entry_carriers(spark, 300)
    e = e.withColumns({"people": F.concat("people", F.array(F.lit("Agent5"))), "date": F.when(F.col("entity_id") % 9 > 0, F.col("date"))})
    rows = lambda df: sorted(map(tuple, df.collect()))
    dated = linkage.date_pairs(l, e).groupBy("listing_id").agg(F.count("*"), F.min("entity_id"), F.max("entity_id"), F.sum("entity_id"))
    assert rows(linkage.date_summary(l, e)) == rows(dated) and dated.count()
    settings = replace(DEFAULTS, token_only_cap=cap)
    every = linkage.candidates(l, e, settings).groupBy("listing_id").agg(F.count("*"), F.count_if("by_date"), F.sum("entity_id"))
    assert rows(linkage.candidate_summary(l, e, settings)) == rows(every)


def test_tokens_of_no_entity_are_sorted_out_before_the_join(spark):
    from titlelink.operators.token_filter import likely

    words = spark.range(3000).select(F.concat(F.lit("w"), "id").alias("t"))
    some = words.where(F.expr("substr(t, -1) = '3'"))
    left = likely(words.unionByName(words).withColumn("x", F.lit(1)), some)
    assert left.join(some, "t", "left_semi").count() == 600 and 600 <= left.count() < 1100
    assert likely(words, some.where("false")).count() == 0


def test_a_token_of_many_entities_is_several_rows(spark, monkeypatch):
    monkeypatch.setattr(linkage, "CHUNK", 3)
    e, l = entry_carriers(spark, 100)
    e = e.withColumn("people", F.concat("people", F.array(F.lit("Agent5"))))
    l = l.where("listing_id < 20").unionByName(spark.createDataFrame([(900, "Agent5 and nothing"), (901, "Agent5 Agent5")], "listing_id long, title string"))
    found = {(r.listing_id, r.n) for r in linkage.token_pairs(l, e).groupBy("listing_id").agg(F.count("*").alias("n")).where("listing_id > 800").collect()}
    assert found == {(900, e.count()), (901, e.count())}


def test_the_filter_lets_few_other_tokens_through(spark):
    from titlelink.operators.token_filter import likely

    words = spark.range(23_000).select("id", F.concat(F.lit("w"), "id").alias("t"))
    left = likely(words, words.where("id < 3000").select("t"))
    assert left.where("id < 3000").count() == 3000 and left.count() < 3300


FAR = 1 << 31


def far_entities(spark):
    """Ids on both sides of what one list can name, and below zero; days before 1970, far off and null; an entity that is listed twice."""
    ids = F.when(F.col("entity_id") < 60, F.col("entity_id") + FAR - 30).when(F.col("entity_id") < 90, -F.col("entity_id") - FAR).otherwise(F.col("entity_id"))
    e, l = entry_carriers(spark)
    odd = F.when(F.col("entity_id") % 5 == 0, None).when(F.col("entity_id") % 5 == 1, F.lit("0001-01-01").cast("date")).when(F.col("entity_id") % 5 == 2, F.lit("9999-12-31").cast("date")).otherwise(F.col("date"))
    e = e.withColumns({"entity_id": ids, "people": F.concat("people", F.array(F.lit("Agent5"))), "date": odd})
    return e.unionByName(e.where("entity_id < 20")), l.unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "Agent5 agent5 1965-01-02"), (903, "nobody")], "listing_id long, title string"))


@pytest.mark.parametrize("most", [linkage.MOST, 7])
def test_token_pairs_are_summed_without_being_built(spark, monkeypatch, most):
    monkeypatch.setattr(linkage, "MOST", most)
    plan = entry.queries()["join_token_overlap"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not [k for k in re.findall(r"keys=\[([^\]]*)\]", plan) if "listing_id" in k and "entity_id" in k]
    e, l = far_entities(spark)
    grams = {r.listing_id: set(r.g or ()) for r in l.select("listing_id", T.ngrams(T.tokenize(F.col("title"))).alias("g")).collect()}
    keys = {}
    for r in linkage._postings(e).collect():
        keys.setdefault(r.entity_id, set()).add(r.t)
    want = {(i, k) for i, g in grams.items() for k, own in keys.items() if g & own}
    pairs = [tuple(r) for r in linkage.token_pairs(l, e).collect()]
    assert set(pairs) == want and len(pairs) == len(want) and {(902, FAR - 30), (902, FAR), (902, -60 - FAR)} <= want
    of = {i: [k for j, k in want if j == i] for i, _ in want}
    assert {tuple(r) for r in linkage.token_summary(l, e).collect()} == {(i, len(own), min(own), max(own), sum(own)) for i, own in of.items()}


@pytest.mark.parametrize(("cap", "most"), [(1000, linkage.MOST), (1000, 7), (4, linkage.MOST), (4, 7)])
def test_candidates_by_token_keep_their_days_in_the_lists(spark, monkeypatch, cap, most):
    monkeypatch.setattr(linkage, "MOST", most)
    from dataclasses import replace

    from titlelink.config import DEFAULTS

    e, l = far_entities(spark)
    dated = {(r.listing_id, r.entity_id) for r in linkage.date_pairs(l, e).collect()}
    by_listing = {}
    for r in linkage.token_pairs(l, e).collect():
        if (r.listing_id, r.entity_id) not in dated:
            by_listing.setdefault(r.listing_id, []).append(r.entity_id)
    got = linkage.candidates(l, e, replace(DEFAULTS, token_only_cap=cap)).where("not by_date").collect()
    want = {(i, k) for i, own in by_listing.items() for k in sorted(own)[:cap]}
    assert {(r.listing_id, r.entity_id) for r in got} == want and len(got) == len(want) and dated


def test_equal_searches_are_answered_once_with_their_columns(spark):
    titles = ["Ann Vale one", "Vale Ann two", "Ann alone", "VALE ann three", "", None]
    l = spark.createDataFrame(list(enumerate(titles)), "listing_id long, title string")
    q = spark.createDataFrame([(1, "ann vale"), (2, "Vale Ann vale"), (3, "ann"), (4, "nobody"), (5, "--"), (6, None), (7, "ann nobody")], "query_id long, text string")
    found = {(r.query_id, r.listing_id, r.title) for r in feed.search(l, q, 2, ("title",)).collect()}
    assert found == {(k, i, titles[i]) for k in (1, 2) for i in (0, 1)} | {(3, 0, titles[0]), (3, 1, titles[1])}
    latest = feed.remote_search(l, q.where("query_id in (4, 6)"), 2, ("title",)).collect()
    assert {tuple(r) for r in latest} == {(6, 5, None), (6, 4, "")}


def test_packs_are_grouped_in_parts_of_a_fixed_size(spark, monkeypatch):
    from titlelink.operators import decisions

    monkeypatch.setattr(decisions, "TASK_ROWS", 10)
    rows = [(d, "matched" if f != d % 7 else "unmatched", f if f != d % 7 else None) for d in range(30) for f in range(4)]
    judged = spark.createDataFrame(rows, "download_id long, verdict string, target_id long")
    out = decisions.finish_packs(judged, spark.createDataFrame([(f, True, False) for f in range(4)], "movie_id long, monitored boolean, has_file boolean"))
    assert {r.download_id: (r.files, r.matched, r.action) for r in out.collect()} == {d: (4, 3, "skip") if d % 7 < 4 else (4, 4, "plan") for d in range(30)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert decisions.finish_packs(judged, spark.createDataFrame([(1, True, False)], "movie_id long, monitored boolean, has_file boolean")).rdd.getNumPartitions() == 12
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_token_bucket_matches_a_plain_fold(spark):
    rows = [Row(key=k, seq=i, t=float(i * i % 37)) for k in (1, 2) for i in range(40)]
    got = {(r.key, r.seq): r.granted for r in token_bucket.grant(spark.createDataFrame(rows), 4.0, 15.0).collect()}
    want = {}
    for k in (1, 2):
        tokens, updated = 4.0, None
        for r in sorted((r for r in rows if r.key == k), key=lambda r: (r.t, r.seq)):
            tokens, updated, want[k, r.seq] = token_bucket.step(tokens, r.t if updated is None else updated, r.t, 4.0, 15.0)
    assert got == want


def test_feed_attributes(spark):
    item = '<item><title>A &amp; B</title><guid>g</guid><size>12</size><torznab:attr name="category" value="6000"/><torznab:attr name="category" value="x"/><torznab:attr name="seeders" value="3"/><torznab:attr name="n" value="1"/><torznab:attr name="n" value="2"/></item>'
    r = feed.parse_text(spark.createDataFrame([(item,)], "item string")).first()
    assert (r.title, r.link, r["size"], r.categories, r.seeders, r.leechers, r.attrs["n"]) == ("A & B", "", 12, [6000], 3, None, "2")


def test_whole_feed(spark):
    import xml.etree.ElementTree as ET

    items = spark.createDataFrame([(k, "f", f"<item><title>T &lt;{k}&gt;</title><guid>g{k}</guid></item>") for k in (2, 0, 1)], "place int, feed_id string, item string")
    parsed = items.select("feed_id", "place", F.from_xml("item", feed.ITEM).alias("x")).select("feed_id", "place", "x.*")
    keyed = feed.parse_items(parsed).join(parsed.select("feed_id", "place", "guid"), "guid")
    own = F.when(F.col("place") == 1, F.lit("A & B"))
    feeds = spark.createDataFrame([("f",), ("none",)], "feed_id string")
    got = {r.feed_id: ET.fromstring(r.document.encode()) for r in feed.render_feed(keyed.withColumn("title_override", own), feeds, "a & b").collect()}
    assert [c.tag for c in got["none"].find("channel")] == ["title"] and got["f"].find("channel/title").text == "a & b"
    assert [i.find("title").text for i in got["f"].iter("item")] == ["T <0>", "A & B", "T <2>"]
    attrs = [[(a.get("name"), a.get("value")) for a in i.iter("{%s}attr" % feed.NAMESPACE)] for i in got["f"].iter("item")]
    assert attrs == [[], [("originaltitle", "T <1>")], []]


def test_terms_that_cannot_be_resolved_pass_through(spark):
    e = spark.createDataFrame([ENTITY], SCHEMA)
    listed = spark.createDataFrame([(k, t) for k, t in enumerate(["North Light one", "South Light two", "light 01.02.2020 north", "x"])], "listing_id long, title string")
    terms = {1: "North Light 14.07.2026", 2: "north light", 3: "light 31.02.2020", 4: "Light 01.02.2020", 5: "", 6: None, 7: "light"}
    q = spark.createDataFrame(list(terms.items()), "query_id long, term string")
    routed = linkage.route(q, e)
    lost = "unparseable-query"
    assert {r.query_id: r.reason for r in routed.collect()} == {1: None, 2: lost, 3: lost, 4: "scene-unresolved", 5: lost, 6: lost, 7: lost}
    assert {r.query_id: (r.mode, r.reason) for r in linkage.route(q.where("query_id in (1, 2)"), None).collect()} == {1: ("passthrough", "no-index"), 2: ("passthrough", lost)}
    granted = routed.withColumn("granted", F.when(F.col("query_id") != 7, F.lit(True)))
    found = {}
    for r in linkage.passthrough(granted, listed, limit=3).collect():
        found.setdefault(r.query_id, set()).add(r.listing_id)
    assert found == {2: {0, 2}, 4: {2}, 5: {1, 2, 3}, 6: {1, 2, 3}}
    assert linkage.passthrough(granted, listed.where("false")).count() == 0


def test_variant_trace(spark):
    planned = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (2, 0, "a")], "search_id int, place int, text string")
    fired = spark.createDataFrame([(1, 0, "b", 4), (1, 1, "a", 0), (1, 2, "b", 5), (3, 0, "z", 1)], "search_id int, seq int, text string, results long")
    got = sorted(map(tuple, sessions.variant_trace(planned, fired).collect()))
    assert got == [(1, 0, "b", True, 5), (1, 1, "a", True, 0), (1, 2, "c", False, None), (1, 3, "d", False, None), (2, 0, "a", False, None), (3, 0, "z", True, 1)]


def test_unmatched_entries(spark):
    grabs = spark.createDataFrame([(1, 10, "a"), (4, 11, "a"), (5, 12, ""), (5, 13, None)], "at int, grab_id long, download_id string")
    imports = spark.createDataFrame([(2, 20, "a", True), (3, 21, "a", False), (6, 22, "b", True), (7, 23, "b", False), (8, 24, "", True), (9, 25, "", True), (9, 26, "a", True)], "at int, import_id long, download_id string, dry_run boolean")
    want = [(9, None, None, 25, True), (8, None, None, 24, True), (6, "b", None, 23, False), (5, None, 13, None, None), (5, None, 12, None, None), (4, "a", 11, 26, True), (1, "a", 10, 21, False)]
    assert [tuple(r) for r in sessions.unmatched(grabs, imports).collect()] == want
    assert [tuple(r) for r in sessions.unmatched(grabs, imports, 3).collect()] == want[:3]
    assert sessions.unmatched(grabs.where("false"), imports.where("false")).count() == 0


def test_import_stamps(spark):
    records = spark.createDataFrame([(1, "a", 10, 12), (2, "a", 20, 20), (2, None, 21, 21), (2, "b", 22, 22)], "session_id int, download_id string, place long, grab_id long")
    imports = spark.createDataFrame([(30, "a", True), (31, "a", False), (32, "", True), (33, "z", True)], "import_id long, download_id string, dry_run boolean")
    got = {(r.session_id, r.place): (r.import_id, r.dry_run) for r in sessions.stamped(records, imports).collect()}
    assert got == {(1, 10): (None, None), (2, 20): (31, False), (2, 21): (None, None), (2, 22): (None, None)}


def test_session_document(spark):
    kept = sessions.snapshot(spark.createDataFrame([(1, "x"), (10, "y"), (2, 'q"')], "session_id int, term string"), {}, keep=2)
    entries = spark.createDataFrame([(3, 7), (9, None)], "at int, grab_id int")
    state = spark.createDataFrame([(5, 60)], "index_size long, index_age long")
    got = json.loads(sessions.document(kept, entries, state).first()[0])
    assert got == {"sessions": [{"session_id": 10, "term": "y"}, {"session_id": 2, "term": 'q"'}], "unmatched_grabs": [{"at": 9}, {"at": 3, "grab_id": 7}], "index_size": 5, "index_age": 60}
    nothing = json.loads(sessions.document(kept.where("false"), entries.where("false"), state.withColumn("index_age", F.lit(None).cast("long"))).first()[0])
    assert nothing == {"sessions": [], "unmatched_grabs": [], "index_size": 5, "index_age": None}


def test_catalog_days(spark):
    texts = {"2020-02-03T10:00:00Z": "2020-02-03", "2020-02-03": "2020-02-03", "20200203": "2020-02-03", "2020": None, "2020-2": None, "2020-2-3": None, "2020-02-30": None, "20200230": None, "soon": None, "": None, None: None, "2020020312": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", feed.catalog_day(F.col("t")).cast("string").alias("d")).collect()
    assert {r.t: r.d for r in rows} == texts


def test_a_failing_refresh_keeps_the_catalog(spark):
    from titlelink.streaming.feed_stream import Refreshed

    e, good = entry_carriers(spark)[0], [True]

    def load():
        # the plan is fine, reading it is not
        return e if good[0] else e.select(F.raise_error(F.lit("down")).cast("long").alias("entity_id"), *e.columns[1:])

    catalog = Refreshed(load, seconds=0.0)
    first = sorted(r.entity_id for r in catalog.get().collect())
    good[0] = False
    assert sorted(r.entity_id for r in catalog.get().collect()) == first
    with pytest.raises(Exception, match="down"):
        Refreshed(load).get()


def test_webhooks(spark):
    bodies = ['{"eventType":"Grab","release":{"releaseTitle":"t","downloadId":"d","size":1.5e3}}', "{bad", '{"eventType":"Test"}']
    rows = feed.map_webhooks(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert [(r.kind, r.download_id, r["size"], r.wakes) for r in rows] == [("Grab", "d", 1500, True), ("", "", None, False), ("Test", "", None, False)]


def test_stream_equals_batch(spark, tmp_path):
    from titlelink.streaming.feed_stream import Refreshed, match_stream

    e, l = entry_carriers(spark)
    l.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(l.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = match_stream(stream, Refreshed(lambda: e), lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, linkage.match_feed(l, e).collect()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(DATA + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda row: [(x is None, str(x)) for x in row]
    assert sorted(([tuple(r[c] for c in names) for r in df.collect()]), key=key) == sorted(got.fetchall(), key=key)
