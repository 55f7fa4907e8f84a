"""SQL for DuckDB, written apart from the Spark queries that it checks."""

from __future__ import annotations

from ..config import JUNK_TOKENS
from .carriers import with_duck

_JUNK = "[" + ", ".join(f"'{t}'" for t in JUNK_TOKENS) + "]"
_SQ = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"


def _sq(c: str) -> str:
    return _SQ.format(c)


def _tok(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')"


def _ident(c: str) -> str:
    return f"list_filter({_tok(c)}, lambda x: NOT list_contains({_JUNK}, x))"


def _content(c: str) -> str:
    return f"list_filter({_ident(c)}, lambda x: NOT regexp_full_match(x, '[0-9]+'))"


def _grams(t: str) -> str:
    return f"list_distinct(flatten(list_transform(range(1, len({t}) + 1), lambda i: list_transform(range(1, least(6, len({t}) - i + 1) + 1), lambda k: array_to_string({t}[i:i + k - 1], '')))))"


def _alias(c: str) -> str:
    stem = f"trim(regexp_replace(trim({c}), '[\\s._-]*[xX][xX][xX]$', ''))"
    return f"CASE WHEN trim({c}) = '' THEN NULL WHEN regexp_matches(trim({c}), '[xX][xX][xX]$') THEN CASE WHEN length({_sq(stem)}) >= 3 THEN {stem} END ELSE trim({c}) || ' XXX' END"


def _quality(c: str) -> str:
    def m(p: str) -> str:
        return f"regexp_matches({c}, '(?i){p}')"

    res = f"CASE WHEN {m(r'\b(2160p|4k|uhd)\b')} THEN '2160p' WHEN {m(r'\b1080p\b|\[1080\]')} THEN '1080p' WHEN {m(r'\b720p\b|\[720\]')} THEN '720p' WHEN {m(r'\b(480p|540p)\b')} THEN '480p' END"
    src = f"CASE WHEN {m(r'\bweb-?dl\b')} THEN 'WEB-DL' WHEN {m(r'\bwebrip\b')} THEN 'WEBRip' END"
    codec = f"CASE WHEN {m(r'\b(x265|h\.?265|hevc)\b')} THEN 'x265' WHEN {m(r'\b(x264|h\.?264|avc)\b')} THEN 'x264' END"
    return f"list_filter([{res}, {src}, {codec}], lambda x: x IS NOT NULL)"


def _dots(c: str) -> str:
    return f"trim(regexp_replace({c}, '[^A-Za-z0-9]+', '.', 'g'), '.')"


def _valid(y: str, m: str, d: str) -> str:
    return f"CASE WHEN {y} BETWEEN 1990 AND 2049 THEN try_cast(lpad(CAST({y} AS VARCHAR), 4, '0') || '-' || CAST({m} AS VARCHAR) || '-' || CAST({d} AS VARCHAR) AS DATE) END"


def _parts(fmt: str) -> str:
    s = "(?:\\.\\.|--|__|//|  )"
    y4, y1, y2 = "[0-9]{4}", "[0-9]{1,2}", "[0-9]{2}"
    body = {"ymd": s.join((y4, y1, y1)), "xy4": s.join((y1, y1, y4)), "two": s.join((y2, y2, y2))}[fmt]
    hits = f"regexp_extract_all(regexp_replace(title, '([^0-9])', '\\1\\1', 'g'), '(?:^|[^0-9]){body}(?:$|[^0-9])', 0)"
    return f"list_transform({hits}, lambda h: list_transform(regexp_extract_all(h, '[0-9]+'), lambda n: CAST(n AS INT)))"


def _read(parts: str, y: int, m: int, d: int, two: bool) -> str:
    year = f"CASE WHEN p[{y}] <= 49 THEN 2000 + p[{y}] ELSE 1900 + p[{y}] END" if two else f"p[{y}]"
    return f"list_transform({parts}, lambda p: {_valid(f'({year})', f'p[{m}]', f'p[{d}]')})"


_DATES = (
    "SELECT listing_id, title, list_distinct(list_filter(list_concat(list_concat({0}, {1}), {2}), lambda x: x IS NOT NULL)) AS prim, "
    "list_distinct(list_filter(list_concat(list_concat({3}, {4}), list_concat({5}, {6})), lambda x: x IS NOT NULL)) AS alt FROM l"
).format(
    _read(_parts("ymd"), 1, 2, 3, False), _read(_parts("xy4"), 3, 2, 1, False), _read(_parts("two"), 1, 2, 3, True),
    _read(_parts("ymd"), 1, 3, 2, False), _read(_parts("xy4"), 3, 1, 2, False), _read(_parts("two"), 3, 2, 1, True), _read(_parts("two"), 3, 1, 2, True),
)
_READ = f"(SELECT listing_id, prim, list_filter(alt, lambda x: NOT list_contains(prim, x)) AS sec FROM ({_DATES}) q)"
_DAYS = "array_to_string(list_sort(list_transform({0}, lambda x: strftime(x, '%Y-%m-%d'))), ',')"

_ENT = "(SELECT *, publisher || ' XXX' AS alias, list_filter([person1, person2], lambda x: x IS NOT NULL) AS people FROM e)"
_TERM = "(SELECT entity_id AS query_id, publisher, d FROM e)"
_DATE_PAIRS = f"SELECT DISTINCT listing_id, entity_id FROM (SELECT listing_id, unnest(list_concat(prim, sec)) AS r FROM {_READ} z) a JOIN e ON e.d BETWEEN CAST(r - 1 AS DATE) AND CAST(r + 1 AS DATE)"
_LKEYS = f"SELECT listing_id, unnest(list_distinct(list_concat({_content('title')}, {_grams(_tok('title'))}))) AS t FROM l"
_EKEYS = f"SELECT entity_id, unnest(list_distinct(list_concat(list_concat({_content('title')}, flatten(list_transform(people, lambda p: {_content('p')}))), list_concat([{_sq('publisher')}, {_sq('alias')}], list_transform(people, lambda p: {_sq('p')}))))) AS t FROM {_ENT} z"
_TOKEN_PAIRS = f"SELECT DISTINCT listing_id, entity_id FROM ({_LKEYS}) a JOIN ({_EKEYS}) b ON a.t = b.t AND a.t <> ''"
_SUMS = "count(*) AS n, min(entity_id) AS least_id, max(entity_id) AS greatest_id, CAST(sum(entity_id) AS BIGINT) AS id_sum"
_PERSON = f"list_filter(people, lambda p: NOT (len({_tok('p')}) = 1 AND length({_tok('p')}[1]) < 3) AND len({_tok('p')}) > 0 AND list_contains(g, {_sq('p')}))"
_VARIANTS = f"""
SELECT entity_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(v), lambda x: {{'i': list_position(v, x), 'x': x}}))[1:5], lambda q: q.x), '|') AS variants FROM (
 SELECT entity_id, list_filter(list_transform(list_concat(list_concat(list_concat([publisher || ' ' || ymd], CASE WHEN len(c) >= 2 THEN [s3] ELSE [] END), list_concat(people, CASE WHEN len(c) > 0 THEN list_transform(people, lambda p: p || ' ' || s3) ELSE [] END)),
  list_concat(list_concat(CASE WHEN len(c) > 0 THEN [publisher || ' ' || s3, alias || ' ' || s3] ELSE [] END, [publisher, alias]), list_concat([alias || ' ' || ymd, publisher || ' ' || iso], list_transform(people, lambda p: p || ' ' || iso)))), lambda x: trim(x)), lambda x: x <> '') AS v
 FROM (SELECT *, {_content('title')} AS c, array_to_string({_content('title')}[1:3], ' ') AS s3, strftime(d, '%y.%m.%d') AS ymd, strftime(d, '%Y-%m-%d') AS iso FROM {_ENT} z) y) w
"""



def _ratio_of(rows: str) -> str:
    """The rows with ratio, of their lists a and b: the longest common subsequence is folded over bits, a character of the second text at a time."""
    diff = "list_sort(list_filter(list_distinct({0}), lambda t: NOT list_contains({1}, t)))"
    texts = f"SELECT *, array_to_string(list_sort(list_intersect(a, b)), ' ') AS j, array_to_string({diff.format('a', 'b')}, ' ') AS x, array_to_string({diff.format('b', 'a')}, ' ') AS y FROM ({rows}) r0"
    masks = "list_transform(string_split(y, ''), lambda c: coalesce(list_sum(list_transform(range(1, length(x) + 1), lambda k: CASE WHEN x[k] = c THEN CAST(1 AS BIGINT) << CAST(k - 1 AS BIGINT) ELSE 0 END)), 0))"
    whole = "((CAST(1 AS BIGINT) << CAST(length(x) AS BIGINT)) - 1)"
    fold = f"list_reduce(list_concat([{whole}], list_transform({masks}, lambda m: CAST(m AS BIGINT))), lambda row, m: ((row + (row & m)) | (row - (row & m))) & {whole})"
    lcs = f"SELECT *, CASE WHEN x = '' OR y = '' THEN 0 ELSE length(x) - bit_count({fold}) END AS lcs, length(j) AS s, CAST(j <> '' AS INT) AS gap FROM ({texts}) r1"
    plain = "100 - 100.0::DOUBLE * (length(x) + length(y) - 2 * lcs) / (2 * (s + gap) + length(x) + length(y))"
    return f"""SELECT * EXCLUDE (j, x, y, lcs, s, gap), CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 WHEN s > 0 AND (x = '' OR y = '') THEN 100.0 WHEN s = 0 THEN {plain}
        ELSE greatest({plain}, 100 - 100.0::DOUBLE * (gap + length(x)) / (2 * s + gap + length(x)), 100 - 100.0::DOUBLE * (gap + length(y)) / (2 * s + gap + length(y))) END AS ratio FROM ({lcs}) r2"""


_CANDIDATES = f"""dp AS ({_DATE_PAIRS}), tp AS (SELECT listing_id, entity_id, row_number() OVER (PARTITION BY listing_id ORDER BY entity_id) AS k FROM ({_TOKEN_PAIRS}) t ANTI JOIN dp USING (listing_id, entity_id)),
cand AS (SELECT listing_id, entity_id, true AS by_date FROM dp UNION ALL SELECT listing_id, entity_id, false FROM tp WHERE k <= 1000)"""
_NEAR = "len(list_filter({0}, lambda r: abs(date_diff('day', d, r)) <= 1)) > 0"
_SIGNALS = f"""SELECT c.*, ec, ei, kn, lc, li, c_worded AND NOT ts AND NOT mismatch AS wanted, ds, CASE WHEN NOT ds THEN {_NEAR.format('sec')} ELSE false END AS d2, d, prim, sec, site, mismatch, hits, ts FROM (
 SELECT *, c_worded AND len(ec) >= 2 AND list_has_all(li, ei) AND (site OR hits > 0) AS ts, NOT site AND vocab_hit AS mismatch FROM (
  SELECT cand.*, f.d, ec, ei, kn, lc, li, prim, sec, vocab_hit, len(ec) > 0 AND len(lc) > 0 AS c_worded, {_NEAR.format('prim')} AS ds, list_has_any(nk, g) AS site, len(list_filter(pk, lambda k: list_contains(g, k))) AS hits
  FROM cand JOIN f ON f.entity_id = cand.entity_id JOIN h ON h.listing_id = cand.listing_id) a) c"""
_JUDGED = f"""SELECT *, CASE WHEN veto IS NOT NULL THEN 0 ELSE CAST(least(100, round_even(CASE WHEN n < 2 THEN least(total, 65.0) ELSE total END, 0)) AS INT) END AS confidence,
  CASE WHEN veto = 'date-mismatch' THEN '' ELSE concat_ws(',', CASE WHEN ds THEN 'date' END, CASE WHEN site AND NOT mismatch THEN 'site' END, CASE WHEN hits > 0 AND NOT mismatch THEN 'performer' END, CASE WHEN ts AND NOT mismatch THEN 'title' END) END AS strong
 FROM (SELECT *, CAST(40 * CAST(ds AS INT) + 35 * CAST(site AS INT) + CASE WHEN hits > 1 THEN 50 WHEN hits = 1 THEN 35 ELSE 0 END AS DOUBLE) + CASE WHEN ts THEN 40.0 WHEN ratio >= 60 THEN ratio / 100.0 * 25 ELSE 0.0 END AS total,
   CASE WHEN mismatch THEN 'site-mismatch' WHEN coalesce(off > 3 OR (off IS NOT NULL AND n < 2), false) OR (d2 AND n < 2) THEN 'date-mismatch'
    WHEN n >= 2 AND NOT ts AND len(ec) >= 2 AND coalesce(ratio < 40, true) AND len(list_filter(list_distinct(lc), lambda t: NOT list_contains(ec, t) AND NOT list_contains(kn, t))) >= 3 THEN 'foreign-title' END AS veto
  FROM (SELECT *, CAST(ds AS INT) + CAST(site AS INT) + CAST(ts AS INT) + CAST(hits > 0 AS INT) AS n,
     CASE WHEN NOT ds AND NOT d2 THEN list_min(list_transform(list_concat(prim, sec), lambda r: abs(date_diff('day', d, r)))) END AS off
   FROM ({_ratio_of('SELECT *, CASE WHEN wanted THEN ec END AS a, CASE WHEN wanted THEN lc END AS b FROM sig')}) q1) q2) q3"""
_ALL_NAMES = "list_concat([publisher, alias], people)"
#: The scored candidates, as the view judged.
_SCORED = f""", {_CANDIDATES},
f AS MATERIALIZED (SELECT *, list_filter([{_sq('publisher')}, {_sq('alias')}], lambda x: x <> '') AS nk, list_transform(list_filter(people, lambda p: length({_sq('p')}) >= 3 OR len({_tok('p')}) > 1), lambda p: {_sq('p')}) AS pk, {_content('title')} AS ec, {_ident('title')} AS ei,
  list_distinct(list_concat(flatten(list_transform({_ALL_NAMES}, lambda x: {_tok('x')})), list_transform({_ALL_NAMES}, lambda x: {_sq('x')}))) AS kn FROM {_ENT} z),
lg AS MATERIALIZED (SELECT listing_id, {_content('title')} AS lc, {_ident('title')} AS li, {_grams(_tok('title'))} AS g FROM l),
vh AS (SELECT DISTINCT listing_id FROM (SELECT listing_id, unnest(g) AS t FROM lg) u JOIN (SELECT DISTINCT unnest(nk) AS t FROM f) v USING (t)),
h AS MATERIALIZED (SELECT lg.*, prim, sec, vh.listing_id IS NOT NULL AS vocab_hit FROM lg JOIN {_READ} rd ON rd.listing_id = lg.listing_id LEFT JOIN vh ON vh.listing_id = lg.listing_id),
sig AS (SELECT * FROM ({_SIGNALS}) s0), judged AS MATERIALIZED ({_JUDGED})
"""


#: Line items as the files of a manual-import list, with the JSON that is sent for each.
_FILES = """SELECT *, '{"path":"' || path || '","movieId":' || coalesce(CAST(movie_id AS VARCHAR), 'null') || ',"quality":{"quality":{"id":3}},"languages":[{"id":1}],"releaseGroup":null,"downloadId":"' || download_id || '","indexerFlags":0' || CASE WHEN part % 2 = 0 THEN ',"id":' || CAST(part AS VARCHAR) ELSE '' END || '}' AS entry
 FROM (SELECT CAST(l_orderkey AS VARCHAR) AS download_id, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, nullif(l_suppkey % 7, 0) AS movie_id, '/d/' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) || '.mkv' AS path FROM lineitem) z"""


def oracle_sql() -> dict[str, str]:
    title_of = "SELECT ent.*, l.title AS original FROM " + _ENT + " ent JOIN l ON listing_id = entity_id"
    return {
        "fn_squash": with_duck(f"SELECT listing_id, {_sq('title')} AS squashed FROM l"),
        "fn_tokens": with_duck(f"SELECT listing_id, array_to_string({_tok('title')}, ' ') AS tokens, array_to_string({_content('title')}, ' ') AS content, array_to_string({_ident('title')}, ' ') AS identity FROM l"),
        "fn_suffix_alias": with_duck(f"SELECT entity_id, name, {_alias('name')} AS alias FROM (SELECT entity_id, unnest([publisher, publisher || ' XXX', publisher || '.xxx', 'Ma XXX']) AS name FROM e) n"),
        "fn_ngrams": with_duck(f"SELECT listing_id, array_to_string(list_sort({_grams(_tok('title'))}), ' ') AS grams FROM l"),
        "fn_name_hits": with_duck(f"SELECT entity_id, list_contains(g, {_sq('publisher')}) OR list_contains(g, {_sq('alias')}) AS site, CAST(len({_PERSON}) AS BIGINT) AS hits FROM (SELECT *, {_grams(_tok('original'))} AS g FROM ({title_of}) a) b"),
        "fn_quality_tokens": with_duck(f"SELECT listing_id, array_to_string({_quality('title')}, ' ') AS quality FROM l"),
        "fn_canonical_title": with_duck(f"SELECT entity_id, array_to_string(list_filter(list_concat([{_dots('publisher')}, strftime(d, '%Y-%m-%d'), {_dots('title')}, 'XXX'], {_quality('original')}), lambda x: x <> ''), '.') AS canonical FROM ({title_of}) a"),
        "fn_redact": r"SELECT page_id, regexp_replace(url || '?apikey=abc' || CAST(page_id AS VARCHAR) || '&Token=x1&q=token', '(?i)\b(apikey|api_key|passkey|token)=[^&\s]+', '\1=REDACTED', 'g') AS url FROM pages",
        "fn_basename": "SELECT page_id, path, coalesce(nullif(regexp_extract(path, '([^/]*)$', 1), ''), path) AS name FROM (SELECT page_id, unnest([url, url || '/']) AS path FROM pages) p",
        "fn_size_text": "SELECT o_orderkey, size, CASE WHEN size >= 1000000000 THEN printf('%.2f GB', size / 1e9) ELSE CAST(CAST(round(size / 1e6) AS BIGINT) AS VARCHAR) || ' MB' END AS size_text FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 4000) AS BIGINT) AS size FROM orders) s",
        "fn_categories": "SELECT o_orderkey, c, CASE WHEN len(f) = 0 THEN '6000' ELSE array_to_string(f, ',') END AS categories FROM (SELECT o_orderkey, c, list_transform(list_filter(string_split(c, ','), lambda x: regexp_full_match(trim(x), '[0-9]+')), lambda x: CAST(CAST(trim(x) AS INT) AS VARCHAR)) AS f FROM (SELECT o_orderkey, unnest([o_orderpriority || ',' || CAST(o_custkey AS VARCHAR) || ',x, 6010', 'a,b']) AS c FROM orders) a) b",
        "dt_extract": with_duck(f"SELECT listing_id, {_DAYS.format('prim')} AS primary_dates, {_DAYS.format('sec')} AS secondary_dates FROM {_READ} z"),
        "dt_min_offset": with_duck(f"SELECT entity_id, CAST(min(abs(date_diff('day', d, r))) AS BIGINT) AS days_off, coalesce(bool_or(abs(date_diff('day', d, r)) <= 1), false) AS near FROM e LEFT JOIN (SELECT listing_id, unnest(list_concat(prim, sec)) AS r FROM {_READ} z) a ON listing_id = entity_id GROUP BY entity_id"),
        "src_catalog_map": with_duck(f"SELECT entity_id, p AS publisher, strftime(d, '%Y-%m-%d') AS day, title, CASE WHEN {_sq(_alias('p'))} <> {_sq('p')} THEN {_alias('p')} ELSE '' END AS aliases, array_to_string(people, ',') AS people FROM (SELECT *, CASE WHEN entity_id % 3 <> 0 THEN publisher WHEN entity_id % 2 = 0 THEN publisher || ' XXX' END AS p FROM {_ENT} z) y WHERE p IS NOT NULL AND entity_id % 5 <> 0 AND (entity_id % 7 <> 0 OR (day(d) > 9 AND month(d) > 9)) AND (entity_id % 7 = 0 OR entity_id % 11 <> 0)"),
        "src_feed_roundtrip": with_duck("SELECT 'g' || CAST(listing_id AS VARCHAR) AS guid, title, 'http://x/?a=1&b=2' AS link, listing_id * 1000 AS size, '6000,6010' AS categories, CAST(4 AS BIGINT) AS seeders, '3' AS grabs FROM l"),
        "src_remote_search": with_duck(f"SELECT query_id, listing_id FROM (SELECT entity_id AS query_id, listing_id, row_number() OVER (PARTITION BY entity_id ORDER BY listing_id) AS k FROM e JOIN (SELECT listing_id, unnest(list_distinct({_tok('title')})) AS t FROM l) w ON t = lower(person1)) r WHERE k <= 100"),
        "search_passthrough": with_duck(
            f"SELECT query_id, listing_id, title FROM (SELECT query_id, listing_id FROM (SELECT entity_id AS query_id, listing_id, row_number() OVER (PARTITION BY entity_id ORDER BY listing_id) AS k FROM e JOIN (SELECT listing_id, unnest(list_distinct({_tok('title')})) AS t FROM l) w ON t = lower(person1) WHERE entity_id % 50 <> 0) r WHERE k <= 100"
            " UNION ALL SELECT entity_id, listing_id FROM e, (SELECT listing_id FROM l ORDER BY listing_id DESC LIMIT 100) n WHERE entity_id % 50 = 0 OR person1 IS NULL) x JOIN (SELECT listing_id, title FROM l) y USING (listing_id) WHERE query_id % 7 <> 0"
        ),
        "session_variants": "WITH p AS (SELECT user_id AS search_id, event_type AS text, min(event_id) AS planned, min(event_id) FILTER (value > 50) AS fired_at, arg_max(CAST(floor(value) AS BIGINT), event_id) FILTER (value > 50) AS results FROM events GROUP BY user_id, event_type)"
        " SELECT search_id, row_number() OVER (PARTITION BY search_id ORDER BY fired_at IS NULL, coalesce(fired_at, planned), text) - 1 AS place, text, fired_at IS NOT NULL AS fired, results FROM p",
        "join_resolve": with_duck(f"SELECT DISTINCT query_id, e.entity_id FROM (SELECT query_id, publisher, unnest(CASE WHEN day(d) <= 12 AND day(d) <> month(d) THEN [d, make_date(CAST(year(d) AS BIGINT), CAST(day(d) AS BIGINT), CAST(month(d) AS BIGINT))] ELSE [d] END) AS r FROM {_TERM} z) q JOIN e ON {_sq('e.publisher')} = {_sq('q.publisher')} AND abs(date_diff('day', q.r, e.d)) <= 1"),
        "join_date_band": with_duck(f"SELECT listing_id, {_SUMS} FROM ({_DATE_PAIRS}) p GROUP BY listing_id"),
        "join_token_overlap": with_duck(f"SELECT listing_id, {_SUMS} FROM ({_TOKEN_PAIRS}) p GROUP BY listing_id"),
        "join_blocked_capped": with_duck(f", dp AS ({_DATE_PAIRS}), tp AS (SELECT listing_id, entity_id, row_number() OVER (PARTITION BY listing_id ORDER BY entity_id) AS k FROM ({_TOKEN_PAIRS}) t ANTI JOIN dp USING (listing_id, entity_id)) SELECT listing_id, count(*) AS n, CAST(count(*) FILTER (by_date) AS BIGINT) AS n_by_date, CAST(sum(entity_id) AS BIGINT) AS id_sum FROM (SELECT listing_id, entity_id, true AS by_date FROM dp UNION ALL SELECT listing_id, entity_id, false FROM tp WHERE k <= 1000) u GROUP BY listing_id"),
        "dt_parse_query": with_duck("""SELECT entity_id, publisher || ' ' || strftime(d, '%d.%m.%Y') AS term, publisher AS publisher_token, strftime(d, '%Y-%m-%d') || CASE WHEN day(d) <= 12 AND day(d) <> month(d) THEN ',' || strftime(make_date(CAST(year(d) AS BIGINT), CAST(day(d) AS BIGINT), CAST(month(d) AS BIGINT)), '%Y-%m-%d') ELSE '' END AS dates FROM e
            UNION ALL SELECT entity_id, publisher || ' 31.02.2001', NULL, NULL FROM e UNION ALL SELECT entity_id, title, NULL, NULL FROM e"""),
        "fn_token_set_ratio": with_duck(f"SELECT entity_id, round(ratio, 4) AS ratio FROM ({_ratio_of(f'SELECT entity_id, {_content("title")} AS a, {_content("original")} AS b FROM ({title_of}) t0')}) t1"),
        "score_pairs": with_duck(_SCORED + "SELECT listing_id, entity_id, confidence, strong, veto, round(ratio, 4) AS ratio FROM judged"),
        "feed_match": with_duck(_SCORED + f"""SELECT l.listing_id, b.entity_id, b.confidence, CASE WHEN b.entity_id IS NULL THEN l.title ELSE array_to_string(list_filter(list_concat([{_dots('e.publisher')}, strftime(e.d, '%Y-%m-%d'), {_dots('e.title')}, 'XXX'], {_quality('l.title')}), lambda x: x <> ''), '.') END AS out_title
            FROM l LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY confidence DESC, by_date DESC, entity_id) AS k FROM judged WHERE confidence >= 75) b ON b.listing_id = l.listing_id AND k = 1 LEFT JOIN e ON e.entity_id = b.entity_id"""),
        "import_pack_verdicts": with_duck(_SCORED + """SELECT l.listing_id AS file_id, l.listing_id // 5 AS download_id, CASE WHEN coalesce(confidence, 0) < 90 OR strong = '' THEN 'unmatched' WHEN confidence - following < 10 THEN 'ambiguous' ELSE 'matched' END AS verdict,
            CASE WHEN confidence >= 90 AND strong <> '' AND confidence - following >= 10 THEN entity_id END AS target_id
            FROM l LEFT JOIN (SELECT *, row_number() OVER w AS k, coalesce(lead(confidence) OVER w, 0) AS following FROM judged WINDOW w AS (PARTITION BY listing_id ORDER BY confidence DESC, entity_id)) t ON t.listing_id = l.listing_id AND k = 1"""),
        "plan_variants": with_duck(_VARIANTS),
        "queue_holds": "SELECT CAST(o_orderkey AS VARCHAR) AS download_id, o_custkey AS movie_id, CASE o_orderstatus WHEN 'F' THEN 'importBlocked' ELSE 'importPending' END AS state FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey % 2 = 0 AND o_custkey <> 0",
        "import_single": """SELECT download_id, CASE WHEN reason IS NULL THEN 'plan' ELSE 'skip' END AS action, reason, CASE WHEN reason IS NULL THEN path END AS path FROM (
            SELECT *, CASE WHEN videos <> 1 THEN 'not-one-video' WHEN movie_id IS NULL THEN 'no-movie' WHEN movie_id <> download_id % 50 THEN 'other-movie' WHEN rejected THEN 'rejected' END AS reason FROM (
             SELECT l_orderkey AS download_id, count(*) FILTER (l_linenumber <= 2) AS videos, max(CASE l_suppkey % 3 WHEN 1 THEN l_orderkey % 50 WHEN 2 THEN l_suppkey END) FILTER (l_linenumber <= 2) AS movie_id,
              bool_or(l_partkey % 9 = 0) FILTER (l_linenumber <= 2) AS rejected, max('/d/' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) || '.mp4') FILTER (l_linenumber <= 2) AS path
             FROM lineitem GROUP BY l_orderkey) a) b""",
        "import_pack_final": """SELECT download_id, files, matched, CASE WHEN reason IS NULL THEN 'plan' ELSE 'skip' END AS action, reason FROM (
            SELECT *, CASE WHEN matched < files THEN 'not-fully-matched' WHEN bad > 0 THEN 'target-state' WHEN matched <> targets THEN 'duplicate-target' END AS reason FROM (
             SELECT l_orderkey AS download_id, count(*) AS files, CAST(count(*) FILTER (ok) AS BIGINT) AS matched, count(*) FILTER (ok AND (p_partkey IS NULL OR p_partkey % 11 = 0 OR p_partkey % 13 = 0)) AS bad, count(DISTINCT CASE WHEN ok THEN l_partkey END) AS targets
             FROM (SELECT *, l_suppkey % 17 <> 0 AND l_suppkey % 19 <> 0 AS ok FROM lineitem) x LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey) a) b""",
        "sweep_summary": """SELECT o_orderstatus, CAST(count(*) FILTER (o = 'acted') AS BIGINT) AS acted, CAST(count(*) FILTER (o = 'skipped') AS BIGINT) AS skipped, CAST(count(*) FILTER (o = 'waited') AS BIGINT) AS waited, CAST(count(*) FILTER (o = 'parked') AS BIGINT) AS parked FROM (
            SELECT o_orderstatus, CASE WHEN 300 - o_orderkey % 300 < 120 THEN 'waited' WHEN o_orderkey % 5 >= 3 THEN 'parked' WHEN o_orderkey % 7 = 0 THEN 'skipped' WHEN o_orderkey % 4 = 0 AND 300 - o_orderkey % 290 < 120 THEN 'waited' ELSE 'acted' END AS o FROM orders) a GROUP BY o_orderstatus""",
        "session_ring": "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events WHERE event_type = 'view') a WHERE rank <= 50",
        "session_candidates_capped": "SELECT session_id, seq, confidence, matched FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY matched DESC, confidence DESC, seq) AS k FROM (SELECT user_id AS session_id, event_id AS seq, CAST(CAST(floor(value * 7) AS BIGINT) % 101 AS INT) AS confidence, event_type = 'purchase' AS matched FROM events) a) b WHERE matched OR k <= 200",
        "session_status": "SELECT session_id, n, matched, n - matched AS dropped, best, CASE WHEN session_id % 10 = 0 THEN 'error' WHEN session_id % 7 = 0 THEN 'rss' WHEN session_id % 5 = 0 THEN 'passthrough' WHEN matched > 0 THEN 'matched' ELSE 'empty' END AS status FROM (SELECT user_id AS session_id, count(*) AS n, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS matched, max(CAST(CAST(floor(value * 7) AS BIGINT) % 101 AS INT)) AS best FROM events GROUP BY user_id) a",
        "session_rewritten": "SELECT user_id AS session_id, count(*) FILTER (event_type = 'purchase') AS matched, count(*) FILTER (event_type = 'purchase' AND event_id % 3 = 0) AS rewritten FROM events GROUP BY user_id",
        "grab_correlate": """WITH x AS (SELECT *, CAST(user_id AS VARCHAR) || '-' || CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR) AS title, CAST(floor(value * 100) AS BIGINT) % 5 AS size FROM events),
            h AS (SELECT g.event_id AS grab_id, v.event_id // 100 AS session_id, v.event_id AS guid, g.size = v.size AS same FROM x g JOIN x v ON g.title = v.title AND g.event_type = 'purchase' AND v.event_type = 'view'),
            t AS (SELECT grab_id, max(session_id) AS session_id FROM h GROUP BY grab_id)
            SELECT g.event_id AS grab_id, t.session_id, CASE WHEN count(DISTINCT guid) = 1 THEN CAST(max(guid) AS VARCHAR) WHEN count(DISTINCT guid) FILTER (same) = 1 THEN CAST(max(guid) FILTER (same) AS VARCHAR) END AS guid
            FROM events g LEFT JOIN t ON t.grab_id = g.event_id LEFT JOIN h ON h.grab_id = t.grab_id AND h.session_id = t.session_id WHERE g.event_type = 'purchase' GROUP BY g.event_id, t.session_id""",
        "import_correlate": """WITH x AS (SELECT *, CASE WHEN user_id % 6 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) || '/' || CAST(CAST(floor(value) AS BIGINT) % 4 AS VARCHAR) END AS did, CASE WHEN event_id % 3 > 0 THEN event_id // 100 END AS sid FROM events),
            h AS (SELECT i.event_id AS import_id, g.event_id AS grab_id, g.sid, row_number() OVER (PARTITION BY i.event_id ORDER BY g.sid DESC NULLS LAST, g.event_id) AS k FROM x i JOIN x g ON i.did = g.did AND i.did <> '' AND g.event_type = 'purchase' AND i.event_type = 'signup')
            SELECT event_id AS import_id, grab_id, sid AS session_id FROM (SELECT event_id FROM events WHERE event_type = 'signup') e LEFT JOIN (SELECT * FROM h WHERE k = 1) q ON import_id = event_id""",
        "grab_pills": """WITH x AS (SELECT *, CAST(user_id AS VARCHAR) || ':' || CAST(CAST(floor(value) AS BIGINT) % 6 AS VARCHAR) AS guid FROM events), g AS (SELECT guid, max(event_id) AS grab_id FROM x WHERE event_type = 'purchase' GROUP BY guid)
            SELECT event_id // 100 AS session_id, count(*) AS n, count(grab_id) AS grabbed, max(grab_id) AS last_grab FROM x LEFT JOIN g USING (guid) WHERE event_type = 'view' GROUP BY event_id // 100""",
        "rate_limit": """WITH RECURSIVE a AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
            f(key, seq, k, t, tokens, granted) AS (SELECT key, seq, k, t, CAST(3.0 AS DOUBLE), true FROM a WHERE k = 1
             UNION ALL SELECT a.key, a.seq, a.k, a.t, CASE WHEN least(4.0, f.tokens + (a.t - f.t) / 21600.0) >= 1 THEN least(4.0, f.tokens + (a.t - f.t) / 21600.0) - 1 ELSE least(4.0, f.tokens + (a.t - f.t) / 21600.0) END, least(4.0, f.tokens + (a.t - f.t) / 21600.0) >= 1
             FROM f JOIN a ON a.key = f.key AND a.k = f.k + 1)
            SELECT key, seq, granted FROM f""",
        "fn_explain": """SELECT o_orderkey, CASE WHEN k % 11 = 0 THEN 'Rejected: the title names another known publisher' WHEN k % 13 = 0 THEN 'Rejected: the date is too far off, or too little else agrees to forgive it'
             WHEN k % 17 = 0 THEN 'Rejected: publisher, date or person agree, but the title is of something else' WHEN k % 19 = 0 THEN 'Rejected: other' ELSE concat_ws('|',
             CASE WHEN k % 2 = 0 THEN '+ the dates agree (40)' END, CASE WHEN k % 3 = 0 THEN '+ the publisher is named in the title (35)' END, CASE WHEN k % 5 = 0 THEN '+ a person is named in the title (50)' END,
             CASE WHEN k % 7 = 0 THEN '+ the whole title is there (40)' END, CASE WHEN k % 9 = 0 THEN '! the date is 2 day(s) off, forgiven for ' || CAST(n AS VARCHAR) || ' strong signals' END,
             CASE WHEN k % 8 = 1 THEN '! the date agrees only if day and month or year are read the other way; not counted' END, CASE WHEN k % 7 <> 0 AND k % 4 = 0 THEN 'the title is similar (17.5)' END,
             CASE WHEN n = 1 THEN '! one strong signal alone is worth 65 at most' END, 'confidence ' || CAST(k % 101 AS VARCHAR) || CASE WHEN k % 101 >= 75 THEN ' >= 75: matched' ELSE ' < 75: not matched' END) END AS lines
            FROM (SELECT o_orderkey, o_orderkey AS k, CAST(o_orderkey % 2 = 0 AS INT) + CAST(o_orderkey % 3 = 0 AS INT) + CAST(o_orderkey % 5 = 0 AS INT) + CAST(o_orderkey % 7 = 0 AS INT) AS n FROM orders) a""",
        "queue_map": "SELECT CAST(o_orderkey AS VARCHAR) AS download_id, CAST(o_custkey % 5 AS BIGINT) AS movie_id, 'importBlocked' AS state, 'T' || CAST(o_orderkey AS VARCHAR) || '|a|b|plain' AS messages, 'q' AS title FROM orders WHERE o_custkey % 5 <> 0",
        "import_files_map": f"SELECT download_id, line, part, movie_id, line > 2 AS is_sample, CASE WHEN line > 2 THEN ' Sample' WHEN part % 9 = 0 THEN 'bad|{{\"other\":1}}' ELSE '' END AS rejections, entry FROM ({_FILES}) f",
        "import_route": "SELECT l_orderkey AS download_id, count(*) FILTER (l_linenumber <= 2) AS videos, CASE WHEN count(*) FILTER (l_linenumber <= 2) <= 1 THEN 'single' ELSE 'pack' END AS route FROM lineitem GROUP BY l_orderkey",
        "import_commands": f"""SELECT download_id, '{{"name":"ManualImport","importMode":"copy","files":[' || string_agg(entry, ',' ORDER BY path) || ']}}' AS command
            FROM (SELECT download_id, path, min(entry) AS entry FROM ({_FILES}) f WHERE line <= 2 AND part % 9 <> 0 AND movie_id IS NOT NULL GROUP BY download_id, path) g GROUP BY download_id""",
        "hold_sweeps": """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY did ORDER BY sweep) AS k FROM (SELECT l_orderkey AS did, CAST(l_linenumber AS BIGINT) AS sweep, max(l_suppkey) % 10 <> 0 AS held, max(l_partkey) % 7 <> 0 AS ready FROM lineitem GROUP BY l_orderkey, l_linenumber) a),
            f(did, k, sweep, seen, tries, parked, fired, outcome) AS (
             SELECT did, CAST(0 AS BIGINT), CAST(-9 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), false, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM o WHERE k = 1
             UNION ALL
             SELECT did, k, sweep, seen, tries + CAST(coalesce(outcome, '') = 'fire' AS BIGINT), parked OR coalesce(outcome, '') = 'parked', CASE WHEN outcome = 'fire' THEN sweep * 100 ELSE fired END, outcome FROM (
              SELECT *, CASE WHEN NOT held OR parked THEN NULL WHEN sweep * 100 - seen < 150 THEN 'waited' WHEN tries >= 2 THEN 'parked' WHEN NOT ready THEN 'skipped' WHEN sweep * 100 - fired < 150 THEN 'waited' ELSE 'fire' END AS outcome FROM (
               SELECT o.did, o.k, o.sweep, o.held, o.ready, coalesce(CASE WHEN go THEN f.seen END, CASE WHEN o.held AND NOT (go AND f.parked) THEN o.sweep * 100 END) AS seen, CASE WHEN go THEN f.tries ELSE 0 END AS tries, go AND f.parked AS parked, CASE WHEN go THEN f.fired END AS fired
               FROM (SELECT f.*, EXISTS (SELECT 1 FROM o n WHERE n.did = f.did AND n.sweep = f.sweep + 1) AS go FROM f) f JOIN o ON o.did = f.did AND o.k = f.k + 1) b) c)
            SELECT CAST(f.did AS VARCHAR) AS download_id, f.sweep, CASE WHEN outcome = 'fire' THEN CASE WHEN p % 5 <> 0 THEN 'acted' ELSE 'failed' END ELSE outcome END AS outcome, tries AS attempts
            FROM f JOIN (SELECT l_orderkey AS did, CAST(l_linenumber AS BIGINT) AS sweep, max(l_partkey) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber) x ON x.did = f.did AND x.sweep = f.sweep WHERE outcome IS NOT NULL""",
        "hold_wake": "SELECT o_orderstatus, coalesce(greatest(0.5, least(900.0, CAST(min(CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 200 > 180 THEN o_orderkey % 200 - 180 END) AS DOUBLE))), 900.0) AS wake_after FROM orders GROUP BY o_orderstatus",
        "catalog_counts": "SELECT count(*) AS records, CAST(count(*) FILTER (o_orderkey % 6 <> 0 AND o_custkey % 4 > 1) AS BIGINT) AS mapped, CAST(count(*) FILTER (NOT (o_orderkey % 6 <> 0 AND o_custkey % 4 > 1)) AS BIGINT) AS skipped FROM orders",
        "webhook_map": """SELECT kind, kind = 'Grab' AS tells, kind NOT IN ('', 'Test') AS wakes, CASE WHEN kind = '' THEN '' WHEN event_id % 2 = 0 THEN 'r' ELSE 'd' END AS "from", count(*) AS n, CAST(sum(CASE WHEN kind <> '' THEN event_id * 1000 END) AS BIGINT) AS sizes, max(CASE WHEN kind <> '' THEN 't' || CAST(event_id AS VARCHAR) ELSE '' END) AS last_title
            FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 5 = 0 THEN 'Test' WHEN event_id % 3 = 0 THEN 'Download' ELSE 'Grab' END AS kind FROM events) a WHERE kind <> 'Test' GROUP BY ALL""",
        "search_gated": "SELECT user_id AS search_id, event_id AS variant FROM (SELECT *, min(CASE WHEN event_id % 23 = 0 OR event_id / 100.0 > 45 THEN event_id END) OVER (PARTITION BY user_id) AS stop FROM events) a WHERE stop IS NULL OR event_id < stop",
        "grab_records": """SELECT session_id, did AS download_id, min(event_id) AS place, max(event_id) AS grab_id, CAST(max(event_id) * 3 AS VARCHAR) AS guid FROM (SELECT event_id, event_id // 100 AS session_id, CASE WHEN event_id % 6 <> 0 THEN CAST(user_id AS VARCHAR) END AS did, CASE WHEN event_id % 6 = 0 THEN event_id END AS apart FROM events WHERE event_id % 4 > 0) a
            GROUP BY session_id, did, apart""",
        "grab_orphans": "SELECT event_id AS grab_id, CASE WHEN event_id % 6 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS download_id FROM events WHERE event_id % 4 = 0 ORDER BY event_id DESC LIMIT 20",
        "grab_stamps": """WITH x AS (SELECT event_id AS k, event_id // 100 AS sid, CAST(user_id AS VARCHAR) AS u FROM events WHERE event_id % 4 > 0),
            r AS (SELECT sid, CASE WHEN k % 6 <> 0 THEN u END AS did, min(k) AS place FROM x GROUP BY sid, CASE WHEN k % 6 <> 0 THEN u END, CASE WHEN k % 6 = 0 THEN k END),
            o AS (SELECT *, did IS NOT NULL AND row_number() OVER (PARTITION BY did ORDER BY sid DESC, place) = 1 AS first FROM r),
            i AS (SELECT CAST(user_id AS VARCHAR) AS u, max(event_id) AS import_id FROM events WHERE event_type = 'signup' AND event_id % 8 <> 0 GROUP BY user_id)
            SELECT sid AS session_id, did AS download_id, place, import_id, import_id % 2 = 0 AS dry_run FROM o LEFT JOIN i ON first AND u = did""",
        "grab_unmatched": """WITH x AS (SELECT event_id AS k, event_type = 'signup' AS imp, CASE WHEN event_id % CASE WHEN event_type = 'signup' THEN 8 ELSE 6 END <> 0 THEN CAST(user_id AS VARCHAR) END AS did FROM events WHERE event_type = 'signup' OR event_id % 4 = 0),
            b AS (SELECT *, did IS NULL OR NOT imp OR NOT EXISTS (SELECT 1 FROM x y WHERE y.did = x.did AND y.k < x.k) AS begins FROM x),
            e AS (SELECT *, CASE WHEN begins THEN k ELSE max(CASE WHEN begins THEN k END) OVER (PARTITION BY did ORDER BY k) END AS entry FROM b)
            SELECT entry AS at, any_value(did) AS download_id, max(CASE WHEN NOT imp THEN k END) AS grab_id, max(CASE WHEN imp THEN k END) AS import_id, max(CASE WHEN imp THEN k END) % 2 = 0 AS dry_run FROM e GROUP BY entry""",
        "session_pills": """SELECT session_id, concat_ws(', ', CASE WHEN a > 1 THEN 'Imported ×' || CAST(a AS VARCHAR) WHEN a = 1 THEN 'Imported' END, CASE WHEN b > 1 THEN 'Would import (dry-run) ×' || CAST(b AS VARCHAR) WHEN b = 1 THEN 'Would import (dry-run)' END, CASE WHEN c > 1 THEN 'Grabbed ×' || CAST(c AS VARCHAR) WHEN c = 1 THEN 'Grabbed' END) AS pills
            FROM (SELECT event_id // 5 AS session_id, count(*) FILTER (event_id % 3 = 0 AND event_id % 2 <> 0) AS a, count(*) FILTER (event_id % 6 = 0) AS b, count(*) FILTER (event_id % 3 <> 0) AS c FROM events GROUP BY event_id // 5) s""",
        "session_snapshot": """SELECT session_id, '{"session_id":' || CAST(session_id AS VARCHAR) || ',"n":' || CAST(n AS VARCHAR) || ',"candidates":[' || coalesce(c, '') || ']}' AS json FROM (SELECT event_id // 7 AS session_id, count(*) AS n,
             string_agg('{"seq":' || CAST(event_id AS VARCHAR) || ',"user_id":' || CAST(user_id AS VARCHAR) || '}', ',' ORDER BY event_id) FILTER (event_type = 'view') AS c FROM events GROUP BY event_id // 7) s ORDER BY session_id DESC LIMIT 50""",
        "index_health": with_duck(f"SELECT count(DISTINCT entity_id) AS index_size, count(DISTINCT n) AS names, CAST(900 AS BIGINT) AS index_age FROM (SELECT entity_id, unnest([{_sq('publisher')}, {_sq('alias')}]) AS n FROM {_ENT} z) y"),
    }
