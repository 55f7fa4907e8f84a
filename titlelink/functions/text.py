"""Text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS, JUNK_TOKENS


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def squash(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def tokenize(c: Column) -> Column:
    return F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), "")


def identity_of(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: ~x.isin(*JUNK_TOKENS))


def content_of(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: ~x.isin(*JUNK_TOKENS) & ~x.rlike("^[0-9]+$"))


def identity_tokens(c: Column) -> Column:
    return identity_of(tokenize(c))


def content_tokens(c: Column) -> Column:
    return content_of(tokenize(c))


def ngrams(tokens: Column, most: int = DEFAULTS.max_ngram) -> Column:
    """Distinct concatenations of every run of 1 to `most` tokens."""

    def every(t: Column) -> Column:
        n, none = F.size(t), F.array().cast("array<string>")

        def runs(k: int) -> Column:
            return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.concat(*(F.get(t, i + j) for j in range(k))))).otherwise(none)

        return F.array_distinct(F.concat(t, *(runs(k) for k in range(2, most + 1))))

    return let(tokens, every)


def suffix_alias(name: Column, suffix: str = DEFAULTS.suffix, min_stem: int = DEFAULTS.min_stem) -> Column:
    """The spelling with the decorative suffix toggled; null where none makes sense."""
    s = F.trim(name)
    pattern = rf"(?i)[\s._-]*{suffix}$"
    stem = F.trim(F.regexp_replace(s, pattern, ""))
    return F.when(s == "", None).when(s.rlike(pattern), F.when(F.length(squash(stem)) >= min_stem, stem)).otherwise(F.concat(s, F.lit(" " + suffix)))


def name_keys(names: Column) -> Column:
    """What stands in a title's n-grams if one of these names does."""
    return F.array_remove(F.transform(names, squash), "")


def person_keys(people: Column, min_token: int = DEFAULTS.min_person_token) -> Column:
    """The same for people, each for itself; a name of one short token is none."""
    named = F.filter(people, lambda p: (F.length(squash(p)) >= min_token) | ((squash(p) != "") & (F.size(tokenize(p)) > 1)))
    return F.transform(named, squash)


def name_hit(names: Column, grams: Column) -> Column:
    return F.arrays_overlap(name_keys(names), grams)


def person_hits(people: Column, grams: Column, min_token: int = DEFAULTS.min_person_token) -> Column:
    """How many of the people the n-grams name; who is listed twice counts twice."""
    return F.size(F.filter(person_keys(people, min_token), lambda k: F.array_contains(grams, k)))


# What marks a resolution, a source and a codec, in order of preference, and its canonical token.
QUALITY = (
    ((r"\b(2160p|4k|uhd)\b", "2160p"), (r"\b1080p\b|\[1080\]", "1080p"), (r"\b720p\b|\[720\]", "720p"), (r"\b(480p|540p)\b", "480p")),
    ((r"\bweb-?dl\b", "WEB-DL"), (r"\bwebrip\b", "WEBRip")),
    ((r"\b(x265|h\.?265|hevc)\b", "x265"), (r"\b(x264|h\.?264|avc)\b", "x264")),
)


def quality_tokens(title: Column) -> Column:
    def first(group: tuple) -> Column:
        out = F.lit(None).cast("string")
        for pattern, token in reversed(group):
            out = F.when(title.rlike("(?i)" + pattern), token).otherwise(out)
        return out

    return F.array_compact(F.array(*(first(g) for g in QUALITY)))


def dotify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "."), r"^\.+|\.+$", "")


def canonical_title(publisher: Column, date: Column, title: Column, original: Column, suffix: str = DEFAULTS.suffix) -> Column:
    parts = F.concat(F.array(dotify(publisher), F.date_format(date, "yyyy-MM-dd"), dotify(title), F.lit(suffix)), quality_tokens(original))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), ".")


def redact(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\b(apikey|api_key|passkey|token)=[^&\s]+", "$1=REDACTED")


def basename(path: Column) -> Column:
    tail = F.regexp_extract(path, "([^/]*)$", 1)
    return F.when(tail == "", path).otherwise(tail)


def categories(c: Column, default: int = 6000) -> Column:
    found = F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x).rlike("^[0-9]+$")), lambda x: F.trim(x).cast("int"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def _two_decimals(size: Column) -> Column:
    """size / 1e9 with two decimals, as C prints that double: its exact binary value is rounded, ties to even."""

    def rounded(v: Column) -> Column:
        bits = (F.lit(53) - F.floor(F.log2(v))).cast("int")  # v times 2^bits is a whole number, and 200 times that fits a long
        return let(F.struct((v * F.pow(F.lit(2.0), bits)).cast("long").alias("m"), bits.alias("bits")), cents)

    def cents(x: Column) -> Column:
        one = F.call_function("shiftleft", F.lit(1).cast("long"), x["bits"])
        whole = F.call_function("shiftright", x["m"] * 100, x["bits"])
        twice = (x["m"] * 100 - F.call_function("shiftleft", whole, x["bits"])) * 2
        return whole + F.when((twice > one) | ((twice == one) & (whole % 2 == 1)), 1).otherwise(0)

    def text(c: Column) -> Column:
        return F.concat(F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))

    return let(let(size.cast("double") / 1e9, rounded), text)


def size_text(size: Column) -> Column:
    big = F.concat(_two_decimals(size), F.lit(" GB"))
    return F.when(size >= 1_000_000_000, big).otherwise(F.concat(F.round(size.cast("double") / 1e6).cast("long").cast("string"), F.lit(" MB")))


def is_sample(rejections: Column) -> Column:
    return F.exists(rejections, lambda r: F.lower(F.trim(r)) == "sample")


def is_by_id_hold(state: Column, messages: Column) -> Column:
    return state.isin("importBlocked", "importPending") & F.lower(F.array_join(messages, " ")).contains("matched to movie by id")
