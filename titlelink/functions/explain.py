"""Why a pair matched or not, in plain words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings

SIGNALS = {"date": "the dates agree", "site": "the publisher is named in the title", "performer": "a person is named in the title", "title": "the whole title is there"}
VETOES = {
    "date-mismatch": "the date is too far off, or too little else agrees to forgive it",
    "site-mismatch": "the title names another known publisher",
    "foreign-title": "publisher, date or person agree, but the title is of something else",
}


def why(strong: Column, veto: Column, points: dict[str, Column], date_off: Column, date_secondary: Column, confidence: Column, settings: Settings = DEFAULTS) -> Column:
    """An array of lines. A veto is the only line; else signals with points, notes, and the comparison with the threshold."""
    rejected = F.lit("Rejected: ").cast("string")
    vetoed = F.concat(rejected, veto)
    for name, words in VETOES.items():
        vetoed = F.when(veto == name, F.concat(rejected, F.lit(words))).otherwise(vetoed)
    lines = [F.when(F.array_contains(strong, name), F.concat(F.lit(f"+ {words} ("), F.round(points[name]).cast("int").cast("string"), F.lit(")"))) for name, words in SIGNALS.items()]
    n = F.size(strong)
    lines += [
        F.when(date_off.isNotNull(), F.concat(F.lit("! the date is "), date_off.cast("string"), F.lit(" day(s) off, forgiven for "), n.cast("string"), F.lit(" strong signals"))),
        F.when(date_secondary, F.lit("! the date agrees only if day and month or year are read the other way; not counted")),
        F.when(~F.array_contains(strong, "title") & (points["title"] > 0), F.concat(F.lit("the title is similar ("), F.format_string("%.1f", points["title"].cast("double")), F.lit(")"))),
        F.when(n == 1, F.lit(f"! one strong signal alone is worth {settings.single_cap} at most")),
        F.concat(F.lit("confidence "), confidence.cast("string"), F.when(confidence >= settings.threshold, F.lit(f" >= {settings.threshold}: matched")).otherwise(F.lit(f" < {settings.threshold}: not matched"))),
    ]
    return F.when(veto.isNotNull(), F.array(vetoed)).otherwise(F.array_compact(F.array(*lines)))
