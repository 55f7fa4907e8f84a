"""Settings and fixed values of the linkage engine."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

# Tokens that carry no identity (containers, resolutions, sources, codecs, filler).
JUNK_TOKENS = (
    "xxx", "mp4", "wmv", "avi", "mkv", "mov", "ts",
    "480p", "540p", "720p", "1080p", "2160p", "480", "540", "720", "1080", "2160",
    "4k", "uhd", "hd", "sd", "fhd", "qhd",
    "web", "webdl", "webrip", "web-dl", "dl", "hdrip", "dvdrip", "dvd",
    "h264", "h265", "x264", "x265", "hevc", "avc", "av1",
    "aac", "ac3", "mp3", "flac",
    "repack", "internal", "remastered", "proper", "readnfo",
    "siterip", "split", "scenes", "psychoporn", "rq", "kleenex", "kt",
)


@dataclass(frozen=True)
class Settings:
    """Fixed values of scoring, and the defaults of what can be configured."""

    suffix: str = "XXX"
    min_stem: int = 3
    max_ngram: int = 6
    first_year: int = 1990
    last_year: int = 2049
    date_points: int = 40
    site_points: int = 35
    person_points: int = 35
    several_persons: int = 15
    title_points: int = 40
    title_most: int = 25
    single_cap: int = 65
    ratio_gate: float = 60.0
    foreign_ratio: float = 40.0
    foreign_residual: int = 3
    min_person_token: int = 3
    min_title_tokens: int = 2
    threshold: int = 75
    max_queries: int = 5
    date_skew_days: int = 3
    token_only_cap: int = 1000
    burst: float = 4.0
    refill_seconds: float = 15.0
    import_threshold: int = 90
    import_margin: int = 10
    grace_seconds: float = 120.0
    attempts: int = 3
    import_enabled: bool = False
    dry_run: bool = True
    multipack: bool = False
    reconcile_seconds: float = 900.0
    search_seconds: float = 45.0
    sessions: int = 50
    candidates: int = 200
    orphans: int = 20


DEFAULTS = Settings()

#: Where a settings file may name a value: its section, its key, and the field.
FILE_KEYS = {
    "matching": {"threshold": "threshold", "max_queries_per_search": "max_queries", "date_skew_days": "date_skew_days"},
    "rate_limit": {"burst": "burst", "refill_seconds": "refill_seconds"},
    "import_completer": {
        "enabled": "import_enabled", "dry_run": "dry_run", "multipack": "multipack", "grace_seconds": "grace_seconds", "reconcile_seconds": "reconcile_seconds",
        "max_attempts": "attempts", "import_threshold": "import_threshold", "ambiguity_margin": "import_margin",
    },
    "ui": {"max_sessions": "sessions", "max_candidates": "candidates"},
}


def load_settings(raw: Mapping | str | None, env: Mapping[str, str], prefix: str = "TITLELINK_") -> Settings:
    """raw: a parsed settings file, or its path (YAML). Any field may be set by an environment variable, which goes before the file."""
    if isinstance(raw, str):
        import yaml

        with open(raw, encoding="utf-8") as f:
            raw = yaml.safe_load(f)
    found = {field: section[key] for name, keys in FILE_KEYS.items() if (section := (raw or {}).get(name) or {}) for key, field in keys.items() if key in section}
    for f in fields(Settings):
        if (value := env.get(prefix + f.name.upper())) is not None:
            found[f.name] = value.strip().lower() in {"1", "true", "yes", "on"} if isinstance(f.default, bool) else value
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    return Settings(**{name: kinds[name](value) for name, value in found.items()})
