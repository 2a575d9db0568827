"""SQL fragments shared by the DuckDB checks."""

from alertloom import constants as K

SEV_RANK = "CASE {c} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'unknown' THEN 4 ELSE {e} END"
EFFECTIVE = "coalesce(effective_event_at, issued_at, starts_at, created_at)"


def sev_rank(column: str = "normalized_severity", other: int = 99) -> str:
    return SEV_RANK.format(c=column, e=other)


def ts(expr: str, fmt: str = "%Y-%m-%d %H:%M:%S") -> str:
    return f"strftime({expr}, '{fmt}')"


def country(lat: str, lng: str) -> str:
    return f"coalesce({lat} BETWEEN 23 AND 38 AND {lng} BETWEEN 60 AND 78.5, false)"


def world(lat: str, lng: str) -> str:
    return f"coalesce({lat} BETWEEN -90 AND 90 AND {lng} BETWEEN -180 AND 180, false)"


def haversine(lat1, lng1, lat2, lng2) -> str:
    h = (f"(sin((radians({lat2}) - radians({lat1})) / 2) * sin((radians({lat2}) - radians({lat1})) / 2)"
         f" + cos(radians({lat1})) * cos(radians({lat2})) * sin((radians({lng2}) - radians({lng1})) / 2) * sin((radians({lng2}) - radians({lng1})) / 2))")
    return f"({2 * K.EARTH_RADIUS_KM!r} * asin(least(1.0, sqrt({h}))))"


def contains_case(text: str, groups, other: str) -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{label}'" for label, words in groups)
    return f"CASE {arms} ELSE '{other}' END"


def fold(text: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    t = f"replace(replace({t}, 'ß', 'ss'), 'ς', 'σ')"
    t = f"regexp_replace({t}, '[’‘`]', '''', 'g')"
    t = f"regexp_replace({t}, '[-‐‑‒–—_/]+', ' ', 'g')"
    t = f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}\\s\\x{{0600}}-\\x{{06ff}}'']+', ' ', 'g')"
    t = f"replace({t}, '''', ' ')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
