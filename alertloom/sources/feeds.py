"""Landed documents to alert rows, one function per feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertloom import constants as K
from alertloom.functions import geo, text, timeops
from alertloom.operators import bulletins as B

CAP_SCHEMA = (
    "identifier string, sent string, info array<struct<headline:string,description:string,instruction:string,"
    "event:string,severity:string,onset:string,expires:string,area:array<struct<areaDesc:string>>>>")


def read_cap(docs: DataFrame, content: str = "content") -> DataFrame:
    """CAP documents (url, content) to fields of the first info and first area.
    Documents without an alert or info element are dropped."""
    parsed = docs.withColumn("cap", F.from_xml(F.col(content), CAP_SCHEMA, {"ignoreNamespace": "true"}))
    info = F.get(F.col("cap.info"), 0)
    rows = parsed.withColumn("info", info).filter("info IS NOT NULL")
    or_else = lambda name, other: F.coalesce(F.col(f"info.{name}"), F.lit(other))
    return rows.select(
        *[c for c in docs.columns if c != content],
        F.col("cap.identifier").alias("source_alert_id"), or_else("headline", "PMD Weather Alert").alias("title"),
        or_else("description", "").alias("description"), or_else("instruction", "").alias("instructions"),
        or_else("event", "Weather").alias("hazard_type"), or_else("severity", "Unknown").alias("official_severity"),
        F.col("cap.sent").alias("issued_at_raw"), F.col("info.onset").alias("starts_at_raw"),
        F.col("info.expires").alias("expires_at_raw"), text.filled(F.get(F.col("info.area"), 0)["areaDesc"]).alias("raw_location"),
    ).withColumn("raw_text", F.concat(
        "title", F.lit("\n\n"), "description", F.lit("\n\nInstructions: "), "instructions"))


def cap_to_alerts(rows: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(alerts, rejected): a time that is given but unreadable rejects the row."""
    times = {c: timeops.parse_ts(F.col(f"{c}_raw")) for c in ("issued_at", "starts_at", "expires_at")}
    rows = rows.withColumns(times)
    broken = lambda c: text.filled(F.col(f"{c}_raw")).isNotNull() & F.col(c).isNull()
    rows = rows.withColumn("bad", broken("issued_at") | broken("starts_at") | broken("expires_at"))
    made = rows.withColumns({
        "issued_at": F.coalesce("issued_at", timeops.as_of_column(as_of)),
        "description": F.when(F.col("instructions") != "", F.concat("description", F.lit("\n\nInstructions: "), "instructions"))
        .otherwise(F.col("description")),
        "normalized_severity": F.lit("unknown"), "status": F.lit("pending"),
    }).drop("instructions", "issued_at_raw", "starts_at_raw", "expires_at_raw")
    return made.filter("NOT bad").drop("bad"), rows.filter("bad").drop("bad")


def _unescape(c: Column) -> Column:
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def _visible(html: Column) -> Column:
    """HTML without comments, scripts and styles."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def read_quake_table(docs: DataFrame, content: str = "content") -> DataFrame:
    """Rows of the first HTML table after its header: date, time, latitude,
    longitude, magnitude, depth, region. Broken rows and magnitudes below 2.9
    are dropped. The letters N/S/E/W are cut off without changing the sign."""
    table = F.regexp_extract(_visible(F.col(content)), r"(?is)<table\b[^>]*>(.*?)(?:</table|\z)", 1)
    trs = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr|<tr\b|\z)"), F.lit(1))
    rows = docs.select(*[c for c in docs.columns if c != content], F.posexplode(trs).alias("row_no", "tr")).filter("row_no > 0")
    tds = F.regexp_extract_all(F.col("tr"), F.lit(r"(?is)<td\b[^>]*>(.*?)(?=</td|<td\b|\z)"), F.lit(1))
    cell_text = F.transform(tds, lambda t: _strip(_unescape(F.regexp_replace(t, "<[^>]*>", ""))))
    rows = rows.withColumn("cells", cell_text).filter(F.size("cells") >= 7).drop("tr")
    cell = lambda i: F.get(F.col("cells"), i)
    number = lambda c, letters: F.trim(F.regexp_replace(c, f"[{letters}]", "")).try_cast("double")
    rows = rows.withColumns({
        "issued_at": F.try_to_timestamp(F.concat_ws(" ", cell(0), cell(1)), F.lit("dd/MM/yyyy HH:mm:ss")),
        "lat_text": cell(2), "lon_text": cell(3), "latitude": number(cell(2), "NS"), "longitude": number(cell(3), "EW"),
        "magnitude": cell(4).try_cast("double"), "depth": cell(5), "region": cell(6),
    }).drop("cells")
    return rows.filter("issued_at IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND magnitude >= 2.9")


def quake_to_alerts(rows: DataFrame) -> DataFrame:
    bare = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    mag = F.col("magnitude").cast("string")
    return rows.select(
        *[c for c in ("url", "doc_id", "source_id") if c in rows.columns],
        F.concat_ws("-", F.lit("EQ"), F.date_format("issued_at", "yyyyMMddHHmmss"), bare("lat_text"), bare("lon_text")).alias("source_alert_id"),
        F.concat(F.lit("M"), mag, F.lit(" Earthquake - "), "region").alias("title"),
        F.concat(F.lit("Earthquake of magnitude "), mag, F.lit(" detected at depth "), "depth", F.lit(" km. Epicenter: "), "region",
                 F.lit(" (Lat: "), "lat_text", F.lit(", Lon: "), "lon_text", F.lit(").")).alias("description"),
        F.lit("earthquake").alias("hazard_type"), F.lit(None).cast("string").alias("official_severity"),
        geo.magnitude_severity(F.col("magnitude")).alias("normalized_severity"), "issued_at",
        geo.magnitude_status(F.col("magnitude"), F.col("latitude"), F.col("longitude")).alias("status"),
        F.col("region").alias("raw_location"), "latitude", "longitude", F.lit("manual").alias("match_confidence"))


def extract_links(docs: DataFrame, base: str, suffixes: list[str], tag: str = "a", attribute: str = "href", n: int | None = None,
                  host: str | None = None, content: str = "html") -> DataFrame:
    """Distinct document links of a page, in page order, absolute; ``n`` keeps the first so many."""
    attr = rf"(?is)<{tag}\b[^>]*?\s{attribute}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"
    raw = F.regexp_extract_all(_visible(F.col(content)), F.lit(attr), F.lit(1))
    links = F.transform(raw, lambda u: _unescape(F.regexp_replace(u, "^[\"']|[\"']$", "")))
    wanted = lambda u: F.lit(False)
    def keep(u):
        ok = F.lit(False)
        for s in suffixes:
            ok = ok | u.endswith(s)
        return ok & u.contains(host) if host else ok
    def absolute(u):
        return (
            F.when(u.startswith("http"), u).when(u.startswith("//"), F.concat(F.lit(base), F.substr(u, F.lit(2))))
            .when(u.startswith("/"), F.concat(F.lit(base), u)).otherwise(F.concat(F.lit(base + "/"), u)))
    urls = F.array_distinct(F.transform(F.filter(links, keep), absolute))
    urls = urls if n is None else F.slice(urls, 1, n)
    return docs.select(*[c for c in docs.columns if c != content], F.posexplode(urls).alias("link_no", "link"))


def _summary(c: str, chars: int = K.DESCRIPTION_CHARS) -> Column:
    """The start of a text with a mark if more follows; the whole text stays in ``raw_text``."""
    return F.concat(F.substring(c, 1, chars), F.when(F.length(c) > chars, "...").otherwise(""))


def clean_bulletin_text(docs: DataFrame, content: str = "text", description_chars: int = K.DESCRIPTION_CHARS) -> DataFrame:
    """Extracted bulletin text (url, retrieved_at, text) to title, id, text."""
    t = F.regexp_replace(F.col(content), r"\r\n?", "\n")
    for pattern, new in ((r"(?U)(?<=\w)-\n(?=\w)", ""), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"(?U)^\s+|\s+$", "")):
        t = F.regexp_replace(t, pattern, new)
    rows = docs.withColumn("raw_text", t)
    letter = lambda x: F.col("raw_text").contains(f"BULLETIN No. {x}") | F.col("url").endswith(x)
    title = (
        F.when(letter("A"), "FFD River Discharge & Weather Bulletin A").when(letter("B"), "FFD Rainfall & Flood Forecast Bulletin B")
        .otherwise("Flood Forecasting Division Bulletin"))
    rows = rows.withColumn("title", title)
    return rows.withColumns({
        "source_alert_id": F.concat_ws("-", F.lit("FFD"), F.replace("title", F.lit(" "), F.lit("")), F.date_format("retrieved_at", "yyyy-MM-dd")),
        "description": _summary("raw_text", description_chars), "hazard_type": F.lit("flood"), "raw_location": F.lit("Pakistan"),
    })


def bulletin_to_alerts(cleaned: DataFrame) -> DataFrame:
    rows = B.structure_bulletins(cleaned, "raw_text", "url")
    return rows.withColumns({
        "normalized_severity": B.flood_severity(F.col("advisory.highest_reported_level")),
        "issued_at": F.col("retrieved_at"), "status": F.lit("active"), "source_url": F.col("url")})


def advisory_text_to_alerts(docs: DataFrame, content: str = "text", description_chars: int = K.DESCRIPTION_CHARS) -> DataFrame:
    """Advisory text (url, retrieved_at, text): later hazard words win."""
    rows = docs.withColumn("raw_text", F.trim(F.regexp_replace(content, r"(?U)\s+", " ")))
    up = F.upper("raw_text")
    says = lambda *words: text.any_word(up, list(words))
    hazard = (
        F.when(says("HEAT", "TEMPERATURE"), "heatwave").when(says("EARTHQUAKE", "SEISMIC"), "earthquake")
        .when(says("FLOOD"), "flood").when(says("RAIN", "MONSOON"), "weather").otherwise("other"))
    severity = F.when(says("EXTREME", "RED ALERT"), "extreme").when(says("HIGH", "SEVERE"), "high").otherwise("medium")
    file_name = F.replace(F.element_at(F.split("url", "/"), -1), F.lit(".pdf"), F.lit(""))
    rows = rows.withColumns({"hazard_type": hazard, "normalized_severity": severity})
    return rows.withColumns({
        "source_alert_id": F.concat(F.lit("NDMA-"), file_name),
        "title": F.concat(F.lit("NDMA "), F.initcap("hazard_type"), F.lit(" Advisory")),
        "description": _summary("raw_text", description_chars), "issued_at": F.col("retrieved_at"), "status": F.lit("active"),
        "raw_location": F.lit("Pakistan")})


# ---- registry of feeds ---------------------------------------------------------------
FEEDS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_feed(name: str, parse: Callable[[DataFrame], DataFrame],
                  normalize: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """A feed is two DataFrame functions: documents → items → alerts."""
    FEEDS[name] = lambda docs: normalize(parse(docs))


def run_feed(name: str, docs: DataFrame) -> DataFrame:
    return FEEDS[name](docs)


register_feed("PMDEarthquakeScraper", read_quake_table, quake_to_alerts)
register_feed("FFDBulletinScraper", clean_bulletin_text, bulletin_to_alerts)
register_feed("NDMAScraper", advisory_text_to_alerts)
register_feed("PMDWeatherScraper", read_cap, lambda items: cap_to_alerts(
    items, F.col("retrieved_at") if "retrieved_at" in items.columns else F.current_timestamp())[0])


# ---- sources ------------------------------------------------------------------------
def configured_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.SOURCE_ROWS, K.SOURCE_COLUMNS)


def seed_sources(configured: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing sources plus configured ones whose name is new."""
    new = configured.join(existing.select("name"), "name", "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
