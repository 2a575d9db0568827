"""One explained primary location per alert."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, functions as F

from alertloom import constants as K
from alertloom.functions import geo, text
from alertloom.operators import gazetteer as G, joins, mentions as M
from alertloom.operators.bulletins import level_rank
from alertloom.session import measured_broadcasts, write_and_read

FIELDS = ["district", "city", "province", "latitude", "longitude", "source", "confidence", "is_inferred", "label", "method"]


@dataclass
class Index:
    """Gazetteer tables the resolver joins with."""

    gaz: DataFrame
    words: DataFrame
    detail: DataFrame
    top: DataFrame
    district_names: DataFrame
    probe: M.Probe | None = None

    @classmethod
    def build(cls, gaz: DataFrame, aliases: DataFrame) -> "Index":
        detail = G.with_parents(gaz).select(
            "numeric_id", "entity_type", "canonical_name", "district", "province", "district_id",
            F.coalesce("population", F.lit(0)).alias("population"), "latitude", "longitude")
        words = G.dictionary(G.build_aliases(gaz, aliases), gaz)
        return cls(gaz, words, detail, G.district_top_city(gaz), G.district_names(gaz))

    def compiled(self) -> "Index":
        """The same tables written once to the shared folder, so that every
        scan reads a finished index instead of building it again."""
        with measured_broadcasts(self.gaz.sparkSession):
            made = {f.name: write_and_read(getattr(self, f.name), f"index-{f.name}") for f in fields(self) if f.name != "probe"}
            return Index(**made, probe=M.Probe.of(made["words"]))


def _result(district, city, province, pair, source, confidence, inferred, label, method) -> Column:
    s = lambda c, n: (c if isinstance(c, Column) else F.lit(c).cast("string")).alias(n)
    return F.struct(
        s(district, "district"), s(city, "city"), s(province, "province"), pair["lat"].alias("latitude"),
        pair["lng"].alias("longitude"), s(source, "source"), s(confidence, "confidence"),
        F.lit(inferred).alias("is_inferred"), s(label, "label"), s(method, "method"))


def _top_city_name(top: str = "top") -> Column:
    return F.when(F.col(f"{top}.entity_type").isin("CITY", "TOWN"), F.col(f"{top}.canonical_name"))


def _none() -> Column:
    return F.lit(None).cast("double")


def resolve_structured(structured: DataFrame, ix: Index) -> DataFrame:
    """First structured location that decides. ``structured``: id, pos,
    raw_location, city, district, province, latitude, longitude."""
    raw = F.trim(F.coalesce(*[text.filled(F.col(c)) for c in ("raw_location", "city", "district")], F.lit("")))
    keep = structured.select(
        "id", "pos", raw.alias("raw"), F.col("latitude").alias("loc_lat"), F.col("longitude").alias("loc_lng"),
        F.col("district").alias("loc_district"), F.col("city").alias("loc_city"), F.col("province").alias("loc_province"))
    ent = ix.detail.select(
        "numeric_id", "entity_type", "canonical_name", "district", "province",
        F.col("latitude").alias("e_lat"), F.col("longitude").alias("e_lng"))
    rows = (
        G.lookup(keep, ix.words, "raw").withColumn("numeric_id", F.col("found.numeric_id"))
        .join(ent, "numeric_id", "left").join(ix.top, F.col("numeric_id") == F.col("district_id"), "left"))
    kind = F.col("entity_type")
    own = F.col("loc_lat"), F.col("loc_lng")
    valid = geo.valid_country(*own)
    given = lambda method, province: _result(
        F.col("loc_district"), F.col("loc_city"), province, geo.checked_pair(*own, _none(), _none()),
        "STRUCTURED", "HIGH", False, "Source-provided", method)
    decided = (
        F.when(kind.isin(K.POPULATED_TYPES), _result(
            F.col("district"), F.col("canonical_name"), F.col("province"),
            geo.checked_pair(*own, F.col("e_lat"), F.col("e_lng")),
            "STRUCTURED", "HIGH", False, "Source-provided", "STRUCTURED_SCRAPER_CITY"))
        .when(kind == "DISTRICT", _result(
            F.col("canonical_name"), _top_city_name(), F.col("province"),
            geo.checked_pair(*own, F.col("top.latitude"), F.col("top.longitude")),
            "STRUCTURED", "HIGH", False, "Source-provided", "STRUCTURED_SCRAPER_DISTRICT"))
        .when(kind.isin("PROVINCE", "TERRITORY") & valid, given("STRUCTURED_SCRAPER_PROVINCE_WITH_COORDS", F.col("canonical_name")))
        .when(valid, given("STRUCTURED_SCRAPER_EXPLICIT_COORDS", F.col("loc_province"))))
    rows = rows.withColumn("decided", decided).filter("decided IS NOT NULL")
    return rows.groupBy("id").agg(F.min_by("decided", "pos").alias("p")).select("id", "p.*")


def _hits(texts: DataFrame, ix: Index) -> DataFrame:
    return M.scan_each_once(texts, ix.words, ["id"], ix.probe, ix.detail)


ENTITY = ["numeric_id", "entity_type", "canonical_name", "district", "province", "district_id", "population", "latitude", "longitude"]


def resolve_title(alerts: DataFrame, ix: Index, label: str = "TITLE") -> DataFrame:
    hits = _hits(alerts.select("id", F.col("title").alias("text")), ix)
    e = F.struct(*ENTITY)
    kind, start = F.col("entity_type"), F.col("start")
    city = kind.isin("CITY", "TOWN", "LOCALITY")
    best = hits.groupBy("id").agg(
        F.max_by(e, F.when(city, F.struct((kind == "CITY").alias("c"), F.col("population").alias("p"), (-start).alias("s")))).alias("city"),
        F.min_by(e, F.when(kind == "TEHSIL", start)).alias("tehsil"),
        F.max_by(e, F.when(kind == "DISTRICT", F.struct(F.col("population").alias("p"), (-start).alias("s")))).alias("dist"),
        F.min_by("canonical_name", F.when(kind == "DISTRICT", start)).alias("first_district"))
    key = F.when(F.col("tehsil").isNotNull(), F.col("tehsil.district_id")).otherwise(F.col("dist.numeric_id"))
    rows = best.withColumn("district_id", key).join(ix.top, "district_id", "left")
    top_or = lambda other, field: F.when(F.col("top").isNotNull(), F.col(f"top.{field}")).otherwise(F.col(f"{other}.{field}"))
    made = lambda d, c, p, lat, lng, m: _result(
        d, c, p, geo.checked_pair(lat, lng, _none(), _none()),
        "TITLE_EXTRACTION" if label == "TITLE" else "DESCRIPTION_EXTRACTION", "HIGH", True,
        f"Extracted from {label.lower()}", f"{label}_EXPLICIT_{m}")
    p = (
        F.when(F.col("city").isNotNull(), made(
            F.coalesce(text.filled(F.col("city.district")), "first_district"), F.col("city.canonical_name"), F.col("city.province"),
            F.col("city.latitude"), F.col("city.longitude"), "CITY"))
        .when(F.col("tehsil").isNotNull(), made(
            F.col("tehsil.district"), top_or("tehsil", "canonical_name"), F.col("tehsil.province"),
            top_or("tehsil", "latitude"), top_or("tehsil", "longitude"), "TEHSIL"))
        .when(F.col("dist").isNotNull(), made(
            F.col("dist.canonical_name"), _top_city_name(), F.col("dist.province"),
            top_or("dist", "latitude"), top_or("dist", "longitude"), "DISTRICT")))
    return rows.select("id", p.alias("p")).filter("p IS NOT NULL").select("id", "p.*")


def body(alerts: DataFrame) -> DataFrame:
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    return alerts.select("id", F.trim(F.concat(part("description"), F.lit("\n"), part("raw_text"))).alias("text"))


def district_candidates(hits: DataFrame, ix: Index) -> DataFrame:
    """Per alert and district: mentions, mentioned cities and tehsils, best
    city, first position. Counts instead of lists: nothing is gathered."""
    kind = F.col("entity_type")
    city = kind.isin("CITY", "TOWN", "LOCALITY")
    target = F.when(kind == "DISTRICT", F.col("numeric_id")).when(city | (kind == "TEHSIL"), F.col("district_id"))
    is_district = ix.gaz.filter("entity_type = 'DISTRICT'").select(F.col("numeric_id").alias("cand_id"))
    rank = F.struct((kind == "CITY").alias("c"), F.col("population").alias("p"), (-F.col("start")).alias("s"))
    return (
        hits.withColumn("cand_id", target).filter("cand_id IS NOT NULL").join(is_district, "cand_id", "left_semi")
        .groupBy("id", "cand_id").agg(
            F.count("*").alias("mention_count"), F.count_if(city).alias("city_count"),
            F.count_if(kind == "TEHSIL").alias("tehsil_count"),
            F.max_by(F.struct("canonical_name", "latitude", "longitude"), F.when(city, rank)).alias("best_city"),
            F.min("start").alias("first_start")))


def station_ranks(conditions: DataFrame, ix: Index) -> DataFrame:
    """Highest level rank (1..5) per alert and district of its stations."""
    st = F.broadcast(joins.station_districts(conditions.sparkSession))  # fixed 26 rows
    names = ix.district_names
    rows = conditions.select("id", F.lower("station").alias("station"), level_rank(F.col("level"), 0).alias("rank")).filter("rank > 0")
    return (
        rows.join(st, "station").withColumn("d_key", text.location_name(F.col("district"))).join(names, "d_key")
        .groupBy("id", F.col("district_id").alias("cand_id")).agg(F.max("rank").alias("severity_rank")))


def winning_district(candidates: DataFrame, ranks: DataFrame, ix: Index) -> DataFrame:
    """City first, then river severity, mentions, shorter name, name descending."""
    d = ix.detail.filter("entity_type = 'DISTRICT'").select(
        F.col("numeric_id").alias("cand_id"), F.col("canonical_name").alias("d_name"), F.col("province").alias("d_province"),
        F.col("latitude").alias("d_lat"), F.col("longitude").alias("d_lng"))
    rows = candidates.join(ranks, ["id", "cand_id"], "left").join(d, "cand_id")
    order = F.struct(
        (F.col("city_count") > 0).alias("a"), F.coalesce("severity_rank", F.lit(0)).alias("b"), F.col("mention_count").alias("c"),
        (-F.length("d_name")).alias("d"), F.col("d_name").alias("e"), (-F.col("first_start")).alias("f"))
    win = F.struct("cand_id", "d_name", "d_province", "d_lat", "d_lng", "best_city", "mention_count", "city_count",
                   F.coalesce("severity_rank", F.lit(0)).alias("severity_rank"))
    return rows.groupBy("id").agg(F.max_by(win, order).alias("w")).select("id", "w.*")


def resolve_description(alerts: DataFrame, conditions: DataFrame, ix: Index) -> DataFrame:
    hits = _hits(body(alerts), ix)
    winner = winning_district(district_candidates(hits, ix), station_ranks(conditions, ix), ix)
    rows = winner.join(ix.top, winner["cand_id"] == ix.top["district_id"], "left")
    bc = F.col("best_city")
    p = F.when(bc.isNotNull(), _result(
        F.col("d_name"), F.col("best_city.canonical_name"), F.col("d_province"),
        geo.checked_pair(F.col("best_city.latitude"), F.col("best_city.longitude"), _none(), _none()),
        "DESCRIPTION_EXTRACTION", "MEDIUM", True, "Extracted from description", "DESCRIPTION_EXPLICIT_CITY")
    ).otherwise(_result(
        F.col("d_name"), _top_city_name(), F.col("d_province"),
        geo.checked_pair(F.col("top.latitude"), F.col("top.longitude"), _none(), _none()),
        "DISTRICT_POPULATION_FALLBACK", "MEDIUM", True, "District population fallback", "DESCRIPTION_DISTRICT_TOP_CITY"))
    return rows.select("id", p.alias("p")).select("id", "p.*")


def river_candidates(alerts: DataFrame, conditions: DataFrame, districts_per_river: int = 2) -> DataFrame:
    """(id, rank, kind, district, matched, phase, place): structured rows, then
    stations found in the text (as plain substrings), then named rivers, each
    with the first ``districts_per_river`` of its districts."""
    cols = ["id", "rank", "kind", "district", "matched", "phase", "place"]
    structured = joins.map_conditions(conditions).withColumns({
        "rank": level_rank(F.col("level"), 1), "phase": F.lit(0),
        "place": F.coalesce(F.col("pos"), F.lit(0)) + (F.col("cond_pos") * 100 if "cond_pos" in conditions.columns else 0)})
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    low = F.lower(F.concat(part("description"), F.lit("\n"), part("raw_text")))
    item = lambda kind, d, m, phase, place: F.struct(
        F.lit(1).alias("rank"), F.lit(kind).alias("kind"), F.lit(d).alias("district"), F.lit(m).alias("matched"),
        F.lit(phase).alias("phase"), F.lit(place).alias("place"))
    stations = [F.when(F.col("low").contains(s), item(2, d, s, 1, i)) for i, (s, d) in enumerate(K.STATION_DISTRICT.items())]
    rivers = [
        F.when(F.col("low").contains(f"river {r}") | F.col("low").contains(f"{r} river"), item(1, d, r, 2, i * 10 + j))
        for i, (r, names) in enumerate(K.RIVER_DISTRICTS.items()) for j, d in enumerate(names[:districts_per_river])]
    found = alerts.select("id", low.alias("low")).select(
        "id", F.explode(F.array_compact(F.array(*stations, *rivers))).alias("c")).select("id", "c.*")
    return structured.select(*cols).unionByName(found.select(*cols))


def best_river_candidate(candidates: DataFrame) -> DataFrame:
    order = F.struct(
        "rank", "kind", (-F.length("district")).alias("n"), "district", (-F.col("phase")).alias("ph"), (-F.col("place")).alias("pl"))
    return candidates.groupBy("id").agg(F.max_by(F.struct("kind", "district", "matched"), order).alias("c")).select("id", "c.*")


def resolve_river(alerts: DataFrame, conditions: DataFrame, ix: Index) -> DataFrame:
    best = best_river_candidate(river_candidates(alerts, conditions)).withColumn("d_key", text.location_name(F.col("district")))
    by_word = ix.words.select(
        F.col("pattern").alias("d_key"), F.when(F.col("DISTRICT.entity_type") == "DISTRICT", F.col("DISTRICT.numeric_id")).alias("word_id"))
    found = best.join(ix.district_names, "d_key", "left").join(by_word, "d_key", "left").select(
        "id", "kind", "matched", F.coalesce("district_id", "word_id").alias("numeric_id"))
    d = ix.detail.select("numeric_id", "canonical_name", "province")
    rows = found.join(d, "numeric_id").join(ix.top, F.col("numeric_id") == F.col("district_id"), "left")
    p = _result(
        F.col("canonical_name"), _top_city_name(), F.col("province"),
        geo.checked_pair(F.col("top.latitude"), F.col("top.longitude"), _none(), _none()), "RIVER_MAPPING",
        F.when(F.col("kind") == 2, "MEDIUM").otherwise("LOW"), True, "Derived from river / barrage mapping",
        F.concat(F.lit("RIVER_STATION_MAPPING:"), "matched"))
    return rows.select("id", p.alias("p")).select("id", "p.*")


def primary_location(alerts: DataFrame, structured: DataFrame, conditions: DataFrame, ix: Index) -> DataFrame:
    """Structured > title > description > river > unresolved, never a default."""
    steps = [
        resolve_structured(structured, ix), resolve_title(alerts, ix),
        resolve_description(alerts, conditions, ix), resolve_river(alerts, conditions, ix)]
    out = alerts.select("id")
    for i, step in enumerate(steps):
        out = out.join(step.select("id", F.struct(*FIELDS).alias(f"s{i}")), "id", "left")
    none = F.lit(None).cast("string")
    unresolved = _result(none, none, none, geo.checked_pair(_none(), _none(), _none(), _none()), "UNRESOLVED", "LOW",
                         False, "Unresolved location", "NO_DETERMINISTIC_MATCH")
    return out.select("id", F.coalesce("s0", "s1", "s2", "s3", unresolved).alias("p")).select("id", "p.*")
