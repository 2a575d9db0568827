"""Gazetteer build steps: hierarchy, aliases, the place dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertloom import constants as K
from alertloom.functions import text


def with_parents(gaz: DataFrame) -> DataFrame:
    """District, province and tehsil names of every entity."""
    names = gaz.select("numeric_id", "canonical_name")
    out = gaz
    for level in ("district", "province", "tehsil"):
        parent = names.select(F.col("numeric_id").alias(f"{level}_id"), F.col("canonical_name").alias(level))
        out = out.join(parent, f"{level}_id", "left")
    return out


def assign_hierarchy(records: DataFrame) -> DataFrame:
    """Parent ids from administrative codes a1, a2, a3 (null = absent).

    Of records with the same code the last in input order (``pos``) wins.
    """
    kind = F.col("entity_type")
    def level(types, codes, name):
        rows = records.filter(kind.isin(types))
        for c in codes:
            rows = rows.filter(F.col(c) != "")
        return rows.groupBy(*codes).agg(F.max_by("id", "pos").alias(name))

    admin1 = level(["PROVINCE", "TERRITORY"], ["a1"], "l1")
    admin2 = level(["DISTRICT", "DIVISION"], ["a1", "a2"], "l2")
    admin3 = level(["TEHSIL"], ["a1", "a2", "a3"], "l3")
    rows = records.join(admin1, ["a1"], "left").join(admin2, ["a1", "a2"], "left").join(admin3, ["a1", "a2", "a3"], "left")

    unit = kind.isin("DISTRICT", "DIVISION")
    tehsil = kind == "TEHSIL"
    place = kind.isin(K.POPULATED_TYPES)
    top = kind.isin("PROVINCE", "TERRITORY", "COUNTRY")
    orphan = tehsil & F.col("l2").isNull()
    return rows.withColumns({
        "province_id": F.col("l1"),
        "district_id": F.when(~unit, F.col("l2")),
        "tehsil_id": F.when(~tehsil, F.col("l3")),
        "parent_id": F.when(unit, F.col("l1"))
        .when(place, F.coalesce("l3", "l2", "l1"))
        .when(~top, F.coalesce("l2", "l1")),
        "hierarchy_exception": F.when(orphan, "GeoNames ADM3 record has no verifiable ADM2 parent")
        .when(place & F.col("l2").isNull(), "GeoNames source has no ADM2 code for this populated place"),
        "review_notes": F.when(orphan, "Excluded from TEHSIL matching until its district is verified"),
        "entity_type": F.when(orphan, "UNKNOWN").otherwise(kind),
    }).drop("l1", "l2", "l3")


def alternate_names(records: DataFrame, alt: DataFrame, longest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(alias rows, Urdu names). ``alt``: geonames_id, language, alternate_name,
    pos. ``longest`` leaves out longer aliases (off by default)."""
    joined = records.select("id", "geonames_id").join(alt, "geonames_id")
    size = F.length("alternate_name")
    lang = F.coalesce("language", F.lit(""))
    aliases = joined.filter(lang.isin("en", "ur", "") & (size > 1) & (size <= (longest or 2**31 - 1))).select(
        "id", F.col("alternate_name").alias("alias"), "pos")
    urdu = joined.filter((F.col("language") == "ur") & (F.col("alternate_name") != "")).groupBy("id").agg(
        F.min_by("alternate_name", "pos").alias("urdu_name"))
    return aliases, urdu


def curate_aliases(gaz: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified aliases for known cities; district names without the word
    District, the longer name becoming an alias. Returns (records, aliases)."""
    spark = gaz.sparkSession
    rows = [(name, alias) for name, extra in K.CURATED_ALIASES.items() for alias in extra]
    known = F.broadcast(spark.createDataFrame(rows, "canonical_name string, alias string"))  # fixed 10 rows
    extra = gaz.filter(F.col("entity_type").isin("CITY", "TOWN")).select("numeric_id", "canonical_name").join(known, "canonical_name").select("numeric_id", "alias")
    long_name = (F.col("entity_type") == "DISTRICT") & F.col("canonical_name").endswith(" District")
    old = gaz.filter(long_name).select("numeric_id", F.col("canonical_name").alias("alias"))
    short = F.trim(F.regexp_replace("canonical_name", " District$", ""))
    records = gaz.withColumn("canonical_name", F.when(long_name, short).otherwise(F.col("canonical_name")))
    return records, aliases.select("numeric_id", "alias").unionByName(extra).unionByName(old).distinct()


def build_aliases(gaz: DataFrame, aliases: DataFrame) -> DataFrame:
    """(pattern, numeric_id, method): 1 = canonical name, 2 = alias."""
    names = gaz.select("numeric_id", F.col("canonical_name").alias("name"), F.lit(1).alias("method")).unionByName(
        aliases.select("numeric_id", F.col("alias").alias("name"), F.lit(2).alias("method")))
    return (
        names.select(text.location_name(F.col("name")).alias("pattern"), "numeric_id", "method")
        .filter("pattern <> ''").groupBy("pattern", "numeric_id").agg(F.min("method").alias("method")))


def candidate_rank(entity_type: Column, population: Column, numeric_id: Column) -> Column:
    priority = F.coalesce(*[F.when(entity_type == t, p) for t, p in K.TYPE_PRIORITY.items()], F.lit(0))
    size = F.when(population.isNull() | (population == 0), F.lit(-1)).otherwise(population)
    return F.struct(priority.alias("p"), size.cast("bigint").alias("s"), (-numeric_id).alias("i"))


CONTEXTS = {
    "DISTRICT": ["DISTRICT"], "TEHSIL": ["TEHSIL"], "PROVINCE": ["PROVINCE", "TERRITORY"], "DIVISION": ["DIVISION"],
}


def dictionary(patterns: DataFrame, gaz: DataFrame) -> DataFrame:
    """One row per pattern: the chosen candidate without context and, per
    context class, the candidate of the asked type (else the general choice).

    Choosing here keeps every later text hit to one row, however many records
    share a name.
    """
    ent = gaz.select("numeric_id", "entity_type", "population")
    rows = patterns.join(ent, "numeric_id")
    rank = candidate_rank(F.col("entity_type"), F.col("population"), F.col("numeric_id"))
    pick = F.struct("numeric_id", "entity_type", "method")
    best = rows.groupBy("pattern").agg(
        F.max_by(pick, rank).alias("best"),
        *[F.max_by(pick, F.when(F.col("entity_type").isin(types), rank)).alias(name) for name, types in CONTEXTS.items()])
    return best.select("pattern", "best", *[F.coalesce(name, "best").alias(name) for name in CONTEXTS])


def candidates() -> Column:
    """Array of the dictionary's choices in the order of ``text.CONTEXT_TYPES``."""
    safe = lambda name: F.struct(
        F.col(name).getField("numeric_id").alias("numeric_id"), F.col(name).getField("entity_type").alias("entity_type"),
        F.col(name).getField("method").alias("method"),
        text.safe_for_text(F.col(name).getField("entity_type"), F.col("pattern")).alias("safe"))
    return F.array(*[safe(name) for name in ("best", *CONTEXTS)])


def lookup(names: DataFrame, words: DataFrame, column: str, preferred: str | None = None) -> DataFrame:
    """Exact normalised lookup of a name column; adds ``found`` (null = none)."""
    pick = words.select(F.col("pattern").alias("__key"), F.col(preferred or "best").alias("found"))
    return names.withColumn("__key", text.location_name(F.col(column))).join(pick, "__key", "left").drop("__key")


def district_top_city(gaz: DataFrame) -> DataFrame:
    """Per district its top city, or the district itself where it has none."""
    districts = gaz.filter("entity_type = 'DISTRICT'").select(
        F.col("numeric_id").alias("district_id"), F.lower("canonical_name").alias("d_name"),
        F.struct("numeric_id", "canonical_name", "entity_type", "latitude", "longitude").alias("itself"))
    cities = gaz.filter(F.col("entity_type").isin("CITY", "TOWN") & F.col("district_id").isNotNull())
    rank = F.struct(
        (F.lower("canonical_name") == F.coalesce("d_name", F.lit(""))).alias("same"), F.coalesce("population", F.lit(0)).alias("pop"),
        (F.col("entity_type") == "CITY").alias("city"), (-F.col("numeric_id")).alias("i"))
    top = cities.join(districts.select("district_id", "d_name"), "district_id", "left").groupBy("district_id").agg(
        F.max_by(F.struct("numeric_id", "canonical_name", "entity_type", "latitude", "longitude"), rank).alias("top"))
    return districts.join(top, "district_id", "full").select("district_id", F.coalesce("top", "itself").alias("top"))


def district_names(gaz: DataFrame) -> DataFrame:
    """(name key, district id); of equal names the highest id."""
    d = gaz.filter("entity_type = 'DISTRICT'")
    keys = d.select(text.location_name(F.col("canonical_name")).alias("d_key"), "numeric_id").unionByName(
        d.select(F.lower("canonical_name").alias("d_key"), "numeric_id"))
    return keys.groupBy("d_key").agg(F.max("numeric_id").alias("district_id"))
