"""Gazetteer files: GeoNames dumps in, partitioned records out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom import constants as K
from alertloom.functions import geo, text


def read_geonames(spark: SparkSession, path: str, country: str = "PK", alias_chars: int | None = None, aliases: int | None = None) -> DataFrame:
    """Tab-separated dump lines with 19 or more columns to typed records.

    ``alias_chars`` leaves out longer alternate names, ``aliases`` keeps so
    many of a record; both are off by default.
    """
    cols = F.split("value", "\t")
    lines = spark.read.text(path).withColumn("c", cols).filter(F.size("c") >= 19)
    at = lambda i: F.get(F.col("c"), i)
    number = lambda i: text.filled(at(i)).try_cast("double")
    rows = lines.select(
        at(0).try_cast("bigint").alias("geonames_id"), at(1).alias("original_name"), at(2).alias("ascii_name"), at(3).alias("alternates"),
        number(4).alias("lat"), number(5).alias("lng"), at(6).alias("feature_class"), at(7).alias("feature_code"), at(8).alias("country"),
        *[text.filled(at(10 + i)).alias(f"a{i + 1}") for i in range(4)],
        F.coalesce(text.filled(at(14)).try_cast("bigint"), F.lit(0)).alias("population"),
    ).filter(F.col("country") == country)
    rows = rows.withColumn("entity_type", text.geonames_type(
        F.col("feature_class"), F.col("feature_code"), F.col("original_name"), F.col("population"))).filter("entity_type IS NOT NULL")
    renamed = F.coalesce(*[F.when(F.col("original_name") == old, new) for old, new in K.ADM1_NAMES.items()], F.col("original_name"))
    name = F.when(F.col("feature_code") == "ADM1", renamed).otherwise(F.col("original_name"))
    rows = rows.withColumn("n", name)
    short = F.trim(F.regexp_replace("n", " District$", ""))
    rows = rows.withColumn("canonical_name", F.when(
        (F.col("entity_type") == "DISTRICT") & F.col("n").endswith(" District"), short).otherwise(F.col("n")))
    other = lambda a, b: F.col(a) != F.col(b)
    own = F.array_compact(F.array(
        F.when(other("original_name", "canonical_name"), F.col("original_name")),
        F.when((F.col("ascii_name") != "") & other("ascii_name", "canonical_name") & other("ascii_name", "original_name"), F.col("ascii_name"))))
    more = F.filter(F.split("alternates", ","), lambda a: (a != "") & (F.length(a) <= (alias_chars or 2**31 - 1)))
    box = K.GAZETTEER_BOX
    inside = F.col("lat").between(box[0], box[1]) & F.col("lng").between(box[2], box[3])
    bad = F.col("lat").isNotNull() & ~F.coalesce(inside, F.lit(False))
    return rows.select(
        F.concat(F.lit("geonames_"), F.col("geonames_id").cast("string")).alias("id"), "geonames_id", "canonical_name",
        text.location_name(F.col("canonical_name")).alias("normalized_name"), "entity_type",
        F.when(~bad, F.col("lat")).alias("latitude"), F.when(~bad, F.col("lng")).alias("longitude"),
        (F.slice(F.concat(own, more), 1, aliases) if aliases else F.concat(own, more)).alias("aliases"), F.when(F.col("population") != 0, F.col("population")).alias("population"),
        "a1", "a2", "a3", "a4", "feature_code",
        F.when(bad, "coordinate failed the plausibility check").alias("review_notes"))


def with_group(records: DataFrame) -> DataFrame:
    return records.withColumn("group", F.when(
        F.col("entity_type") == "VILLAGE", F.concat(F.lit("villages_"), F.coalesce(F.col("province_id").cast("string"), F.lit("unresolved")))
    ).otherwise("administrative_places_features"))


def write_gazetteer(records: DataFrame, folder: str) -> DataFrame:
    """Write records partitioned by group; returns the manifest (group, count).

    Rows of one group spread over many tasks, so a large group is many files.
    """
    grouped = with_group(records)
    grouped.write.mode("overwrite").partitionBy("group").json(f"{folder}/records")
    manifest = records.sparkSession.read.json(f"{folder}/records").groupBy("group").agg(F.count("*").alias("record_count"))
    return manifest


def read_gazetteer_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{folder}/records")
