"""Validation of alerts and of the gazetteer; source health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from alertloom import constants as K
from alertloom.functions import text
from alertloom.operators.chunked import BEFORE, UP_TO
from alertloom.operators.identity import text_list
from alertloom.session import write_and_read


def validate_alerts(df: DataFrame, has_location: str = "has_location") -> DataFrame:
    """Adds ``validation_errors`` (JSON text or null) and the resulting status."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    story = F.lower(F.concat_ws(" ", text.py_text(F.col("title")), text.py_text(F.col("description"))))
    national = story.contains("nationwide") | story.contains("across the country")
    rules = [
        (F.coalesce(F.col("source_id"), F.lit(0)) == 0, "Missing source_id"),
        (blank("title"), "Missing or empty title"),
        (F.col("issued_at").isNull(), "Missing issue time (issued_at)"),
        (empty("source_url"), "Missing source_url"),
        (~F.col(has_location) & ~national, "No affected locations identified"),
        (empty("description") & empty("title"), "Missing meaningful description or title"),
    ]
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(message)) for bad, message in rules]))
    bad = F.size(errors) > 0
    state = F.coalesce("status", F.lit(""))
    return df.withColumns({
        "validation_errors": F.when(bad, text_list(errors)),
        "status": F.when(bad, "incomplete").when(state.isin("", "active", "draft"), "pending").otherwise(F.col("status")),
    })


def parsing_status(docs: DataFrame, parsed_ok: Column, error: Column) -> DataFrame:
    """success also for zero parsed rows; failed with the error text otherwise."""
    return docs.withColumns({
        "parsing_status": F.when(parsed_ok, "success").otherwise("failed"),
        "parsing_error": F.when(~parsed_ok, error),
    })


def quarantine(df: DataFrame, bad: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with a reason); the batch goes on."""
    is_bad = F.coalesce(bad, F.lit(True))
    return df.filter(~is_bad), df.filter(is_bad).withColumn("reject_reason", reason)


PARENTS = ["parent_id", "province_id", "division_id", "district_id", "tehsil_id"]


def validate_gazetteer(records: DataFrame) -> DataFrame:
    """(id, error) rows. ``records.pos`` is the input order.

    Of rows with the same id the first counts and the others are errors.
    """
    first = records.filter("id IS NOT NULL").groupBy("id").agg(F.min("pos").alias("first_pos"))
    marked = records.join(first, "id", "left")
    is_first = F.col("pos") == F.col("first_pos")
    lost = marked.filter(~F.coalesce(is_first, F.lit(False))).select("id", F.lit("missing or duplicate id").alias("error"))
    kept = marked.filter(is_first)

    lat, lng = F.col("latitude"), F.col("longitude")
    box = K.GAZETTEER_BOX
    outside = ~F.coalesce(lat.between(box[0], box[1]) & lng.between(box[2], box[3]), F.lit(False))
    absent = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    kind = F.col("entity_type")
    row_rules = [
        (~F.coalesce(kind.isin(K.ENTITY_TYPES), F.lit(False)), "invalid explicit type"),
        (absent("canonical_name") | absent("normalized_name"), "missing canonical or normalized name"),
        (lat.isNull() != lng.isNull(), "incomplete coordinate pair"),
        (lat.isNotNull() & outside, "implausible coordinates"),
        (F.col("population") < 0, "negative population"),
        ((kind == "DISTRICT") & F.col("province_id").isNull(), "district has no province/territory"),
        ((kind == "TEHSIL") & F.col("district_id").isNull(), "tehsil has no district"),
        ((kind == "CITY") & F.col("district_id").isNull() & F.col("hierarchy_exception").isNull(),
         "city has no district or documented exception"),
    ]
    by_row = kept.select("id", F.explode(F.array_compact(F.array(
        *[F.when(bad, F.lit(message)) for bad, message in row_rules]))).alias("error"))

    refs = kept.select("id", F.explode(F.array(*[
        F.struct(F.lit(p).alias("field"), F.col(p).alias("ref")) for p in PARENTS])).alias("r")).select("id", "r.*")
    known = kept.select(F.col("id").alias("ref"))
    dangling = refs.filter("ref IS NOT NULL").join(known, "ref", "left_anti").select(
        "id", F.concat(F.col("field"), F.lit(" references missing record")).alias("error"))

    loops = circular(kept.select("id", "parent_id")).select("id", F.lit("circular parent relationship").alias("error"))
    return reduce(DataFrame.unionByName, [lost, by_row, dangling, loops])


def circular(links: DataFrame) -> DataFrame:
    """Ids whose parent walk never ends.

    Every round doubles the length of all walks and drops those that end on
    the way. While a finite walk is left, so is one of every smaller length, so
    each round ends at least one; an unchanged count means that only loops
    remain. Rounds = log2 of the depth of the hierarchy.
    """
    walks = write_and_read(links.filter("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("at")), "gazetteer-walks")
    alive = walks.count()
    while alive:
        onward = walks.select(F.col("id").alias("at"), F.col("at").alias("next"))
        walks = write_and_read(walks.join(onward, "at").select("id", F.col("next").alias("at")), "gazetteer-walks")
        left = walks.count()
        if left == alive:
            break
        alive = left
    return walks.select("id")


def consecutive_failures(polls: DataFrame, chunk: Column) -> DataFrame:
    """Per poll: failures since the last success and the health flag.

    The flag turns unhealthy at three failures, healthy on success, and keeps
    its value at one or two failures (so it stays what the last success or
    third failure made it). Exact for hot sources: runs are cut into chunks.
    """
    keys, order = ["source_id"], ["checked_at", "event_id"]
    rows = polls.withColumn("__chunk", chunk)
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(*UP_TO)
    rows = rows.withColumn("__fails", F.sum((~F.col("ok")).cast("bigint")).over(inside))
    rows = rows.withColumn("__at_ok", F.last(F.when(F.col("ok"), F.col("__fails")), ignorenulls=True).over(inside))
    rows = rows.withColumn("__run", F.col("__fails") - F.coalesce("__at_ok", F.lit(0)))

    # Per chunk: the run it ends with, and whether a success cut it. A chunk
    # starts with the ending runs since the last chunk that had a success.
    across = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(*BEFORE)
    ends = rows.groupBy(*keys, "__chunk").agg(
        F.max_by("__run", F.struct(*order)).alias("__end"), F.bool_or("ok").alias("__cut"))
    ends = ends.withColumn("__sum", F.coalesce(F.sum("__end").over(across), F.lit(0)))
    ends = ends.withColumn("__base", F.last(F.when(F.col("__cut"), F.col("__sum")), ignorenulls=True).over(across))
    carried = ends.select(*keys, "__chunk", (F.col("__sum") - F.coalesce("__base", F.lit(0))).alias("__carry"))

    run = (
        F.when(F.col("ok"), 0).when(F.col("__at_ok").isNotNull(), F.col("__run"))
        .otherwise(F.col("__run") + F.col("__carry")))
    out = rows.join(carried, [*keys, "__chunk"]).select(*polls.columns, run.cast("bigint").alias("consecutive_failures"))
    return out.withColumn("health_status", F.when(
        F.col("consecutive_failures") >= K.UNHEALTHY_AFTER, "unhealthy").otherwise("healthy"))


def source_health(polls: DataFrame) -> DataFrame:
    """State per source after all polls, by two plain aggregations."""
    at = F.struct("checked_at", "event_id")
    good = polls.filter("ok").groupBy("source_id").agg(F.max(at).alias("good_at"), F.max("checked_at").alias("last_success_at"))
    since = polls.join(good, "source_id", "left").filter(F.col("good_at").isNull() | (at >= F.col("good_at")))
    return since.groupBy("source_id").agg(
        F.count_if(~F.col("ok")).alias("consecutive_failures"), F.max("checked_at").alias("last_checked_at"),
        F.max("last_success_at").alias("last_success_at"),
    ).withColumn("health_status", F.when(F.col("consecutive_failures") >= K.UNHEALTHY_AFTER, "unhealthy").otherwise("healthy"))
