"""Versioned upsert: matching, classification, revisions, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertloom import constants as K
from alertloom.functions.text import filled
from alertloom.operators.chunked import carry_forward
from alertloom.session import write_and_read

CONTENT = [
    "title", "description", "hazard_type", "official_severity", "normalized_severity", "issued_at", "starts_at",
    "expires_at", "effective_event_at", "status", "raw_text", "content_hash", "validation_errors",
]
SIDE = ["structured_advisory", "cache_key"]
IDENTITY = ["source_id", "source_alert_id", "source_url", "created_at"]
CLASSIFIED_BY = ["seq", "content_hash", "cache_key", "structured_advisory", "description", "normalized_severity", "expires_at"]
CHUNK_ROWS = 1_000_000


def _key(kind: str, *parts: str) -> Column:
    return F.concat_ws("\u0001", F.lit(kind), *[F.col(p).cast("string") for p in parts])


SLOT = ["source_id", "title", "issued_at"]


def own_key() -> Column:
    """The key of an alert by its source's own id; null without one."""
    return F.when(filled(F.col("source_alert_id")).isNotNull(), _key("id", "source_id", "source_alert_id"))


def slot_key() -> Column:
    """The key by source, title and time of issue; null where title or time are."""
    return F.when(F.col("title").isNotNull() & F.col("issued_at").isNotNull(), _key("title", *SLOT))


def row_key() -> Column:
    return _key("row", "seq")


def stable_id(key: Column) -> Column:
    """A positive id that depends on the key alone: 60 bits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")


def stored_key() -> Column:
    """The key of a stored alert: its own, that by title, or else its id."""
    return F.coalesce(own_key(), _key("title", *SLOT), F.concat_ws("\u0001", F.lit("stored"), F.col("id")))


def arrival_keys(batch: DataFrame, current: DataFrame) -> DataFrame:
    """Adds ``match_key``.

    Rows with a source id match by it. Rows without match (source, title,
    issue time) against every stored alert of the source, also those with an
    id, or an earlier row of the batch; null title or time matches nothing.
    """
    own = batch.withColumn("match_key", own_key())
    if not own.agg(F.bool_or(F.col("match_key").isNull())).head()[0]:
        return own  # every row has a source id: nothing to look up
    by_slot = current.withColumn("s_key", stored_key()).groupBy(*SLOT).agg(F.min_by("s_key", "id").alias("slot_key"))
    in_batch = own.filter("match_key IS NOT NULL").groupBy(*SLOT).agg(
        F.min_by("match_key", "seq").alias("batch_key"), F.min("seq").alias("batch_seq"))
    without = (
        own.filter("match_key IS NULL").join(by_slot, SLOT, "left").join(in_batch, SLOT, "left")
        .withColumn("match_key", F.coalesce(
            "slot_key", F.when(F.col("batch_seq") < F.col("seq"), F.col("batch_key")),
            slot_key(), row_key())))
    return own.filter("match_key IS NOT NULL").unionByName(without.select(*own.columns))


def match_keys(batch: DataFrame, current: DataFrame) -> DataFrame:
    """Adds ``match_key`` and ``stored_id`` (null for unknown alerts)."""
    by_key = current.groupBy(stored_key().alias("match_key")).agg(F.min("id").alias("stored_id"))
    return arrival_keys(batch, current).join(by_key, "match_key", "left")


def _chained(rows: DataFrame, chunk: Column | None) -> DataFrame:
    """Adds what stood before each row of its chain: ``prev``, ``stored`` and ``stored_id``."""
    order = ["is_row", "seq"]
    rows = carry_forward(rows, ["match_key"], order, chunk, {
        "prev": F.struct("content_hash", "cache_key", "structured_advisory")})
    accepted = ~F.col("is_row") | F.col("prev").isNull() | (F.col("prev.content_hash") != F.col("content_hash"))
    return carry_forward(rows, ["match_key"], order, chunk, {
        "stored": F.when(accepted, F.struct("description", "normalized_severity", "expires_at")),
        "stored_id": F.col("seed_id")})


def classify(batch: DataFrame, current: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per incoming row: ``action``, ``revised``, ``changed_fields``,
    ``previous_hash``, ``alert_id``.

    ``batch.seq`` (non-negative, unique) orders arrivals. A new alert's id
    depends on its match key alone, so it is the same however arrivals are cut
    into batches; should two keys ever share one, the job stops. After any outcome the
    stored hash, cache key and advisory equal the incoming ones, so the previous
    row of the chain decides; the stored description however changes only when
    content was accepted, so that one is carried from the last accepted row.

    Stored alerts head the chains of their keys, so one shuffle by key does for
    all; of several under one key that of the smallest id comes last. Only keys
    of more than ``chunk_rows`` arrivals are cut into chunks.
    """
    keyed = arrival_keys(batch, current).select("match_key", *CLASSIFIED_BY)
    keys = write_and_read(keyed.groupBy("match_key").agg(F.count(F.lit(1)).alias("n")), "upsert-keys")
    known = current.select(stored_key().alias("match_key"))
    unknown = keys.join(known, "match_key", "left_anti").select(stable_id(F.col("match_key")).alias("id"))
    shared = unknown.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id").unionByName(
        unknown.join(current.select("id"), "id", "left_semi")).head(1)
    if shared:
        raise ValueError(f"two alerts would share the id {shared[0]['id']}")

    seeds = current.withColumns({"match_key": stored_key(), "seq": -1 - F.col("id").cast("bigint")}).select(
        "match_key", *CLASSIFIED_BY, F.lit(False).alias("is_row"), F.col("id").cast("bigint").alias("seed_id"))
    rows = keyed.withColumns({"is_row": F.lit(True), "seed_id": F.lit(None).cast("bigint")}).unionByName(seeds)
    hot = keys.filter(F.col("n") > chunk_rows).select("match_key")
    if hot.isEmpty():
        rows = _chained(rows, None)
    else:
        hot = F.broadcast(hot)  # one key per chunk of arrivals at most
        chunk = F.when(F.col("is_row"), F.floor(F.col("seq") / chunk_rows)).otherwise(F.lit(-1))
        # Narrow rows, written once: the two passes over them read them several times.
        chunked = write_and_read(rows.join(hot, "match_key", "left_semi"), "upsert-rows")
        rows = _chained(rows.join(hot, "match_key", "left_anti"), None).unionByName(_chained(chunked, chunk))

    fresh = F.col("prev").isNull()
    same_hash = F.col("prev.content_hash") == F.col("content_hash")
    same_advisory = F.col("prev.structured_advisory").eqNullSafe(F.col("structured_advisory"))
    same_cache = F.coalesce(F.col("prev.cache_key") == F.col("cache_key"), F.lit(False))
    action = (
        F.when(fresh, "created").when(same_hash & same_cache & same_advisory, "ignored").otherwise("updated"))
    differs = lambda name, a, b: F.when(~a.eqNullSafe(b), F.lit(name))
    fields = F.array_compact(F.array(
        differs("description", F.col("stored.description"), F.col("description")),
        differs("severity", F.col("stored.normalized_severity"), F.col("normalized_severity")),
        differs("expires_at", F.col("stored.expires_at"), F.col("expires_at")),
        F.when(~same_advisory, F.lit("structured_advisory"))))
    out = rows.filter("is_row").withColumns({
        "action": action, "revised": ~fresh & ~same_hash,
        "previous_hash": F.col("prev.content_hash"), "alert_id": F.coalesce("stored_id", stable_id(F.col("match_key")))})
    changed = F.when(F.col("revised"), F.when(F.size(fields) > 0, fields).otherwise(F.array(F.lit("locations_or_minor"))))
    return out.withColumn("changed_fields", changed).select(
        "seq", "match_key", "alert_id", "action", "revised", "previous_hash", "content_hash", "changed_fields")


def text_list(items: Column) -> Column:
    """An array of plain words as JSON text with ', ' between the items."""
    return F.concat(F.lit('["'), F.array_join(items, '", "'), F.lit('"]'))


def revisions(classified: DataFrame, raw_document_id: Column | None = None) -> DataFrame:
    doc = (raw_document_id if raw_document_id is not None else F.lit(None)).cast("bigint")
    return classified.filter("revised").select(
        "alert_id", "seq", text_list(F.col("changed_fields")).alias("changed_fields"),
        F.col("previous_hash").alias("previous_content_hash"), F.col("content_hash").alias("new_content_hash"),
        doc.alias("raw_document_id"))


def change_set(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col("action").isin("created", "updated"))


def _present(columns: list[str], df: DataFrame) -> list[str]:
    return [c for c in columns if c in df.columns]


def apply_upsert(current: DataFrame, batch: DataFrame, classified: DataFrame) -> DataFrame:
    """The next snapshot: last accepted content per alert, last advisory and
    cache key, identity of the first row; untouched alerts stay as they are.
    Which arrivals these are is found on numbers, so only they are grouped whole."""
    content, side, ident = (_present(c, current) for c in (CONTENT, SIDE, IDENTITY))
    created = F.col("action") == "created"
    deciding = change_set(classified).groupBy("alert_id").agg(
        F.max(F.when(created | F.col("revised"), F.col("seq"))).alias("wrote"), F.max("seq").alias("last"),
        F.max(F.when(created, F.col("seq"))).alias("first"))
    seqs = F.explode(F.array_distinct(F.array_compact(F.array("wrote", "last", "first")))).alias("seq")
    done = deciding.select("alert_id", "wrote", "last", "first", seqs).join(batch, "seq")
    row_at = lambda names, at: F.max_by(F.struct(*names), F.when(F.col("seq") == F.col(at), F.col("seq")))
    latest = done.groupBy("alert_id").agg(
        row_at(content, "wrote").alias("content"), row_at(side, "last").alias("side"), row_at(ident, "first").alias("ident"))
    both = current.join(latest, current["id"] == latest["alert_id"], "full")
    pick = lambda group, names: [
        F.when(F.col(group).isNotNull(), F.col(f"{group}.{n}")).otherwise(current[n]).alias(n) for n in names]
    return both.select(
        F.coalesce(current["id"], "alert_id").alias("id"), *pick("ident", ident), *pick("content", content), *pick("side", side))


def replace_children(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Old child rows of untouched alerts plus the new rows of touched ones."""
    ids = touched.select("alert_id").distinct()
    return old.join(ids, "alert_id", "left_anti").unionByName(new.join(ids, "alert_id", "left_semi"))


def stored_mentions(mentions: DataFrame, ignored: DataFrame) -> DataFrame:
    """Mention rows as stored: defaults filled, ignored flag from the id set."""
    flag = ignored.select("alert_id", "location_id").distinct().withColumn("ignored", F.lit(True))
    return mentions.join(flag, ["alert_id", "location_id"], "left").withColumns({
        "text_source": F.coalesce(filled(F.col("text_source")), F.lit("RAW_TEXT")),
        "match_method": F.coalesce(filled(F.col("match_method")), F.lit("NORMALISED_EXACT")),
        "evidence_score": F.coalesce("evidence_score", F.lit(0)),
        "ignored": F.coalesce("ignored", F.lit(False)),
    })


def latest_revision(revs: DataFrame) -> DataFrame:
    """Newest revision per alert (``created_at``, then ``seq``)."""
    row = F.struct(*[c for c in revs.columns if c != "alert_id"])
    return revs.groupBy("alert_id").agg(F.max_by(row, F.struct("created_at", "seq")).alias("r")).select("alert_id", "r.*")


def revision_chain(versions: DataFrame, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """Each version with the hash before it and what an upsert would do."""
    rows = carry_forward(versions, keys, order, chunk, {"previous_hash": F.col("content_hash")})
    action = (
        F.when(F.col("previous_hash").isNull(), "created")
        .when(F.col("previous_hash") == F.col("content_hash"), "ignored").otherwise("updated"))
    return rows.withColumn("action", action)


def backfill_counts(alerts: DataFrame, stale: DataFrame) -> DataFrame:
    total = alerts.agg(F.count("*").alias("n")).scalar()
    return stale.agg(F.count("*").alias("processed")).withColumn("skipped", total - F.col("processed"))
