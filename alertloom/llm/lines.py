"""Operator 10: line dedup by content-defined chunks.

Lines that hold more than white space follow each other in windows of two. A
rolling digest over the digests of a window decides whether it is a chunk by
itself, as most are, or is joined to the nearest such window before it and to the
nearest one after it. So chunks move with the content and not with the position,
and a repeated passage goes as a whole if it holds one deciding window: seven of
eight passages of two lines, 98 of 100 of three. A chunk that occurs earlier
anywhere is removed once the bytes of its lines have been compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from alertloom.session import write_and_read

ENDS = "0123456789abcd"  # first hex digits of a rolling digest that make a window a chunk: seven eighths
FAR = 4                  # windows that a joined one may lie away from its neighbour
NULL_ID = -(2**63)       # a null doc_id sorts first
BLANK = " \t\r\x0b\x0c"
CHUNK = "struct<start: int, stop: int, key: string>"


def _chunks(full: Column) -> Column:
    """Chunks (start, stop, key) of ``full``, the lines (i, digest) that are not blank. A key is the digests of its lines."""
    count = F.size(full)
    digest = lambda i: F.get(full, i)["digest"]
    numbers = F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda w: (w > 0) & (w < count))
    # Element 0 is no window; elements outside are null.
    decides = F.concat(F.array(F.lit(False)), F.transform(
        numbers, lambda w: F.substring(F.md5(F.concat(digest(w - 1), digest(w)).cast("binary")), 1, 1) <= ENDS[-1]))
    windows = F.transform(numbers, lambda w: F.struct(
        w.alias("w"), F.get("decides__", w).alias("own"),
        F.coalesce(*[F.when(F.when(w >= k, F.get("decides__", w - k)), w - k) for k in range(1, FAR + 1)]).alias("back"),
        F.coalesce(*[F.when(F.get("decides__", w + k), w + k) for k in range(1, FAR + 1)]).alias("fore")))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    bounds = F.flatten(F.transform(F.col("windows__"), lambda x: F.when(x["own"], F.array(pair(x["w"] - 1, x["w"]))).otherwise(
        F.array_compact(F.array(
            F.when(x["back"].isNotNull(), pair(x["back"] - 1, x["w"])), F.when(x["fore"].isNotNull(), pair(x["w"] - 1, x["fore"])))))))
    key = lambda a, b: F.concat_ws("", *[F.when(a + k <= b, digest(a + k)) for k in range(FAR + 2)])
    chunks = F.transform(F.col("bounds__"), lambda c: F.struct(
        F.get(full, c["a"])["i"].alias("start"), (F.get(full, c["b"])["i"] + 1).alias("stop"), key(c["a"], c["b"]).alias("key")))
    return decides, windows, bounds, chunks


def _marked(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with the keys of a row: its doc_id, and a hash of its text."""
    return docs.select(
        *columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id_key__"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key__"))


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def _keyed(docs: DataFrame) -> DataFrame:
    """(id_key__, text_key__, start, stop, key) of all chunks; a key is 16 bytes a line."""
    lined = _marked(docs, ["text"]).withColumn("lines__", _lines())
    full = F.filter(F.transform("lines__", lambda x, i: F.struct(
        i.alias("i"), F.when(F.translate(x, BLANK, "") != "", F.md5(x.cast("binary"))).alias("digest"))), lambda x: x["digest"].isNotNull())
    rows = lined.withColumn("full__", full)
    decides, windows, bounds, chunks = _chunks(F.col("full__"))
    rows = rows.withColumn("decides__", decides).withColumn("windows__", windows).withColumn("bounds__", bounds)
    rows = rows.select("id_key__", "text_key__", F.explode_outer(chunks).alias("c")).filter("c IS NOT NULL")
    return rows.select("id_key__", "text_key__", "c.start", "c.stop", F.unhex("c.key").alias("key"))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(id_key__, text_key__, seen__): per document its chunks that occur more than once, as (start, stop, later, key)."""
    keyed = _keyed(docs)
    at = F.struct("id_key__", "start")
    firsts = keyed.groupBy("key").agg(F.min(at).alias("first__"), F.count(F.lit(1)).alias("times__")).filter("times__ > 1")
    # Written, so that the join has no grouping in its stage and a hot chunk can be split over tasks.
    firsts = write_and_read(firsts.drop("times__"), "chunks")
    found = keyed.join(firsts, "key").select(
        "id_key__", "text_key__", F.struct("start", "stop", (at > F.col("first__")).alias("later"), "key").alias("c"))
    return found.groupBy("id_key__", "text_key__").agg(F.array_sort(F.collect_set("c")).alias("seen__"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with lines__ (its lines), kept__ (those that stay) and gone__ (their numbers that go).

    Earlier means a smaller doc_id (null before all) or a smaller line of the
    same document. Single lines are never removed; blank lines inside a removed
    chunk go with it. A null or empty text is one empty line. Rows that repeat a
    doc_id and its text get the same result and don't remove each other; a
    document may lose all its lines, and an empty table gives no rows.
    """
    # Lines are cut again after the join, which then moves every text once.
    marked = write_and_read(_marked(docs, docs.columns).join(repeated_chunks(docs), ["id_key__", "text_key__"], "left"), "marked")
    marked = marked.withColumn("lines__", _lines())
    none = lambda t: F.array().cast(f"array<{t}>")
    # Bytes are compared line by line, in lines of repeated chunks alone: a digest of two different lines clears its chunks.
    inside = F.array_distinct(F.flatten(F.transform("seen__", lambda c: F.sequence(c["start"], c["stop"] - 1))))
    lines = marked.filter("seen__ IS NOT NULL").select(F.explode(F.transform(inside, lambda i: F.get("lines__", i))).alias("line")).withColumn(
        "digest", F.unhex(F.md5(F.col("line").cast("binary"))))
    unsure = lines.groupBy("digest").agg(F.min("line").alias("low"), F.max("line").alias("high")).filter("low != high").select(F.hex("digest").alias("digest"))
    bad = write_and_read(unsure, "unsure")
    later = F.filter("seen__", lambda c: c["later"])
    if not bad.isEmpty():
        known = marked.select("id_key__", "text_key__", F.explode("seen__").alias("c"))
        hit = known.select("*", F.explode(F.expr("transform(sequence(0, octet_length(c.key) div 16 - 1), k -> hex(substring(c.key, k * 16 + 1, 16)))")).alias("digest"))
        lost = hit.join(bad, "digest").groupBy("id_key__", "text_key__").agg(F.collect_set("c").alias("lost__"))
        marked = marked.join(lost, ["id_key__", "text_key__"], "left")
        later = F.array_except(later, F.coalesce("lost__", F.array().cast(marked.schema["seen__"].dataType)))
    # Chunks ascend by their start, so they merge into stretches: what lies between the ends so far and the next start stays.
    spans = F.coalesce(F.transform(later, lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"))), none("struct<start:int,stop:int>"))
    spans = F.aggregate(
        F.concat(spans, F.array(F.struct(F.size("lines__").alias("start"), F.size("lines__").alias("stop")))),
        F.struct(F.lit(0).alias("end"), none("struct<start:int,n:int>").alias("kept")),
        lambda acc, c: F.struct(
            F.greatest(acc["end"], c["stop"]).alias("end"),
            F.when(c["start"] > acc["end"], F.concat(acc["kept"], F.array(F.struct(acc["end"].alias("start"), (c["start"] - acc["end"]).alias("n"))))).otherwise(
                acc["kept"]).alias("kept")),
        lambda acc: acc["kept"])
    kept = F.flatten(F.transform(spans, lambda s: F.slice("lines__", s["start"] + 1, s["n"])))
    return marked.withColumn("kept__", kept).select(*docs.columns, "lines__", (F.size("lines__") - F.size("kept__")).alias("gone__"), "kept__")


def line_digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256 (of the kept lines joined by line feeds)."""
    return without_repeats(docs.select("doc_id", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.size("lines__").cast("long").alias("n_lines"), F.col("gone__").cast("long").alias("n_removed"),
        F.sha2(F.array_join("kept__", "\n"), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with their kept text; n_chars, where there is one, follows it. A null text without removals stays null.

    Nulls, ties, repeated rows and empty tables as in ``without_repeats``; all columns are kept.
    """
    text = F.when(F.col("gone__") == 0, F.col("text")).otherwise(F.array_join("kept__", "\n"))
    chars = [F.when(F.col("gone__") == 0, F.col("n_chars")).otherwise(F.length(F.array_join("kept__", "\n")).cast(docs.schema["n_chars"].dataType))
             .alias("n_chars")] if "n_chars" in docs.columns else []
    columns = [text.alias("text") if c == "text" else chars[0] if c == "n_chars" else F.col(c) for c in docs.columns]
    return without_repeats(docs).select(*columns)


LINES_SQL = f"""
WITH lined AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM lined),
filled AS (
  SELECT doc_id, i, md5(line) AS h, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM each
  WHERE translate(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12), '') <> ''),
windows AS (
  SELECT b.doc_id, b.k AS w, substr(md5(a.h || b.h), 1, 1) <= '{ENDS[-1]}' AS own
  FROM filled a JOIN filled b ON a.doc_id = b.doc_id AND b.k = a.k + 1),
nearest AS (
  SELECT x.doc_id, x.w, x.own, max(y.w) FILTER (y.w < x.w) AS back, min(y.w) FILTER (y.w > x.w) AS fore
  FROM windows x LEFT JOIN windows y ON NOT x.own AND y.own AND y.doc_id = x.doc_id AND y.w BETWEEN x.w - {FAR} AND x.w + {FAR} GROUP BY ALL),
bounds AS (
  SELECT doc_id, w - 1 AS a, w AS b FROM nearest WHERE own
  UNION ALL SELECT doc_id, back - 1, w FROM nearest WHERE back IS NOT NULL
  UNION ALL SELECT doc_id, w - 1, fore FROM nearest WHERE fore IS NOT NULL),
bodies AS (
  SELECT c.doc_id, c.a, c.b, min(f.i) AS start, max(f.i) AS stop, string_agg(f.line, chr(10) ORDER BY f.k) AS body
  FROM bounds c JOIN filled f ON f.doc_id = c.doc_id AND f.k BETWEEN c.a AND c.b GROUP BY ALL),
gone AS (
  SELECT doc_id, start, stop FROM (
    SELECT *, rank() OVER (PARTITION BY body ORDER BY doc_id, start) AS nth FROM bodies) z WHERE nth > 1),
lost AS (SELECT DISTINCT doc_id, unnest(range(start, stop + 1)) AS i FROM gone),
kept AS (
  SELECT l.doc_id, len(any_value(l.lines)) AS n, count(e.i) FILTER (x.i IS NULL) AS n_kept,
    coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (x.i IS NULL), '') AS body
  FROM lined l JOIN each e ON e.doc_id = l.doc_id LEFT JOIN lost x ON x.doc_id = e.doc_id AND x.i = e.i GROUP BY l.doc_id)
SELECT doc_id, n::BIGINT AS n_lines, (n - n_kept)::BIGINT AS n_removed, sha256(body) AS kept_sha256 FROM kept
"""
