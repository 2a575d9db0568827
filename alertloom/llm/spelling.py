"""Operator 12: spelling variants grouped by permuterm rotations.

A word of n letters, ended by a mark, has n + 1 rotations. Rotated so that an
edited letter stands last, two words that differ by a replacement there share all
but that last letter; where one of them lacks the letter, its own whole rotation
is that shared prefix. So every word emits its whole rotations and, per letter,
the prefix that skips it. All are sorted by range, and a group of equal strings
holds a whole rotation at most and one word per letter of the alphabet: groups
are bounded whatever the corpus. A scan gives each member its neighbours' number
and the best of them; no pairs are made.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alertloom.llm.common import in_arrow
from alertloom.session import write_and_read

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
ODD = 97           # one run of a document in so many loses a letter
MIN_LETTERS = 5
MIN_COUNT = 3
TIMES = 2          # a form is so many times as frequent as the word
MARK = "$"         # no letter, so it ends a word
HELD_WORDS = 200_000


def word_counts(docs: DataFrame, odd: int = ODD, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(word, n) over whole texts. Tasks count what they see and pass on at most ``HELD_WORDS`` words at a time."""

    def run(batches):
        counts: dict[str, int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own: dict[str, int] = {}
                for found in RUN.findall(text):
                    own[found] = own.get(found, 0) + 1
                lowered: dict[str, int] = {}
                for found, n in own.items():
                    found = found.lower() if found.isascii() else found.translate(LOWER)
                    lowered[found] = lowered.get(found, 0) + n
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in lowered.items():
                    h = zlib.crc32(word.encode(), prefix)
                    if h % odd == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= min_letters:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > HELD_WORDS:
                    yield flush()
        yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return in_arrow(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """(key, word, n, skipped): whole rotations, with no skipped letter, and prefixes that skip the last one."""
    at = F.col("at")
    size = F.length("word")
    back = F.concat(F.expr("substring(word, at + 1)"), F.lit(MARK))
    turned = words.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("at"))
    whole = F.struct(F.concat(back, F.expr("substring(word, 1, at)")).alias("key"), F.lit(None).cast("string").alias("skipped"))
    prefix = F.struct(F.concat(back, F.expr("substring(word, 1, at - 1)")).alias("key"), F.expr("substring(word, at, 1)").alias("skipped"))
    forms = F.when(at > 0, F.array(whole, prefix)).otherwise(F.array(whole))
    return turned.select("word", "n", F.explode(forms).alias("r")).select("r.key", "word", "n", "r.skipped")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near words.

    In a group, words that skip a letter are near each other and near the whole
    rotation. A letter may be left out of a run of equal ones in several places:
    only the first place of the run counts, where the letter before differs.
    """
    sorted_keys = rotations(words).repartitionByRange("key").sortWithinPartitions("key")
    member = F.struct((-F.col("n")).alias("less"), "word", "skipped")
    groups = sorted_keys.groupBy("key").agg(F.array_sort(F.collect_list(member)).alias("all")).where(F.size("all") > 1)
    groups = groups.withColumn("edited", F.expr("filter(all, x -> x.skipped is not null)"))
    groups = groups.withColumn("whole", F.expr("get(filter(all, x -> x.skipped is null), 0)"))
    groups = groups.withColumn("first_of_run", F.expr("filter(edited, x -> x.skipped != right(key, 1))"))
    plain = "struct({0}.less as less, {0}.word as word)"

    def or_null(x: str) -> str:
        return f"if({x} is null, null, {plain.format(x)})"

    of_edited = f"""transform(edited, x -> struct(
        x.word as word,
        size(edited) - 1L + if(whole is not null and x.skipped != right(key, 1), 1L, 0L) as n_near,
        array_min(array(
            {or_null("if(x.word = edited[0].word, get(edited, 1), edited[0])")},
            if(x.skipped != right(key, 1), {or_null("whole")}, null))) as best))"""
    of_whole = f"""if(whole is null, array(), array(struct(
        whole.word as word, cast(size(first_of_run) as long) as n_near, {or_null("get(first_of_run, 0)")} as best)))"""
    seen = groups.select(F.explode(F.expr(f"concat({of_edited}, {of_whole})")).alias("m")).where("m.n_near > 0")
    return seen.groupBy("m.word").agg(F.sum("m.n_near").alias("n_near"), F.min("m.best").alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): paths are halved until none changes. Counts rise along a path, so there are no circles."""
    held = write_and_read(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        held = write_and_read(held.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if held.where("moved").isEmpty():
            return held.select("word", "root")
        held = held.select("word", "root")


def spelling_groups(
        docs: DataFrame, odd: int = ODD, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the corpus.

    Null texts have no words, a null doc_id counts as the empty id, repeated rows
    count once each, an empty table gives no rows, other columns are not read.
    Among near words of equal count the smallest in code-point order is the form.
    """
    words = write_and_read(word_counts(docs, odd, min_letters).where(F.col("n") >= min_count), "words")
    near = neighbours(words)
    has_form = F.col("best_n") >= times * F.col("n")
    held = write_and_read(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best")).alias("form"),
        F.when(has_form, F.col("best_n")).alias("form_n")), "variants")
    ends = roots(held.where("form is not null"))
    return held.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# CRC-32 byte by byte: the table of its 256 steps is computed from the polynomial.
CRC_SQL = """crc_table AS MATERIALIZED (
    SELECT list(v ORDER BY b) AS steps FROM (
        SELECT b, list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b) AS v
        FROM (SELECT unnest(range(256)) AS b))),
"""


def crc_sql(text: str) -> str:
    """DuckDB expression of the unsigned CRC-32 of a text's UTF-8 bytes; needs ``CRC_SQL`` and ``crc_table`` in scope."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT"
    octets = f"list_transform(range(1, strlen({text}) + 1), lambda i: {byte})"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


SPELLING_SQL = f"""
WITH RECURSIVE {CRC_SQL}
runs AS (
    SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY 1, 2),
hashed AS (
    SELECT run, n, {crc_sql("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM runs, crc_table),
changed AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (
    SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS MATERIALIZED (
    SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
    SELECT x.word, y.word AS other, y.n AS other_n FROM holes x JOIN holes y ON x.a = y.a AND x.b = y.b AND x.word != y.word
    UNION SELECT x.word, y.word, y.n FROM holes x JOIN words y ON y.word = x.a || x.b
    UNION SELECT y.word, x.word, x.n FROM holes x JOIN words y ON y.word = x.a || x.b),
best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
        CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
    FROM words w LEFT JOIN best USING (word)),
walk AS (
    SELECT word, word AS at FROM formed
    UNION ALL SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, k.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN walk k ON k.word = f.word JOIN formed e ON e.word = k.at AND e.form IS NULL
"""
