"""Operator 13: a Merkle manifest of the corpus with concatenated-level strings.

Nodes of a tree are cut into aligned blocks of a power of the arity. A block keeps
each of its levels as one string of hex digests, so a parent is the hash of a
fixed-width substring and a node's siblings are the substrings on its two sides.
The roots of the blocks are the nodes of the next, smaller tree. No step holds
more of a source than one block, and no window spans a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from alertloom.llm.sharding import _numbered as numbered
from alertloom.llm.spelling import CRC_SQL, crc_sql
from alertloom.session import write_and_read

ARITY = 3
BLOCK_LEVELS = 5   # levels of a block, which starts with ARITY ** BLOCK_LEVELS nodes
HEX = 64           # characters of a digest
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SEGMENTS = "array<struct<left: string, right: string>>"


def field(name: str) -> F.Column:
    """A value that cannot run into its neighbours: its UTF-8 length and itself, ``-`` for null."""
    value = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(fields: list[str] = FIELDS, **instead: F.Column) -> F.Column:
    return F.sha2(F.concat(*[instead.get(c, field(c)) for c in fields]), 256)


def level_strings(arity: int, levels: int) -> F.Column:
    """All levels of a block, lowest first. A tree of one block ends with its root; others climb to the block's top."""
    width = HEX * arity
    parents = f"""array_join(transform(sequence(0, int(ceil(length(element_at(made, -1)) / {width})) - 1),
        i -> sha2(substring(element_at(made, -1), i * {width} + 1, {width}), 256)), '')"""
    return F.expr(f"""aggregate(sequence(1, {levels}), array(array_join(transform(held, x -> x.node), '')),
        (made, k) -> if(n_blocks = 1 and length(element_at(made, -1)) = {HEX}, made, concat(made, array({parents}))))""")


def segments(arity: int, place: str) -> str:
    """The strings left and right of a node on each level of its block, from its place in the block."""
    q = f"({place} div int(power({arity}, k)))"
    run = f"({q} div {arity})"
    left = f"substring(levels[k], {run} * {HEX * arity} + 1, ({q} - {run} * {arity}) * {HEX})"
    right = f"substring(levels[k], ({q} + 1) * {HEX} + 1, (({run} + 1) * {arity} - {q} - 1) * {HEX})"
    return f"""if(size(levels) > 1, transform(sequence(0, size(levels) - 2), k -> struct({left} as left, {right} as right)),
        cast(array() as {SEGMENTS}))"""


def climb(nodes: DataFrame, keys: list[str], arity: int = ARITY, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Blocks (keys, block, held, levels, above, root) of the tree of each key.

    ``nodes`` has the keys, ``at`` (0-based and gapless per key), ``node`` and any
    payload, which ``held`` keeps. ``above`` are the segments from the block's top to the root.
    """
    size = arity ** levels
    payload = [c for c in nodes.columns if c not in {*keys, "at"}]
    counts = nodes.groupBy(*keys).agg(F.expr(f"max(at) div {size} + 1").alias("n_blocks"))
    blocks = nodes.groupBy(*keys, F.expr(f"at div {size}").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("at", *payload))).alias("held"))
    blocks = write_and_read(blocks.join(counts, keys).withColumn("levels", level_strings(arity, levels)), "blocks")
    none = F.expr(f"cast(array() as {SEGMENTS})")
    done = blocks.where("n_blocks = 1").withColumn("above", none).withColumn("root", F.element_at("levels", -1))
    rest = blocks.where("n_blocks > 1")
    if not rest.isEmpty():
        tops = rest.select(*keys, F.col("block").alias("at"), F.element_at("levels", -1).alias("node"))
        upper = expand(climb(tops, keys, arity, levels), keys, arity, levels).select(
            *keys, F.col("at").alias("block"), F.col("path").alias("above"), "root")
        done = done.unionByName(rest.join(upper, [*keys, "block"]))
    return done.drop("n_blocks")


def expand(blocks: DataFrame, keys: list[str], arity: int = ARITY, levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per node: keys, at, its payload, ``path`` (its segments up to the root) and ``root``."""
    rows = blocks.select(*keys, "block", "levels", "above", "root", F.explode("held").alias("one"))
    place = f"int(one.at - block * {arity ** levels})"
    return rows.select(*keys, "one.*", F.expr(f"concat({segments(arity, place)}, above)").alias("path"), "root")


def folded(start: str) -> F.Column:
    """The root that a node and the segments of its path lead to."""
    return F.expr(f"aggregate(path, {start}, (h, s) -> sha2(concat(s.left, h, s.right), 256))")


def manifest(docs: DataFrame, arity: int = ARITY, levels: int = BLOCK_LEVELS, tampered: F.Column | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, path and folded_root per row.

    ``tampered`` is a leaf to fold instead of the original one. Leaves of a source
    ascend by doc_id, null first; equal ids go by leaf, and rows equal in all
    fields are interchangeable. A null source is a source of its own, before all
    others. An empty table gives no rows; other columns do not count.
    """
    leaf = leaf_hash()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"),
        leaf.alias("node"), (leaf if tampered is None else tampered).alias("shown"))
    ranked = numbered(rows, ["tree", "doc_id", "node"], ["tree"], "at")
    blocks = climb(ranked, ["tree"], arity, levels)
    subroots = write_and_read(
        blocks.groupBy("tree").agg(F.first("root").alias("node")).orderBy("tree"), "subroots")
    above = numbered(subroots, ["tree"], [], "at").withColumn("corpus", F.lit(0))
    top = expand(climb(above, ["corpus"], arity, levels), ["corpus"], arity, levels).select(
        "tree", F.col("node").alias("subroot"), F.col("path").alias("last"), F.col("root").alias("whole"))
    whole = blocks.drop("root").join(top, "tree").withColumn("above", F.concat("above", "last")).withColumnRenamed("whole", "root")
    paths = expand(whole.drop("last"), ["tree", "subroot"], arity, levels)
    return paths.select(
        "doc_id", F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias("source"), F.col("node").alias("leaf"), "subroot", "root",
        "path", folded("shown").alias("folded_root"))


def manifest_digest(docs: DataFrame) -> DataFrame:
    """``manifest`` in the columns of the query, with line feeds deleted from the texts of every other id by its CRC-32.

    Null texts stay null and a null doc_id is not tampered with.
    """
    docs = docs.select(*FIELDS)
    text = F.translate("text", "\n", "")
    changed = F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = F.when(chosen, leaf_hash(text=changed)).otherwise(leaf_hash())
    proof = F.expr("sha2(array_join(transform(path, s -> concat(s.left, s.right)), ''), 256)")
    return manifest(docs, tampered=shown).select(
        "doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in [*FIELDS[:-1], text]]
    return f"sha256({' || '.join(parts)})"


# Trees are climbed level by level: a row per node of a level, runs of three become the next. Group 0 is the corpus.
MANIFEST_SQL = f"""
WITH RECURSIVE {CRC_SQL}
leaves AS MATERIALIZED (
    SELECT row_number() OVER () AS k, doc_id, source, {_leaf_sql("text")} AS leaf,
        CASE WHEN {crc_sql("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS shown
    FROM documents, crc_table),
placed AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS seat FROM leaves),
tree AS (
    SELECT source, 0 AS level, seat, leaf AS node, count(*) OVER (PARTITION BY source) AS many FROM placed
    UNION ALL
    SELECT source, level + 1, seat // 3, sha256(string_agg(node, '' ORDER BY seat)), (any_value(many) + 2) // 3
    FROM tree WHERE many > 1 GROUP BY source, level, seat // 3),
tree_rows AS MATERIALIZED (SELECT * FROM tree),
subroots AS MATERIALIZED (
    SELECT source, node AS subroot, row_number() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS place FROM tree_rows WHERE many = 1),
crown AS (
    SELECT 0 AS level, place AS seat, subroot AS node, (SELECT count(*) FROM subroots) AS many FROM subroots
    UNION ALL
    SELECT level + 1, seat // 3, sha256(string_agg(node, '' ORDER BY seat)), (any_value(many) + 2) // 3 FROM crown WHERE many > 1 GROUP BY level, seat // 3),
crown_rows AS MATERIALIZED (SELECT * FROM crown),
sides AS MATERIALIZED (
    SELECT source, 0 AS part, t.level, t.seat, coalesce(string_agg(s.node, '' ORDER BY s.seat) FILTER (s.seat < t.seat), '') AS l,
        coalesce(string_agg(s.node, '' ORDER BY s.seat) FILTER (s.seat > t.seat), '') AS r
    FROM (SELECT source AS g, level, seat FROM tree_rows WHERE many > 1) t JOIN tree_rows s
        ON s.source IS NOT DISTINCT FROM t.g AND s.level = t.level AND s.seat // 3 = t.seat // 3 GROUP BY ALL),
crown_sides AS MATERIALIZED (
    SELECT t.level, t.seat, coalesce(string_agg(s.node, '' ORDER BY s.seat) FILTER (s.seat < t.seat), '') AS l,
        coalesce(string_agg(s.node, '' ORDER BY s.seat) FILTER (s.seat > t.seat), '') AS r
    FROM (SELECT level, seat FROM crown_rows WHERE many > 1) t JOIN crown_rows s ON s.level = t.level AND s.seat // 3 = t.seat // 3 GROUP BY ALL),
steps AS MATERIALIZED (
    SELECT p.k, s.level, s.l, s.r FROM placed p JOIN sides s
        ON s.source IS NOT DISTINCT FROM p.source AND s.seat = p.seat // (3 ** s.level)::BIGINT
    UNION ALL
    SELECT p.k, 1000 + s.level, s.l, s.r FROM placed p JOIN subroots u ON u.source IS NOT DISTINCT FROM p.source
        JOIN crown_sides s ON s.seat = u.place // (3 ** s.level)::BIGINT),
lists AS MATERIALIZED (
    SELECT p.k, p.shown, coalesce(list(s.l ORDER BY s.level) FILTER (s.k IS NOT NULL), []) AS ls,
        coalesce(list(s.r ORDER BY s.level) FILTER (s.k IS NOT NULL), []) AS rs FROM placed p LEFT JOIN steps s ON s.k = p.k GROUP BY ALL),
folding AS (
    SELECT k, 0 AS i, shown AS h FROM lists
    UNION ALL
    SELECT f.k, i + 1, sha256(ls[i + 1] || h || rs[i + 1]) FROM folding f JOIN lists g ON g.k = f.k WHERE i < len(ls))
SELECT p.doc_id, p.leaf, u.subroot, c.node AS root,
    sha256(array_to_string(list_transform(range(1, len(g.ls) + 1), lambda i: g.ls[i] || g.rs[i]), '')) AS proof_sha256, f.h AS folded_root,
    f.h = c.node AS verified
FROM placed p JOIN lists g ON g.k = p.k JOIN folding f ON f.k = p.k AND f.i = len(g.ls) JOIN subroots u ON u.source IS NOT DISTINCT FROM p.source
    JOIN crown_rows c ON c.many = 1
"""
