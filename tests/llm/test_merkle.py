import hashlib
import zlib

from pyspark.sql import functions as F

from alertloom.llm.merkle import climb, expand, folded, leaf_hash, manifest, manifest_digest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, root string, at int, tree string, path int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row, text=None):
    doc_id, source, lang, n_chars, own = row[:5]
    values = [doc_id, source, lang, n_chars, own if text is None else text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root and, per node, its siblings (left, right) on each level."""
    paths, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, spot in enumerate(spots):
            run = spot // 3 * 3
            paths[k].append(("".join(nodes[run:spot]), "".join(nodes[spot + 1:run + 3])))
            spots[k] = spot // 3
        nodes = [sha("".join(nodes[r:r + 3])) for r in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = tree([leaf_of(r) for r in groups[s]])
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for r, path in zip(groups[s], trees[s][1]):
            path = path + tops[k]
            shown = leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                shown = leaf_of(r, r[4].replace("\n", ""))
            for left, right in path:
                shown = sha(left + shown + right)
            out.append((r[0], leaf_of(r), trees[s][0], root, sha("".join(a + b for a, b in path)), shown, shown == root))
    return sorted(out, key=str)


def made(sizes):
    rows = []
    for s, n in sizes.items():
        rows += [(k * 7 % 1000, s, ("en", None)[k % 5 == 0], k if k % 4 else None, (f"t{k}\né", None, "", "x" * 50_000)[k % 4 if k < 8 else 0], 1, "r", 2, "t", 3) for k in range(n)]
    return rows


def check(spark, rows, parts=4):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert sorted(map(tuple, manifest_digest(docs).collect()), key=str) == plain(rows)


def test_against_plain_trees(spark):
    rows = made({"hot": 800, "b": 1, "": 3, None: 10, "é": 4, "z": 244})
    rows += [rows[0]] * 3 + [(None, "hot", "en", 1, "a\nb", 1, "r", 2, "t", 3)] * 2 + [(5, "hot", "de", 2, "other", 1, "r", 2, "t", 3)] * 2
    check(spark, rows)


def test_one_row_and_none(spark):
    check(spark, made({"only": 1}), 1)
    assert manifest_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_blocks_climb_to_the_same_root(spark):
    rows = made({"a": 83, "b": 28, "c": 27, "d": 9, "e": 2})
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {(r[0], r[1], r[2], r[3]) for r in plain(rows)}
    for levels in (1, 2, 3):
        got = manifest(docs.select("doc_id", "source", "lang", "n_chars", "text"), levels=levels)
        assert {(r.doc_id, r.leaf, r.subroot, r.root) for r in got.collect()} == want
        assert got.where("folded_root != root").count() == 0


def test_other_arity_and_changed_leaf(spark):
    nodes = spark.range(37).select(F.lit(1).alias("k"), F.col("id").alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("node"))
    paths = expand(climb(nodes, ["k"], 2, 2), ["k"], 2, 2)
    assert paths.where(folded("node") == F.col("root")).count() == 37
    assert paths.where(folded("sha2(node, 256)") == F.col("root")).count() == 0
    level = [sha(str(k)) for k in range(37)]
    while len(level) > 1:
        level = [sha("".join(level[k:k + 2])) for k in range(0, len(level), 2)]
    assert {r.root for r in paths.select("root").collect()} == {level[0]}


def test_fields_do_not_run_into_each_other(spark):
    docs = spark.createDataFrame([(1, "a", "b", 1, "1:x"), (1, "a", "b", 11, ":x"), (1, None, "b", 1, "-")], "doc_id long, source string, lang string, n_chars long, text string")
    got = [r[0] for r in docs.select(leaf_hash()).collect()]
    assert len(set(got)) == 3 and got == [leaf_of(r) for r in docs.collect()]
