import hashlib
import random
import re

from alertloom.llm.decontaminate import contamination, decontaminate, find_matches

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, item_text in items:
            iw = words(item_text)
            size = min(window, len(iw))
            for j in range(len(iw) - size + 1) if size else ():
                for p in range(len(w) - size + 1):
                    if w[p:p + size] == iw[j:j + size]:
                        hit.update(range(p, p + size))
                        if item is not None:
                            found.add(str(item))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def make(seed, n_docs=40, n_items=12):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Café", "d1", "中", "no-table"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 9, 10, 14, 30])))) for i in range(n_items)]
    items += [(3, items[3][1]), (None, "zz yy xx"), (90, None), (91, "...")]
    docs = []
    for i in range(n_docs):
        text = " ".join(rng.choice(vocabulary + ["unknown"]) for _ in range(rng.choice([0, 5, 40, 200])))
        if rng.random() < .5:
            text += " ! " + rng.choice(items[:n_items])[1] + "? " + text[:20]
        docs.append((i, text))
    docs += [(7, docs[7][1]), (200, None), (None, "zz, YY; xx"), (201, "...")]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = make(3)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, contamination(table, bench).collect()), key=str)
    assert got == brute(docs, items)
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_blocks_give_the_same(spark):
    docs, items = make(4)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    whole = find_matches(table, bench)
    cut = find_matches(table, bench, block_words=60)
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))


def test_removes_affected_and_keeps_columns(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"x {passage.upper()} y", "s", 5, "keep"), (2, "clean text", None, 6, "keep"), (3, None, None, None, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string, spans string, n_words int, items string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = decontaminate(table, bench.withColumn("spans", bench.text))
    assert sorted(map(tuple, out.collect())) == docs[1:] and out.columns == table.columns


def test_empty_tables(spark):
    docs, items = make(5, 8, 4)
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert contamination(table.limit(0), bench).count() == 0
    assert contamination(table, bench.limit(0)).filter("contaminated").count() == 0


def test_long_text(spark):
    words_ = [f"w{i % 50}" for i in range(60000)]
    docs = spark.createDataFrame([(1, " ".join(words_))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words_[:30]))], "item_id long, text string")
    assert contamination(docs, bench).first().n_hit == sum(1 for i in range(60000) if i % 50 < 30)


def test_longest_matches_with_both_places(spark):
    import random
    from alertloom.llm.decontaminate import longest_matches
    rng = random.Random(6)
    items = [(f"i{k}", " ".join(rng.choice("abcdefgh") + str(rng.randrange(3)) for _ in range(rng.choice([4, 12, 40])))) for k in range(8)] + [("r", "x " * 30), (None, "z " * 12), ("n", None)]
    rows = [(1, None), (2, ""), (3, "x " * 50), (3, "x " * 50)]
    for k in range(60):
        parts = []
        for _ in range(3):
            w = words(rng.choice(items[:8])[1])
            a = rng.randrange(len(w))
            parts += w[a:a + rng.choice([3, 9, 10, 30])] + [f"own{rng.randrange(99)}"] * rng.randint(0, 2)
        rows.append((10 + k, " ".join(parts).upper()))

    def slow(text, item):
        d, t = words(text), words(item)
        least, out, before = min(10, len(t)), [], 0
        for i in range(len(d)):
            best = 0
            for j in range(len(t)):
                n = 0
                while i + n < len(d) and j + n < len(t) and d[i + n] == t[j + n]:
                    n += 1
                best = max(best, n)
            if t and best >= least and best >= before:
                out.append((i, best))
            before = best
        return out

    got = longest_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    want = sorted((d, i, at, n) for d, t in rows for i, x in items if i for at, n in slow(t, x))
    assert sorted((r.doc_id, r.item_id, r.doc_start, r.n_words) for r in got) == want and len(want) > 40
    texts, tests = dict(rows), dict(items)
    for r in got:
        assert words(texts[r.doc_id])[r.doc_start:r.doc_start + r.n_words] == words(tests[r.item_id])[r.item_start:r.item_start + r.n_words]
