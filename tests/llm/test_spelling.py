import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from alertloom.llm.spelling import neighbours, rotations, spelling_groups, word_counts

SCHEMA = "doc_id long, text string, word int, n string, form int, key int"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def plain_counts(rows, odd=97):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % odd == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return counts


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain(rows, odd=97, min_letters=5, min_count=3):
    words = {w: n for w, n in plain_counts(rows, odd).items() if len(w) >= min_letters and n >= min_count}
    near = defaultdict(list)
    for a in words:
        near[a] = [b for b in words if a != b and is_near(a, b)]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda b: (-words[b], b), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def made(seed, n=400):
    rnd = random.Random(seed)
    stems = ["aabbcc", "aabcc", "colour", "color", "straße", "strasse", "ÀÀÀÀÀ", "ÀÀÀÀÀÀ", "élèves", "eleves", "aaaaaa", "aaaaaaa", "aaaabaaa"]
    stems += ["".join(rnd.choice("abc") for _ in range(5)) for _ in range(60)]
    rows = []
    for k in range(n):
        words = [rnd.choice(stems[:1 + int(len(stems) * rnd.random() ** 2)]) for _ in range(rnd.randint(0, 30))]
        rows.append((k, " ".join(w.upper() if rnd.random() < 0.1 and w.isascii() else w for w in words) + "1x÷y×", 1, "n", 2, 3))
    return rows + [(None, "colour colour strasse", 1, "n", 2, 3), (7, None, 1, "n", 2, 3), (8, "", 1, "n", 2, 3), (9, "aabcc " * 3, 1, "n", 2, 3), (9, "aabcc " * 3, 1, "n", 2, 3)]


def test_against_all_pairs(spark):
    for seed in range(2):
        rows = made(seed)
        docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
        got = spelling_groups(docs, odd=11).select("word", "form", "root", "n", "n_near", "form_n")
        want = plain(rows, odd=11)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        assert any(r[4] > 3 for r in want) and any(r[2] != r[1] and r[1] for r in want)


def test_counts_of_a_very_long_text_and_no_rows(spark):
    rows = [(1, "Straßen straßen " * 50_000 + "abcdef" * 30_000, 1, "n", 2, 3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.word: r.n for r in word_counts(docs).collect()} == {w: n for w, n in plain_counts(rows).items() if len(w) >= 5}
    assert spelling_groups(docs.limit(0)).count() == 0


def test_groups_hold_one_word_per_letter(spark):
    letters = [chr(c) for c in [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]]
    words = spark.createDataFrame([(f"ab{c}de", 5) for c in letters] + [("abde", 9)], "word string, n long")
    sizes = rotations(words).groupBy("key").count().agg(F.max("count")).first()[0]
    assert sizes == len(letters) + 1
    found = {r.word: (r.n_near, r.best) for r in neighbours(words).collect()}
    assert found["abde"] == (len(letters), "abade") and found["abxde"] == (len(letters), "abde")
