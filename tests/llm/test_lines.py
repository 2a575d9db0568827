import hashlib
import random

import duckdb

from alertloom.llm.lines import LINES_SQL, drop_repeated_lines, line_digest


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def chunks(text):
    """The lines and, per chunk, its first and last line and what it says."""
    lines = (text or "").split("\n")
    full = [i for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
    own = [False] + [md5(md5(lines[full[w - 1]]) + md5(lines[full[w]]))[0] <= "d" for w in range(1, len(full))]
    out = []
    for w in range(1, len(full)):
        if own[w]:
            out.append((w - 1, w))
            continue
        back = next((w - k for k in range(1, 5) if w >= k and own[w - k]), None)
        fore = next((w + k for k in range(1, 5) if w + k < len(own) and own[w + k]), None)
        out += [(back - 1, w)] if back is not None else []
        out += [(w - 1, fore)] if fore is not None else []
    return lines, [(full[a], full[b] + 1, "\n".join(lines[i] for i in full[a:b + 1])) for a, b in out]


def brute(rows):
    first = {}
    for doc, text in rows:
        key = -(2**63) if doc is None else doc
        for a, _, body in chunks(text)[1]:
            first[body] = min(first.get(body, (key, a)), (key, a))
    out = []
    for doc, text in rows:
        key = -(2**63) if doc is None else doc
        lines, own = chunks(text)
        gone = {i for a, b, body in own if first[body] < (key, a) for i in range(a, b)}
        kept = [x for i, x in enumerate(lines) if i not in gone]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def repeated_runs(rows, words=50):
    """Maximal runs of two or more lines and over 50 words that also occur earlier, found line by line without any chunks."""
    seen, runs = {}, []
    for doc, text in sorted(rows):
        lines = [x for x in (text or "").split("\n") if x.strip()]
        i = 0
        while i < len(lines) - 1:
            best = 0
            for d, j in seen.get(tuple(lines[i:i + 2]), ()):
                n = 2
                while i + n < len(lines) and j + n < len(d) and lines[i + n] == d[j + n]:
                    n += 1
                best = max(best, n)
            if best and sum(len(x.split()) for x in lines[i:i + best]) > words:
                runs.append((doc, lines[i:i + best]))
            i += max(best, 1)
        for i in range(len(lines) - 1):
            seen.setdefault(tuple(lines[i:i + 2]), []).append((lines, i))
    return runs


def test_repeated_passages_go(spark):
    """Runs found without the operator's chunks, whole copies of documents left out: nine of ten go as a whole."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    first = {}
    for r in sorted(docs.collect()):
        first.setdefault(r.text or "", r.doc_id)
    rows = [(d, t) for t, d in first.items()]
    kept = {r.doc_id: (r.text or "").split("\n") for r in drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    runs = repeated_runs(rows)
    whole = sum(not any(x in kept[d] for x in run) for d, run in runs)
    assert len(runs) >= 10 and whole >= .9 * len(runs)


def corpus(seed=2, n=120):
    rng = random.Random(seed)
    shared = [[f"shared {k} line {i} é" for i in range(rng.choice([3, 8, 20]))] for k in range(4)]
    rows = []
    for i in range(n):
        lines = [f"own {i} {j}" for j in range(rng.randint(0, 6))]
        if rng.random() < .6:
            lines += rng.choice(shared)
        lines += [f"end {i}"] * rng.randint(0, 2)
        rows.append((i * 2, "\n".join(lines)))
    rows += [(1000, rows[5][1]), (1000, rows[5][1]), (11, rows[6][1]), (None, "\n".join(shared[2])), (1001, None), (1002, ""), (1003, "\n\n\n\n\n\n"),
             (1004, "\r\nx\n"), (1005, "same\nsame\n" * 300)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, gone string").repartition(4)
    got = sorted(map(tuple, line_digest(docs).collect()), key=str)
    want = brute(rows)
    assert got == sorted(((d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in want), key=str)
    assert sum(r[2] for r in got) > 50
    texts = drop_repeated_lines(docs).collect()
    assert sorted(((r.doc_id, r.text or "") for r in texts), key=str) == sorted(((d, k) for d, _, _, k in want), key=str)
    assert texts[0].asDict().keys() == {"doc_id", "text", "start", "gone"} and all(r.start == 1 for r in texts)


def test_n_chars_follows(spark):
    rows = [(d, t, "s", len(t or "")) for d, t in corpus(3, 40) if d is not None]
    for r in drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")).collect():
        assert r.n_chars == len(r.text or "")


def test_sql_says_the_same(spark):
    rows = [r for r in dict(corpus(4)).items() if r[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    theirs = sorted(con.execute(f"SELECT doc_id, n_lines, n_removed, kept_sha256 FROM ({LINES_SQL})").fetchall())
    assert sorted(map(tuple, line_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == theirs


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_digest(docs).count() == 0 and drop_repeated_lines(docs).count() == 0
