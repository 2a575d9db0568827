import base64
import hashlib
import random
import re

import pytest

from alertloom.llm.secrets import find_secrets, secret_digest

PATTERNS = [
    ("assign", re.compile(r"""(?:(?i:password|passwd|secret|token)|(?i:api)_?(?i:key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)),
    ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))]


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            size = len(m[1]) if kind == "assign" else len(m[0])
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def shown(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def corpus(seed):
    rng = random.Random(seed)
    parts = ["password = abc", "Secret: 'qwerty12'", "API_KEY=\"a.b-c_d/e+f=\"", "apikey :x", "token=secret=abcdefg", "secret=token: abcdefgh", "AKIA" + "A1" * 8,
             "AKIA" + "B" * 15, "AKIAAKIA" + "C" * 14, "deadbeef" * 3, "ab12" * 5, "0" * 24, "été", "\U0001f600", "plain words", "\n", "  ", "passwd==longer_value",
             "ſecret=abcdefg", "toKen : \t abcdefg", "akia" + "A" * 20, "f" * 23]
    rows = [(i, rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 30])))) for i in range(150)]
    return rows + [(3, rows[3][1]), (None, "token=abcdefgh"), (200, None), (201, ""), (202, " password=abcdef1" * 700)]


def test_base_spans_equal_brute_force(spark):
    rows = corpus(1)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, base string, kind int").repartition(4)
    want = []
    for doc, text in rows:
        spans = base_spans(text)
        kinds = [k for k, _, _ in spans]
        want.append((doc, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(shown(spans).encode()).hexdigest()))
    got = secret_digest(docs).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by_id = {r.doc_id: r.spans for r in got}
    assert all(shown(base_spans(t)) == ",".join(s for s in by_id[d].split(",") if not s.startswith("random")) for d, t in rows)


@pytest.fixture(scope="module")
def mixed_tokens():
    rng = random.Random(5)
    planted, rows = {}, []
    words = ["configuration", "international", "understanding", "development", "responsible", "government", "information"]
    for i in range(400):
        ordinary = rng.choice(["_", "-", "/", ""]).join(rng.choice(words) for _ in range(3))
        camel = "".join(rng.choice(words).title() for _ in range(2))
        text = f"see {ordinary} and {camel} then {rng.randrange(10**24)} end"
        if i % 8 == 0:
            secret = base64.b64encode(rng.randbytes(36)).decode()
            planted[i] = (len(text) + 1, len(text) + 1 + len(secret))
            text += " " + secret
        rows.append((i, text))
    return rows, planted


def test_battery_finds_random_tokens_only(spark, mixed_tokens):
    rows, planted = mixed_tokens
    found = {r.doc_id: [(s.start, s.end) for s in r.secrets if s.kind == "random"] for r in
             find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = sum(planted[i] in found[i] for i in planted)
    extra = sum(len(v) for v in found.values()) - hits
    assert hits >= .9 * len(planted) and extra <= 1


def test_empty(spark):
    assert secret_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
