"""Recall of the random tokens per encoding and length, one token in ten being a secret."""

import random
import string

from alertloom.llm.secrets import find_secrets

LETTERS = {"HEX": "0123456789ABCDEF", "base32": string.ascii_uppercase + "234567", "base36": string.ascii_lowercase + string.digits,
           "base62": string.ascii_letters + string.digits}
SIZES = [20, 24, 32, 40, 64]
WORDS = ["configuration", "international", "understanding", "development", "responsible", "government", "information", "weather", "river", "north"]


def recall(spark, each=60, seed=3):
    """{(encoding, length): share found} and the share of false ones among all that were found."""
    rng = random.Random(seed)
    rows, cell = [], {}
    for size in SIZES:
        for name, letters in LETTERS.items():
            for _ in range(each):
                cell[len(rows)] = (name, size)
                rows.append((len(rows), "".join(rng.choice(letters) for _ in range(size))))
        for _ in range(9 * each * len(LETTERS)):
            text = ""
            while len(text) < size:
                text += rng.choice(["_", "-", ""]) + rng.choice(WORDS)
            rows.append((len(rows), rng.choice([str, str.title, str.upper])(text[:size])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id for r in find_secrets(docs).collect() if any(s.kind == "random" for s in r.secrets)}
    out = {c: sum(i in got for i in cell if cell[i] == c) / each for c in sorted(set(cell.values()))}
    return out, len(got - set(cell)) / max(1, len(got))


def test_short_secrets_are_found(spark):
    """Bounds are a little below what was measured (README); before, HEX of 20 to 40 and base36 of 20 to 32 were found 0 times."""
    shares, false = recall(spark)
    assert all(shares[name, 32] >= .7 for name in ("HEX", "base36", "base62")), shares
    assert all(shares[name, 24] >= .5 for name in ("HEX", "base36", "base62")), shares
    assert all(shares["base32", size] >= .6 for size in (40, 64)), shares
    assert false <= .05
