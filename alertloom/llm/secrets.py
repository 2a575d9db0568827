"""Operator 1: secret scans with a battery of randomness tests.

Three patterns give the base spans. Every other long token is tested: its
encoding is inferred from its characters; a chi-squared test of a uniform
alphabet, a runs test over character classes and a serial correlation test must
all find it compatible with randomness; and the first two together must find it
incompatible with ordinary text. Their normal scores against text are added up
(Stouffer's method) into one p-value, and within
each class of token lengths false discoveries among all tokens of the corpus
are controlled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from alertloom.functions.arrays import prefix_sums
from alertloom.session import write_and_read

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN), ("access", "AKIA[A-Z0-9]{16,}"), ("hex", "[0-9a-f]{24,}")]
LEAST_VALUE = 6
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
LENGTHS = [24, 32, 40, 64, 128]  # lower ends of the length classes above the first
RATE = 0.001  # expected share of false discoveries in a length class
LIMIT = 3.3  # standard deviations that a random token may be off in a test
STEPS = 10  # levels per unit of -ln(p)
TOP_LEVEL = 4000

# Encodings: name, pattern, alphabet size, repeat rate of ordinary text written in it, share of class changes in random tokens.
ENCODINGS = [
    ("digits", "^[0-9]+$", 10, 0.2, 0.0),
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", 16, 0.12, 0.469),
    ("base32", "^[A-Z2-7]+=*$", 32, 0.066, 0.305),
    ("base36", "^(?:[a-z0-9]+|[A-Z0-9]+)$", 36, 0.066, 0.401),
    ("base64", "", 64, 0.066, 0.645),
]
TEXT_CHANGES = 0.12  # share of class changes in ordinary text
CLASSES = "[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+"


def _matches(df: DataFrame, name: str, pattern: str, source: str = "body", masked: str | None = None) -> DataFrame:
    """Adds ``name``: array<struct(text, start, end)> of the pattern's matches in ``source``, in code points.

    ``masked`` adds the source with every match blanked out, lengths unchanged.
    """
    found, gaps = F.col("found__"), F.col("gaps__")
    df = df.withColumn("found__", F.regexp_extract_all(source, F.lit(pattern), F.lit(0)))
    df = df.withColumn("gaps__", F.when(F.size(found) > 0, F.split(source, pattern, -1)))
    lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    df = df.withColumn("ends__", F.when(F.size(found) > 0, prefix_sums(lengths)))
    spans = F.zip_with(found, "ends__", lambda m, e: F.struct(m.alias("text"), (e - F.length(m)).alias("start"), e.alias("end")))
    none = F.array().cast("array<struct<text:string,start:bigint,end:bigint>>")
    df = df.withColumn(name, F.coalesce(spans, none))
    if masked:
        blank = F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(F.repeat(F.lit(" "), F.length(m)), F.lit(""))))
        df = df.withColumn(masked, F.coalesce(F.array_join(blank, ""), F.col(source)))
    return df.drop("found__", "gaps__", "ends__")


def upper_tail(z: Column) -> Column:
    """-ln P(Z > z) for a standard normal Z, to a few per cent of P, far into the tail."""
    a = F.abs(z) + 1e-9
    tail = (1 - F.exp(-1.4 * a)) * F.exp(-a * a / 2) / (1.135 * 2.5066282746310002 * a)
    far = a * a / 2 + F.log(1.135 * 2.5066282746310002 * a) - F.log(1 - F.exp(-1.4 * a))
    return F.when(z > 0, far).otherwise(-F.log(1 - F.least(tail, F.lit(0.5))))


def _pick(text: Column, at: int) -> Column:
    out = F.lit(float(ENCODINGS[-1][at]))
    for row in reversed(ENCODINGS[:-1]):
        out = F.when(text.rlike(row[1]), F.lit(float(row[at]))).otherwise(out)
    return out


def measured(token: Column) -> Column:
    """The tests of one token: struct(start, end, class, level, random)."""
    text = token["text"]
    n = F.length(text).cast("double")
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    squares = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda s, c: s + F.pow(n - F.length(F.replace(text, c, F.lit(""))), F.lit(2.0)))
    codes = F.transform(letters, lambda c: F.ascii(c).cast("double"))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    changes = (F.size(F.regexp_extract_all(text, F.lit(CLASSES), F.lit(0))) - 1).cast("double")
    m = F.size(codes) - 1
    facts = F.struct(
        text.alias("text"), token["start"].alias("start"), token["end"].alias("end"), n.alias("n"), squares.alias("squares"),
        changes.alias("changes"), codes.alias("codes"), (total(codes) / n).alias("mean"), _pick(text, 2).alias("k"), _pick(text, 3).alias("same"),
        _pick(text, 4).alias("turn"), total(F.zip_with(F.slice(codes, 1, m), F.slice(codes, 2, m), lambda a, b: a * b)).alias("lagged"),
        total(F.transform(codes, lambda a: a * a)).alias("square_sum"))

    def tests(f: Column) -> Column:
        n, k, mean = f["n"], f["k"], f["mean"]
        chi = k / n * f["squares"] - n
        beyond = F.greatest(k * f["same"] - 1, F.lit(0.0))
        as_text = (k - 1 + n * beyond - chi) / F.sqrt(2 * (k - 1) + 4 * n * beyond)
        turns_in_text = (f["changes"] - (n - 1) * TEXT_CHANGES) / F.sqrt((n - 1) * TEXT_CHANGES * (1 - TEXT_CHANGES))
        uniform = (chi - (k - 1)) / F.sqrt(2 * (k - 1))
        runs = (f["changes"] - (n - 1) * f["turn"]) / F.sqrt((n - 1) * F.greatest(f["turn"] * (1 - f["turn"]), F.lit(1e-9)))
        spread = f["square_sum"] - n * mean * mean
        serial = F.when(spread > 0, (f["lagged"] - (n - 1) * mean * mean) / spread * F.sqrt(n)).otherwise(1e9)
        random = (f["turn"] > 0) & (uniform < LIMIT) & (F.abs(runs) < LIMIT) & (F.abs(serial) < LIMIT)
        evidence = upper_tail((as_text + turns_in_text) / 2 ** 0.5)
        length_class = sum(((n >= low).cast("int") for low in LENGTHS), F.lit(0))
        return F.struct(f["start"].alias("start"), f["end"].alias("end"), length_class.alias("class"),
                        F.least(F.floor(evidence * STEPS), F.lit(TOP_LEVEL)).cast("int").alias("level"), random.alias("random"))

    return tests(facts)


def thresholds(tokens: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Per length class the lowest level at which the step-up rule keeps false discoveries at ``rate``.

    ``tokens(class, level)`` are all tested tokens. Their histogram has at most
    ``TOP_LEVEL`` rows per class; a level stands for the largest p-value in it.
    """
    counts = tokens.groupBy("class", "level").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("class").orderBy(F.desc("level"))
    ranked = counts.withColumn("rank", F.sum("n").over(down)).withColumn("m", F.sum("n").over(Window.partitionBy("class")))
    passed = ranked.filter(F.exp(-F.col("level") / STEPS) * F.col("m") <= rate * F.col("rank"))
    return {r["class"]: r["level"] for r in passed.groupBy("class").agg(F.min("level").alias("level")).collect()}


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id and secrets: array<struct(kind, start, end)> in order, for every document.

    Kinds are assign, access, hex (the base patterns) and random (tokens that
    the battery finds; none of them touches a base span). A null text is
    empty; texts are read whole. Rows and ids repeat as they come, a null
    doc_id stays null, other columns are not read, an empty table gives no rows.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("body"))
    df = _matches(df, "assign", ASSIGN, masked="rest")
    for name, pattern in BASE[1:]:
        df = _matches(df, name, pattern)
    value = lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 1)) >= LEAST_VALUE
    df = df.withColumn("assign", F.filter("assign", value))
    spans = [_of_kind(F.col(name), kind) for kind, (name, _) in enumerate(BASE)]
    df = df.withColumn("base", F.array_sort(F.concat(*spans))).drop("body")
    # The other base matches consist of token characters, so they lie within one token.
    df = _matches(df, "token", TOKEN, "rest")
    known = "|".join(pattern for _, pattern in BASE[1:])
    df = df.withColumn("token", F.filter("token", lambda t: ~t["text"].rlike(known)))
    tested = write_and_read(df.select("doc_id", "base", F.transform("token", measured).alias("tested")), "secrets")
    limits = thresholds(tested.select(F.explode("tested").alias("t")).select("t.class", "t.level"), rate)
    floor = F.array(*[F.lit(limits.get(c, TOP_LEVEL + 1)) for c in range(len(LENGTHS) + 1)])
    more = F.filter("tested", lambda t: t["random"] & (t["level"] >= F.element_at(floor, t["class"] + 1)))
    added = _of_kind(more, len(BASE))
    names = F.array(*[F.lit(n) for n in [*(n for n, _ in BASE), "random"]])
    return tested.select("doc_id", F.transform(F.array_sort(F.concat("base", added)), lambda s: F.struct(
        F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("secrets"))


def secret_digest(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (each kind:start:end, comma-joined)."""
    found = find_secrets(docs, rate)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select("doc_id", *[count(k) for k, _ in BASE], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("secrets")).alias("spans"))
