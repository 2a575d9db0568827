"""The upsert moves a batch once by key, and hot keys alone are cut into chunks."""

import random

from pyspark.sql import functions as F

from alertloom.operators import identity as I
from tests.test_cases import ALERT, T0, version


def alerts(spark, rows):
    return spark.createDataFrame(rows, ALERT.replace("seq long", "id long"))


def test_a_batch_without_hot_keys_is_shuffled_once(spark):
    stored = alerts(spark, [(7, 1, "k1", "t", T0, "d", "low", None, "pending", "h1", "v1", None)])
    batch = spark.createDataFrame([version(i, f"k{i % 3}", "d", "low", f"h{i % 2}") for i in range(12)], ALERT)
    plan = I.classify(batch, stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_hot_and_other_keys_give_the_same_chains(spark):
    """Brute force over chains; two alerts are stored under one key, and the smaller id stands for them."""
    rng = random.Random(11)
    stored = [(9, 1, "k0", "t", T0, "old", "low", None, "pending", "h0", "v1", None), (5, 1, "k0", "t", T0, "kept", "low", None, "pending", "h0", "v1", None),
              (8, 1, "k1", "t", T0, "d1", "low", None, "pending", "h1", "v1", None)]
    rows = [version(i, rng.choice(["k0", "k0", "k0", "k1", "k2"]), f"d{rng.randint(0, 2)}", "low", f"h{rng.randint(0, 2)}") for i in range(60)]
    state = {"k0": (5, "h0", "kept"), "k1": (8, "h1", "d1")}
    want = {}
    for seq, _, key, _, _, description, _, _, _, h, _, _ in rows:
        at, old_hash, old = state.get(key, (None, None, None))
        action = "created" if old_hash is None else "ignored" if old_hash == h else "updated"
        fields = ([] if old == description else ["description"]) or ["locations_or_minor"]
        want[seq] = (action, at, old_hash, fields if action == "updated" else None)
        state[key] = (at, h, description if action != "ignored" else old)
    batch, current = spark.createDataFrame(rows, ALERT), alerts(spark, stored)
    new = I.stable_id(F.lit("id\u00011\u0001k2"))
    k2 = spark.range(1).select(new.alias("id")).first().id
    for chunk_rows in (2, 15, 1_000):
        got = {r.seq: (r.action, None if r.alert_id == k2 else r.alert_id, r.previous_hash, r.changed_fields) for r in I.classify(batch, current, chunk_rows).collect()}
        assert got == want
