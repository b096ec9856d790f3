"""Heavy keys, broken references and attribute history against hand-made cases and brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mnemosa.operators.chunks import range_chunks, with_rank
from mnemosa.operators.history import attribute_history
from mnemosa.operators.references import broken_references
from mnemosa.operators.skew import heavy_keys, key_profile

T0 = dt.datetime(2023, 7, 1)
h = lambda n: T0 + dt.timedelta(hours=n)
FACT = "uuid string, entity_id string, slot string, content string, created_at timestamp_ntz, updated_at timestamp_ntz, temporal_status string, superseded_at timestamp_ntz, superseded_by string, n string, state_no int, `_at` string, run int, say string"
SLOT = "name string, embedding array<float>, created_at timestamp_ntz"


def fact(uuid, entity="e", slot="pet", content="a cat", at=0, changed=None, status="current", ends=None, by=None):
    return (uuid, entity, slot, content, at if at is None else h(at), h(changed if changed is not None else 1000), status, None if ends is None else h(ends), by, "x", 1, "x", 1, "x")


def history(spark, rows, slots=("pet", "wake_time")):
    found = attribute_history(spark.createDataFrame(rows, FACT), spark.createDataFrame([(s, None, T0) for s in slots], SLOT))
    return {(r.entity_id, r.slot, r.uuid): ((r.valid_from - T0).total_seconds() / 3600, r.valid_to and (r.valid_to - T0).total_seconds() / 3600) for r in found.collect()}


def test_profile_counts_hot_and_null_keys(spark):
    rows = [("Hot ", h(i)) for i in range(70)] + [(" hot", h(99)), ("cold", None), (None, h(1)), ("", h(2)), ("  ", None)] + [("cold", h(5))] * 2
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz").withColumn("key", F.lit("clash")).withColumn("_at", F.lit(1))
    got = {r.key: (r.n_rows, r.first_at, r.last_at) for r in key_profile(df, "k", "at").collect()}
    assert got == {"hot": (71, h(0), h(99)), "cold": (3, h(5), h(5))}
    assert [r.key for r in heavy_keys(df, "k", "at", 0.05).collect()] == ["hot"]
    assert heavy_keys(df.limit(0), "k", "at").count() == 0


def test_hot_key_sends_one_row_per_task(spark):
    plan = key_profile(spark.range(10).select(F.lit("a").alias("k"), F.lit(T0).cast("timestamp_ntz").alias("at")), "k", "at")._jdf.queryExecution().toString()
    assert "partial_count" in plan


def test_references(spark):
    schema = "uuid string, conversation_id string, created_at timestamp_ntz, reason string, `_fk` string"
    child = [("m1", "C1", h(5), "", ""), ("m1", " c1", h(5), "", ""), ("m2", "c2 ", h(1), "", ""), ("m3", "gone", None, "", ""), ("m4", None, h(1), "", ""), ("m5", " ", h(1), "", ""), ("m6", "c2", h(9), "", ""), ("m7", "c1", None, "", ""), ("m8", "mark", h(1), "", "")]
    parent = [("c1", "", h(0), "", ""), ("c2", "", h(3), "", "")]
    c, p = spark.createDataFrame(child, schema), spark.createDataFrame(parent, schema)
    got = sorted((r.uuid, r.ref_month, r.reason) for r in broken_references(c, "f", "conversation_id", p, True, ("mark",)).collect())
    assert got == [("m2", "2023-07", "late"), ("m3", "unknown", "missing")]
    got = sorted(r.uuid for r in broken_references(c, "f", "conversation_id", p, False).collect())
    assert got == ["m3", "m8"]
    assert broken_references(c.limit(0), "f", "conversation_id", p, True).count() == 0
    assert broken_references(c, "f", "conversation_id", p.limit(0), True).filter("reason = 'late'").count() == 0


def test_history_cases(spark):
    rows = [
        fact("a", content="A cat!", at=0), fact("b", content="a  CAT", at=1), fact("c", content="a dog", at=2, ends=4), fact("d", content="a hen", at=6),
        fact("e1", entity="x", slot="Wake-Time", content="6:00", at=0, ends=-5, by="E2"), fact("e2", entity="y", slot="wake  time", content="7:00", at=3),
        fact("g", entity="z", at=5, status=" Historical ", changed=8), fact("g2", entity="z", slot="none", at=6), fact("i", entity="w", at=5, by="nobody"),
        fact("j", entity=None, at=1), fact("k", entity="v", at=None), fact("l", entity="u", slot=None, at=1), fact("m", entity="t", content=None, at=1), fact("m2", entity="t", content="", at=2),
        fact("n", entity="s", at=1, by="consolidated", status="historical", changed=2), fact("n", entity="s", at=1, by="consolidated", status="current", changed=1),
    ]
    got = history(spark, rows)
    assert got == {
        ("e", "pet", "a"): (0, 2), ("e", "pet", "c"): (2, 4), ("e", "pet", "d"): (6, None), ("x", "wake_time", "e1"): (0, 3), ("y", "wake_time", "e2"): (3, None), ("z", "pet", "g"): (5, 8),
        ("w", "pet", "i"): (5, None), ("t", "pet", "m"): (1, None), ("s", "pet", "n"): (1, 2),
    }
    assert history(spark, []) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_history_of_hot_key_equals_fold(spark, seed, monkeypatch):
    import mnemosa.operators.history as H

    monkeypatch.setattr(H, "FOLD", 5)
    r = random.Random(seed)
    rows = [fact(f"u{i:03d}", content=r.choice(["one", "One.", "two"]), at=r.randrange(60), ends=r.choice([None, None, r.randrange(80)])) for i in range(150)]
    rows += [fact(f"v{i:02d}", entity="calm", content="same", at=i) for i in range(40)]
    want = {}
    for e in ("e", "calm"):
        mine = sorted((x for x in rows if x[1] == e), key=lambda x: (x[4], x[0]))
        runs = []
        for x in mine:
            say = x[3].lower().strip(".")
            if runs and runs[-1][0] == say:
                runs[-1][2] = x
            else:
                runs.append([say, x, x])
        for i, (_, first, last) in enumerate(runs):
            ends = [t for t in (last[7] if last[7] and last[7] >= last[4] else None, runs[i + 1][1][4] if i + 1 < len(runs) else None) if t]
            want[e, "pet", first[0]] = ((first[4] - T0).total_seconds() / 3600, (min(ends) - T0).total_seconds() / 3600 if ends else None)
    assert history(spark, rows) == want


def test_rank_over_chunks(spark):
    rows = [("hot", i * 37 % 200) for i in range(200)] + [("b", 1), ("b", 2)]
    got = with_rank(range_chunks(spark.createDataFrame(rows, "k string, v int"), ["k"], ["v"], 6), ["k"], ["v"]).collect()
    assert len({r["_chunk"] for r in got if r.k == "hot"}) > 1
    assert all(r["rank"] == (r.v + 1 if r.k == "hot" else r.v) for r in got)
