"""Keyed state with timers: streams run twice, late rows, order of arrival, and state that is gone after its time."""

import random

from pyspark.sql import functions as F

from tallyrook.operators import store
from tallyrook.streaming import timers

c = F.col
SCHEMA = "k string, ms long, seq long, kind string, how string"


def run(spark, folder, at, processor, late="10 milliseconds"):
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    found = timers.ended(spark, stream, processor, c("ms"), c("seq"), c("kind"), late, at)
    return sorted(map(tuple, found.collect()))


def added(spark, folder, rows):
    spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3).write.mode("append").parquet(folder)


def state(spark, at, name):
    before = spark.conf.get(timers._PROVIDER)
    spark.conf.set(timers._PROVIDER, timers._ROCKS)
    try:
        return spark.read.format("statestore").option("stateVarName", name).load(f"{at}/state").count()
    finally:
        spark.conf.set(timers._PROVIDER, before)


def test_two_runs_late_rows_and_empty_state(spark):
    folder, at = store.fresh_path(spark, "in"), store.fresh_path(spark, "stream")
    processor = timers.Debounced(50, "k")
    added(spark, folder, [("a", 100, 1, None), ("a", 150, 2, None), ("a", 151, 3, None), ("b", 140, 1, None), ("b", 100, 2, None), (None, 100, 1, None), ("c", None, 1, None), ("z", 190, 1, None)])
    # The watermark is 180: what opened at 151 and 190 stays.
    assert run(spark, folder, at, processor) == [("a", 100, 150, 2, "run"), ("b", 100, 150, 2, "run")]
    assert state(spark, at, "held") + state(spark, at, "waiting") == 2
    # 180 is late for that watermark, 181 is not.
    added(spark, folder, [("a", 180, 4, None), ("a", 181, 5, None), ("b", 170, 3, None), ("y", 400, 1, None)])
    assert run(spark, folder, at, processor) == [("a", 100, 150, 2, "run"), ("a", 151, 201, 2, "run"), ("b", 100, 150, 2, "run"), ("z", 190, 240, 1, "run")]
    added(spark, folder, [("x", 2000, 1, None)])
    assert run(spark, folder, at, processor)[-1] == ("z", 190, 240, 1, "run") and ("y", 400, 450, 1, "run") in run(spark, folder, at, processor)
    assert (state(spark, at, "held"), state(spark, at, "waiting"), state(spark, at, "wake")) == (0, 1, 1), "only the last row's key has state"
    assert spark.conf.get(timers._PROVIDER) != timers._ROCKS


def expected(rows, after, now):
    """Recalls by a plain loop over each key's rows in order."""
    out = []
    for key in {r[0] for r in rows}:
        held = None
        for _, ms, _, kind in [*sorted(r for r in rows if r[0] == key), (key, now + 1, 0, "end")]:
            if held and held[0] + after < ms:
                if held[0] + after <= now:
                    out.append((key, held[0], held[0] + after, held[1], "expired"))
                held = None
            if ms > now:
                break
            how = {"ask": "replaced", "yes": "closed", "no": "discarded"}.get(kind)
            if held and how:
                out.append((key, held[0], ms, held[1], how))
            held = (ms, 1) if kind == "ask" else (held[0], held[1] + 1) if held and not how else None
    return sorted(out)


def test_recalls_whatever_the_order_of_arrival(spark):
    rng = random.Random(3)
    rows = [(f"k{int(rng.paretovariate(0.7)) % 9}", rng.randrange(1000), i, rng.choice(["ask", "yes", "no", "talk", None])) for i in range(400)]
    rows += [rows[0], rows[0]]
    now = max(r[1] for r in rows) - 600
    processor = timers.Recalls(40, "k", ("ask",), ("yes",), ("no",))
    for _ in range(2):
        folder, at = store.fresh_path(spark, "in"), store.fresh_path(spark, "stream")
        rng.shuffle(rows)
        # Within 600 milliseconds of the greatest time of the batches before, nothing is late: the first batch ends at 590.
        first = [r for r in rows if r[1] < 590 and rng.random() < 0.5]
        chosen = {id(r) for r in first}
        added(spark, folder, first)
        run(spark, folder, at, processor, "600 milliseconds")
        added(spark, folder, [r for r in rows if id(r) not in chosen])
        assert run(spark, folder, at, processor, "600 milliseconds") == expected(rows, 40, now)


def test_empty(spark):
    folder = store.fresh_path(spark, "in")
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    assert run(spark, folder, None, timers.Debounced(50, "k")) == []
