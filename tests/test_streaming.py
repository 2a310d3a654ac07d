"""Streams against the batch operators on the same rows."""

from __future__ import annotations

import numpy as np
import pytest

from wayfold.operators import detect, dglm
from wayfold.streaming import monitors


@pytest.fixture()
def run(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def go(rows, schema, build, parts=2, mode="append"):
        source = f"{tmp_path}/in"
        size = -(-len(rows) // parts)
        for at in range(0, len(rows), size):
            spark.createDataFrame(rows[at : at + size], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = build(stream).writeStream.format("memory").queryName("seen").outputMode(mode).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None
        return spark.sql("SELECT * FROM seen").collect()

    return go


def test_bayes_monitor_equals_batch(spark, run):
    h = np.random.default_rng(1).normal(size=80).round(3).tolist()
    rows = [(0, t, x) for t, x in enumerate(h)]
    made = {r["slot"]: (r["log_l"], r["run_len"]) for r in run(rows, "agent long, slot long, h double", lambda s: monitors.bayes_stream(s, -3.0))}
    batch = detect.cumulative_bayes_factor(spark.createDataFrame(rows, "agent long, slot long, h double"), ["agent"]).collect()
    assert all(abs(made[r["slot"]][0] - r["log_l"]) < 1e-9 and made[r["slot"]][1] == r["run_len"] for r in batch)


def test_model_monitor_equals_batch(run):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=30), (rng.random(30) < 0.4).astype(int)
    rows = [(0, t, int(b), float(a)) for t, (a, b) in enumerate(zip(x, y, strict=True))]
    made = {r["slot"]: r["p_hat"] for r in run(rows, "agent long, slot long, y int, x double", lambda s: monitors.model_stream(s, ["x"]))}
    p, _, _ = dglm.filtered(y.astype(float), np.ones(30), x[:, None], dglm.Design(1), dglm.State.prior(2, 50.0))
    assert np.allclose([made[t] for t in range(30)], p)


def moves(run, rows, parts=2):
    made = run(rows, "agent long, at string, zone long", lambda s: monitors.transition_stream(s.selectExpr("agent", "to_timestamp(at) as ts", "zone"), "3 hours"), parts)
    return sorted((r["agent"], str(r["ts"])[11:13], r["origin"], r["dest"]) for r in made)


END = [(9, "2024-01-03 00:00:00", 0)]  # moves the watermark on


def test_transitions_across_batches(run):
    rows = [(1, f"2024-01-01 0{t}:00:00", z) for t, z in enumerate([5, 5, 6, 7])]
    assert moves(run, rows + END) == [(1, "01", 5, 5), (1, "02", 5, 6), (1, "03", 6, 7)]


def test_a_position_that_comes_a_batch_late_takes_its_place(run):
    rows = [(1, "2024-01-01 00:00:00", 5), (1, "2024-01-01 02:00:00", 7), (2, "2024-01-01 02:30:00", 1), (1, "2024-01-01 01:00:00", 6)]
    assert moves(run, rows + END, 3) == [(1, "01", 5, 6), (1, "02", 6, 7)]


def test_windows_and_sessions(spark, run):
    rows = [(1, f"2024-01-01 {t:02d}:00:00", 5) for t in (0, 1, 2, 9, 10)] + [(1, "2024-01-02 12:00:00", 6)]
    made = run(rows, "agent long, at string, zone long", lambda s: monitors.stay_stream(s.selectExpr("agent", "to_timestamp(at) as ts", "zone")), 1)
    assert sorted(r["n"] for r in made if r["zone"] == 5) == [2, 3]
    batch = spark.createDataFrame(rows, "agent long, at string, zone long").selectExpr("agent", "to_timestamp(at) as ts", "zone")
    assert monitors.event_count_stream(batch).count() == 6


def test_occupancy_counts_each_agent_once(run):
    rows = [(a, f"2024-01-01 0{h}:{m:02d}:00", 5 + a % 2) for h in (0, 1) for m in (0, 20, 59) for a in range(5) if a < 4 or h] + END
    made = run(rows, "agent long, at string, zone long", lambda s: monitors.occupancy_stream(s.selectExpr("agent", "to_timestamp(at) as ts", "zone")), 3)
    assert sorted((str(r["start"])[11:13], r["zone"], r["n"]) for r in made) == [("00", 5, 2), ("00", 6, 2), ("01", 5, 3), ("01", 6, 2)]
