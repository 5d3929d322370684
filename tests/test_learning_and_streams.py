"""Classifier gates and streaming jobs driven to completion."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codestrata.operators import learning as L, runs as R
from codestrata.sources import sinks
from codestrata.streaming import jobs


def test_head_learns_separable_classes(spark):
    rng = random.Random(3)
    rows = []
    for i in range(90):
        c = i % 3
        rows.append((i, c, [0.8 + rng.random() * 0.1 if d == c * 4 else rng.random() * 0.1 for d in range(14)]))
    v = spark.createDataFrame(rows, "vec_id int, class_index int, dims array<double>")
    model, stats = L.train_head(v, 14, 3)
    assert list(model.getLayers()) == [14, 12, 3] and stats["validated"]
    totals = L.score_head(model, v).groupBy("vec_id").agg(F.sum("score").alias("s")).agg(F.min("s"), F.max("s")).first()
    assert abs(totals[0] - 1) < 1e-3 and abs(totals[1] - 1) < 1e-3


def test_label_match_prefix_filter_is_exact(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    vec = [(i, sorted(set(rng.choices(words, k=rng.randint(1, 6))))) for i in range(60)]
    lab = [(i, None, sorted(set(rng.choices(words + ["never"], k=rng.randint(1, 9)))), 0.0) for i in range(40)]
    got = L.match_labels(spark.createDataFrame(vec, "vec_id int, tokens array<string>"),
                         spark.createDataFrame(lab, "label_id int, target int, tokens array<string>, boost double"), 0.3)
    want = {(l, v) for l, _, lt, _ in lab for v, vt in vec if min(1, len(set(lt) & set(vt)) / min(len(lt), 8)) >= 0.3 and set(lt) & set(vt)}
    assert {(r["label_id"], r["vec_id"]) for r in got.collect()} == want


def test_equal_votes_stay_equal_in_any_order(spark):
    """0.1 + 0.2 + 0.3 is more than 0.3 + 0.3 in floating point, or not, as the rows come; as votes they are the same."""
    votes = [("b", 0.1), ("b", 0.2), ("b", 0.3), ("a", 0.3), ("a", 0.3)]
    rows = [(vec, label, i, 100, 100, m, True) for vec, part in ((1, votes), (2, votes[::-1])) for i, (label, m) in enumerate(part)]
    rows += [(3, "a", 7, 100, 100, 0.54, True), (3, "b", 8, 100, 100, 0.46, True)]  # a lead of 0.08 is not below 0.08
    c = spark.createDataFrame(rows, "vec_id int, label string, label_id int, trust int, label_confidence int, match_score double, targeted boolean").coalesce(1)
    got = {r.vec_id: (r.teacher_label, r.consensus, r.margin, r.quarantine_reason) for r in L.vote(c).collect()}
    assert got == {1: ("a", 50, 0.0, "teacher_conflict"), 2: ("a", 50, 0.0, "teacher_conflict"), 3: ("a", 54, 0.08, None)}


def test_nearest_rank_on_one_hot_group(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("k"), (F.col("id") * 7919 % 10007 - 300).alias("v"))
    got = {r["k"]: (r["p50"], r["p95"]) for r in R.nearest_rank(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r["k"], []).append(r["v"])
    import math
    for k, vs in groups.items():
        vs.sort()
        assert got[k] == tuple(vs[max(1, math.ceil(len(vs) * p)) - 1] for p in (0.5, 0.95))


RUNS = "project_id long, experiment_kind string, sample_id string, status string, duration_ms long, ts timestamp"


def _source(spark, path, rows, schema):
    spark.createDataFrame(rows, "struct<>" if not rows else schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame(rows, schema).schema).parquet(path)


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def _stress(project, sample, status="passed", ms=1, memory=1, sandbox="container", day=1):
    return (project, "stress", sample, status, ms, datetime(2024, 1, day), memory, sandbox)


BATCH_RUNS = RUNS + ", peak_memory_bytes long, sandbox_kind string"
GATE = ["run_count", "passed_count", "failure_rate", "p95_duration_ms", "peak_memory_bytes", "strongly_isolated", "eligible"]


def test_stress_batch_completes_at_sixteen(spark, tmp_path):
    rows = [_stress(1, f"stress-bounded-16x-9-{i:02d}", ms=i + 1, memory=100 - i) for i in range(16)]
    rows += [_stress(2, "stress-bounded-16x-9-00", "failed")]
    rows += [_stress(3, f"stress-bounded-16x-7-{i:02d}", "failed" if i == 3 else "passed", ms=5) for i in range(16)]
    rows += [_stress(4, f"stress-bounded-16x-7-{i:02d}", sandbox="none" if i == 15 else "container") for i in range(16)]
    src = _source(spark, str(tmp_path / "r"), rows, BATCH_RUNS)
    out = {r["project_id"]: r for r in _drain(jobs.stress_batch_stream(src), "batches").collect()}
    assert [out[1][c] for c in GATE] == [16, 16, 0, 16, 100, True, True]
    assert [out[3][c] for c in GATE] == [16, 15, 6, 5, 1, True, False]
    assert [out[4][c] for c in GATE] == [16, 16, 0, 1, 1, False, False]
    assert set(out) == {1, 3, 4} and all(r["complete"] and r["revision"] == 1 for r in out.values())
    batch = R.stress_batches(spark.createDataFrame(rows, BATCH_RUNS)).where("run_count >= 16").collect()
    assert {r["project_id"]: [r[c] for c in GATE] for r in batch} == {k: [r[c] for c in GATE] for k, r in out.items()}


def test_late_runs_give_a_batch_anew_and_silence_ends_it(spark, tmp_path):
    path, cp, out = str(tmp_path / "r"), str(tmp_path / "cp"), str(tmp_path / "out")
    first = [_stress(1, f"stress-bounded-16x-9-{i:02d}", ms=i + 1) for i in range(16)] + [_stress(2, "stress-bounded-16x-9-00", "failed")]
    late = [_stress(1, f"stress-bounded-16x-9-{i:02d}", "failed" if i >= 38 else "passed", ms=i + 1) for i in range(16, 40)]
    for rows in (first, late + [_stress(9, "stress-bounded-16x-1-00", day=3)]):
        q = jobs.stress_batch_stream(_source(spark, path, rows, BATCH_RUNS)).writeStream.format("parquet").option(
            "path", out).option("checkpointLocation", cp).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    got = {(r["project_id"], r["revision"]): (r["run_count"], r["failure_rate"], r["p95_duration_ms"], r["eligible"], r["complete"])
           for r in spark.read.parquet(out).collect()}
    assert got == {(1, 1): (16, 0, 16, True, True), (1, 2): (40, 5, 38, True, True), (2, 1): (1, 100, 1, False, False)}


def test_windowed_statistics(spark, tmp_path):
    rows = [(1, "stress", "s", "passed" if i < 15 else "failed", i + 1, datetime(2024, 1, 1, 0, i)) for i in range(16)]
    out = _drain(jobs.run_statistics_stream(_source(spark, str(tmp_path / "r"), rows, RUNS)), "stats", "update").collect()
    assert (out[0]["sample_count"], out[0]["failure_rate"], out[0]["p50_duration_ms"], out[0]["p95_duration_ms"]) == (16, 6, 8, 16)


def test_trace_stream_drops_repeats(spark, tmp_path):
    line = 'TRACE {"functionName":"f","event":"enter"}'
    rows = [(1, "stdout", 1, line, datetime(2024, 1, 1)), (1, "stdout", 1, line, datetime(2024, 1, 1, 0, 1)), (1, "stdout", 2, "noise", datetime(2024, 1, 1))]
    src = _source(spark, str(tmp_path / "t"), rows, "run_id long, source string, seq long, line string, ts timestamp")
    assert _drain(jobs.trace_stream(src), "traces").count() == 1


def test_pack_lifecycle_stream(spark, tmp_path):
    rows = [("a", "signed", 95, 1), ("a", "activate", 0, 2), ("b", "signed", 95, 3), ("b", "activate", 0, 4), ("c", "quarantined", 40, 5), ("c", "activate", 0, 6)]
    src = _source(spark, str(tmp_path / "e"), rows, "pack_id string, event string, score int, seq long")
    assert jobs.read_packs(spark, str(tmp_path / "log")).count() == 0
    jobs.pack_stream(src, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r["pack_id"]: r["status"] for r in jobs.read_packs(spark, str(tmp_path / "log")).collect()}
    assert got == {"a": "superseded", "b": "active", "c": "quarantined"}


def test_reindex_hands_over_changed_files_only(spark, tmp_path):
    seen, schema = [], "project_id int, path string, content string, seq long"
    path, process = str(tmp_path / "f"), lambda df: seen.append({r["path"] for r in df.collect()})
    for rows in ([(0, "a", "1", 1), (0, "b", "1", 1)], [(0, "a", "2", 2), (0, "b", "1", 2)]):
        jobs.reindex_stream(_source(spark, path, rows, schema), str(tmp_path / "i"), str(tmp_path / "cp"), process).awaitTermination(120)
    assert seen == [{"a", "b"}, {"a"}]


def test_journal_stream_keeps_newest(spark, tmp_path):
    src = _source(spark, str(tmp_path / "j"), [(1, "x", 1), (1, "y", 2), (2, "z", 1)], "k int, v string, ts long")
    jobs.journal_stream(src, str(tmp_path / "t"), ["k"], ["ts"], str(tmp_path / "cp")).awaitTermination(120)
    now = sinks.read_latest(spark, str(tmp_path / "t"), "k int, v string, ts long", ["k"], ["ts"])
    assert {(r["k"], r["v"]) for r in now.collect()} == {(1, "y"), (2, "z")}


def test_a_delivery_written_twice_counts_once(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, v string, ts long"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    sinks.append_rows(frame([(1, "x", 1), (2, "y", 1)]), path, ["k"], "a")
    sinks.append_rows(frame([(1, "z", 2)]), path, ["k"], "b")
    sinks.append_rows(frame([(1, "x", 1), (2, "y", 1)]), path, ["k"], "a")
    assert sorted(tuple(r) for r in sinks.read_rows(spark, path, schema).collect()) == [(1, "x", 1), (1, "z", 2), (2, "y", 1)]
    assert sinks.read_latest(spark, path, schema, ["k"], ["ts"], without="b").where("k = 1").first()["v"] == "x"


def test_reindex_that_fails_half_way_loses_no_file(spark, tmp_path):
    seen, schema = [], "project_id int, path string, content string, seq long"
    src, args = _source(spark, str(tmp_path / "f"), [(0, "a", "1", 1), (0, "b", "1", 1)], schema), (str(tmp_path / "i"), str(tmp_path / "cp"))

    def fails(df):
        raise RuntimeError("lost")

    broken = jobs.reindex_stream(src, *args, fails)
    with pytest.raises(Exception, match="lost"):
        broken.awaitTermination(120)
    for _ in range(2):
        jobs.reindex_stream(src, *args, lambda df: seen.append({r["path"] for r in df.collect()})).awaitTermination(120)
    assert seen == [{"a", "b"}]
