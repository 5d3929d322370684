"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.runs import BATCH_PATTERN
from ..sources.feeds import pack_state
from ..sources.sinks import append_rows, read_latest, upsert_table
from ..sources.traces import parse_lines

BATCH_SIZE = 16
MAX_FAILURE_RATE = 5
LATE_MS = 3_600_000


def trace_stream(lines: DataFrame, delay: str = "10 minutes", prefix: str = "TRACE ") -> DataFrame:
    """Parsed trace events (``lines`` also has ``ts``), repeated deliveries within the watermark dropped."""
    stamped = lines.select("run_id", "source", "seq", "line", "ts")
    times = F.struct("seq", "ts").alias("seq")
    events = parse_lines(stamped.select("run_id", "source", times, "line"), prefix)
    flat = events.withColumn("ts", F.col("seq.ts")).withColumn("seq", F.col("seq.seq"))
    return flat.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "source", "seq"])


def run_statistics_stream(runs: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts, failure rate and approximate percentiles per project and time window (``ts`` event time)."""
    return (
        runs.withWatermark("ts", delay).groupBy(F.window("ts", window), "project_id").agg(
            F.count(F.lit(1)).alias("sample_count"), F.count_if(F.col("status") == "passed").alias("passed_count"),
            F.max("duration_ms").alias("max_duration_ms"),
            F.percentile_approx("duration_ms", [0.5, 0.95], 10_000).alias("_p"))
        .select(
            F.col("window.start").alias("window_start"), "project_id", "sample_count", "passed_count", "max_duration_ms",
            F.floor((F.col("sample_count") - F.col("passed_count")) / F.col("sample_count") * 100 + 0.5).alias("failure_rate"),
            F.col("_p")[0].alias("p50_duration_ms"), F.col("_p")[1].alias("p95_duration_ms")))


BATCH_SCHEMA = (
    "project_id long, batch string, run_count long, passed_count long, failure_rate long, p95_duration_ms long, "
    "peak_memory_bytes long, strongly_isolated boolean, eligible boolean, complete boolean, revision int")
BATCH_COLUMNS = [field.split()[0] for field in BATCH_SCHEMA.split(", ")]
_STATE = "passed long, peak long, last long, isolated boolean, revision int, durations array<long>, counts array<long>"


def _batch_row(key: tuple, passed: int, peak: int, isolated: bool, revision: int, durations: dict[int, int]) -> tuple:
    runs = sum(durations.values())
    rank, p95 = math.ceil(runs * 0.95), 0
    for value, times in sorted(durations.items()):
        p95, rank = value, rank - times
        if rank <= 0:
            break
    failed = math.floor((runs - passed) / runs * 100 + 0.5)
    full = runs >= BATCH_SIZE
    return (*key, runs, passed, failed, p95, peak, isolated, full and failed <= MAX_FAILURE_RATE and isolated, full, revision)


def _gate_batch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counters and a histogram of durations are all the state of a batch, whatever the number of its runs."""
    passed, peak, last, isolated, revision, values, counts = state.get if state.exists else (0, 0, 0, True, 0, [], [])
    durations = dict(zip(values, counts))
    if state.hasTimedOut:
        state.remove()
        rows = [] if revision else [_batch_row(key, passed, peak, isolated, 1, durations)]
        yield pd.DataFrame(rows, columns=BATCH_COLUMNS)
        return
    for frame in frames:
        passed += int((frame["status"] == "passed").sum())
        peak, last = max(peak, int(frame["peak_memory_bytes"].max())), max(last, int(frame["ms"].max()))
        isolated = isolated and bool((frame["sandbox_kind"] != "none").all())
        for value, times in frame["duration_ms"].value_counts().items():
            durations[int(value)] = durations.get(int(value), 0) + int(times)
    rows = []
    if sum(durations.values()) >= BATCH_SIZE:
        revision += 1
        rows.append(_batch_row(key, passed, peak, isolated, revision, durations))
    state.update((passed, peak, last, isolated, revision, list(durations), list(durations.values())))
    state.setTimeoutTimestamp(max(last + LATE_MS, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(rows, columns=BATCH_COLUMNS)


def stress_batch_stream(runs: DataFrame, delay: str = "2 hours") -> DataFrame:
    """A stress batch with its training gate, emitted as soon as sixteen of its runs have arrived.

    The gate asks for sixteen runs, at most 5 % of failures and isolation of every run, as :func:`stress_batches` does.
    Late runs of an emitted batch emit it anew with the next ``revision``; the highest one counts.  All times are event
    times (``ts``), so a replay gives the same rows: a batch without a run for an hour past the watermark is forgotten,
    and emitted as not complete if it never filled up; runs later than ``delay`` are dropped by the watermark.  Missing
    figures count as 0, a missing sandbox as none.
    """
    batch = F.regexp_extract("sample_id", BATCH_PATTERN, 1)
    stress = runs.withWatermark("ts", delay).where((F.col("experiment_kind") == "stress") & (batch != "")).select(
        "ts", F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("ms"),
        F.col("project_id").cast("long").alias("project_id"), batch.alias("batch"), F.coalesce("status", F.lit("")).alias("status"),
        *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("duration_ms", "peak_memory_bytes")],
        F.coalesce("sandbox_kind", F.lit("none")).alias("sandbox_kind"))
    return stress.groupBy("project_id", "batch").applyInPandasWithState(
        _gate_batch, BATCH_SCHEMA, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _delivery(checkpoint: str, batch_id: int) -> str:
    """Name of a micro-batch that stays the same when it is replayed and differs between streams."""
    return f"{zlib.crc32(checkpoint.encode()):08x}-{batch_id:012d}"


def _append(stream: DataFrame, checkpoint: str, write):
    def each(batch: DataFrame, batch_id: int) -> None:
        write(batch, _delivery(checkpoint, batch_id))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def journal_stream(rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], checkpoint: str):
    """Keyed latest-wins journal, read by :func:`read_latest`; a micro-batch writes its own rows only."""
    return _append(rows, checkpoint, lambda batch, name: upsert_table(batch, path, keys, order, name))


PACK_EVENTS = "pack_id string, event string, score int, seq long"


def pack_stream(events: DataFrame, log_path: str, checkpoint: str):
    """Appends pack events to a log by pack; :func:`read_packs` derives the states from it."""
    named = events.select("pack_id", "event", F.col("score").cast("int").alias("score"), F.col("seq").cast("long").alias("seq"))
    return _append(named, checkpoint, lambda batch, name: append_rows(batch, log_path, ["pack_id"], name))


def read_packs(spark: SparkSession, log_path: str) -> DataFrame:
    """State of every pack; an event delivered twice counts once."""
    return pack_state(read_latest(spark, log_path, PACK_EVENTS, ["pack_id", "seq"], ["seq"]))


FILE_INDEX = "project_id long, path string, hash string, seq long"


def reindex_stream(files: DataFrame, index_path: str, checkpoint: str, process):
    """Hands only files with a new content hash to ``process`` and remembers them in the index.

    The index grows after ``process`` is through.  A replayed micro-batch does not see what it wrote itself, so its
    files are handed over again (at least once) rather than lost.
    """
    def write(batch: DataFrame, name: str) -> None:
        keyed = batch.withColumn("hash", F.sha2("content", 256))
        index = read_latest(batch.sparkSession, index_path, FILE_INDEX, ["project_id", "path"], ["seq"], without=name)
        process(keyed.join(index.select("project_id", "path", "hash"), ["project_id", "path", "hash"], "left_anti"))
        entries = keyed.select(F.col("project_id").cast("long").alias("project_id"), "path", "hash", F.col("seq").cast("long").alias("seq"))
        upsert_table(entries, index_path, ["project_id", "path"], ["seq"], name)

    return _append(files, checkpoint, write)
