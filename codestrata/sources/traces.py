"""Trace logs and run outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.taint import BOUNDARY_PATTERNS
from ..operators.windows import top_n
from ..session import cut

GRAM = 6
EVENT_KINDS = ("enter", "exit", "error", "transfer")
TRACE_SCHEMA = "struct<functionName:string,event:string,dataNames:array<string>,`from`:string,`to`:string>"
FINDING_MARKS = ("AddressSanitizer", "UndefinedBehaviorSanitizer", "runtime error:", "ThreadSanitizer")


def parse_lines(lines: DataFrame, prefix: str = "TRACE ") -> DataFrame:
    """Well-formed events of four kinds with a function name.

    ``lines`` has ``run_id, source, seq, line``; a stdout line must carry ``prefix``, a sidecar line is bare JSON.
    Works on a stream as well as on a table.
    """
    text = F.trim("line")
    payload = F.when(F.col("source") == "sidecar", text).when(
        text.startswith(prefix), F.substring(text, len(prefix) + 1, 2_000_000_000))
    parsed = lines.withColumn("_e", F.from_json(payload, TRACE_SCHEMA))
    return parsed.where(
        F.col("_e.event").isin(*EVENT_KINDS) & (F.trim(F.col("_e.functionName")) != "")
    ).select(
        "run_id", "source", "seq", F.col("_e.functionName").alias("function_name"), F.col("_e.event").alias("event"),
        F.col("_e.dataNames").alias("data_names"), F.col("_e.from").alias("from_name"), F.col("_e.to").alias("to_name"))


def read_traces(lines: DataFrame, prefix: str = "TRACE ", cap: int | None = None) -> DataFrame:
    """Sidecar events of a run win over its stdout events; ``cap`` keeps the first events of each run."""
    events = parse_lines(lines, prefix)
    sidecar_runs = events.where("source = 'sidecar'").select("run_id").distinct()
    kept = events.where("source = 'sidecar'").unionByName(
        events.where("source <> 'sidecar'").join(sidecar_runs, "run_id", "left_anti"))
    return top_n(kept, ["run_id"], [F.col("seq")], cap) if cap else kept


def sanitizer_findings(stderr: Column, limit: int | None = None, width: int | None = None) -> Column:
    """Distinct finding lines of a run, sorted; ``width`` cuts the lines, ``limit`` their number."""
    lines = F.filter(F.split(stderr, r"\r?\n"), _any_mark)
    out = F.array_sort(F.array_distinct(F.transform(lines, lambda l: F.substring(F.trim(l), 1, width) if width else F.trim(l))))
    return F.slice(out, 1, limit) if limit else out


def _any_mark(line: Column) -> Column:
    cond = F.lit(False)
    for mark in FINDING_MARKS:
        cond = cond | F.contains(line, F.lit(mark))
    return cond


def leaf_strings(payload: Column, longest: int | None = None) -> Column:
    """String values of a JSON text at any depth (keys excluded), or the trimmed text when it is not JSON.

    The pattern consumes keys (literal and colon) as well as values, and captures the values only.
    """
    literal = r"\"(?:[^\"\\]|\\.)*\"\s*:|\"((?:[^\"\\]|\\.)*)\""
    values = F.transform(
        F.regexp_extract_all(payload, F.lit(literal), 1),
        lambda v: F.get_json_object(F.concat(F.lit('{"v":"'), v, F.lit('"}')), "$.v"))
    plain = F.when(F.length(F.trim(payload)) >= 4, F.array(F.trim(payload))).otherwise(F.array().cast("array<string>"))
    out = F.when(F.try_parse_json(payload).isNotNull(), values).otherwise(plain)
    return F.filter(F.array_sort(F.array_distinct(out)), lambda v: F.length(v).between(4, longest) if longest else F.length(v) >= 4)


def leaks(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """Input values of a run that turn up in its outputs (``stdin, stdout, stderr``)."""
    values = leaf_strings(F.col("stdin"))
    values = F.slice(values, 1, limit) if limit else values
    each = runs.select("run_id", "stdout", "stderr", F.explode(values).alias("value"))
    sinks = F.array_compact(F.array(
        F.when(F.contains("stdout", F.col("value")), F.lit("<stdout>")),
        F.when(F.contains("stderr", F.col("value")), F.lit("<stderr>"))))
    return each.select(
        "run_id", F.concat(F.lit("taint-"), F.substring(F.sha2("value", 256), 1, 12)).alias("label"),
        F.explode(sinks).alias("sink"))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], size: str, stamp: str) -> DataFrame:
    """Created, deleted and modified files between two snapshots."""
    old = before.select(*keys, F.col(size).alias("before_bytes"), F.col(stamp).alias("_s0"), F.lit(True).alias("_old"))
    new = after.select(*keys, F.col(size).alias("after_bytes"), F.col(stamp).alias("_s1"), F.lit(True).alias("_new"))
    kind = (
        F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted")
        .when((F.col("before_bytes") != F.col("after_bytes")) | (F.col("_s0") != F.col("_s1")), "modified"))
    joined = old.join(new, keys, "full_outer").withColumn("kind", kind)
    return joined.where("kind IS NOT NULL").select(*keys, "kind", "before_bytes", "after_bytes")


def boundaries(functions: DataFrame, limit: int | None = None) -> DataFrame:
    """Places where control leaves the analysed program, by five patterns.

    A control character is put before every match and the body is cut there, so each piece after the first starts with
    a match; the line of a match is the number of line breaks before it.
    """
    mark = "\x01"
    plain = F.translate("body", mark, "")
    kinds = []
    for kind, pattern in BOUNDARY_PATTERNS.items():
        pieces = F.split(F.regexp_replace(plain, f"({pattern})", mark + "$1"), mark)
        hits = F.slice(pieces, 2, F.size(pieces))
        hits = F.slice(hits, 1, limit) if limit else hits
        rows = functions.where(F.col("body").rlike(pattern)).select(
            "project_id", "function_id", "start_line", pieces.alias("_pieces"), F.posexplode(hits).alias("occurrence", "_hit"))
        before = F.array_join(F.slice("_pieces", 1, F.col("occurrence") + 1), "")
        rest = F.array_join(F.slice("_pieces", F.col("occurrence") + 2, F.size("_pieces")), "")
        kinds.append(rows.select(
            "project_id", "function_id", F.lit(kind).alias("kind"), F.col("occurrence").cast("long").alias("occurrence"),
            (F.col("start_line") + F.regexp_count(before, F.lit(r"\n"))).cast("long").alias("line"),
            F.trim(F.element_at(F.split(F.substring(rest, 1, 120), r"\r?\n"), 1)).alias("expression")))
    out = kinds[0]
    for part in kinds[1:]:
        out = out.unionByName(part)
    return out


def _grams(text: Column, size: int | Column) -> Column:
    """Distinct substrings of ``size`` characters."""
    width = F.lit(size) if isinstance(size, int) else size
    pieces = F.transform(F.sequence(F.lit(1), F.length(text) - width + 1), lambda i: F.substr(text, i, width))
    return F.when(F.length(text) >= width, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def observe_boundaries(found: DataFrame, events: DataFrame) -> DataFrame:
    """C17: a boundary is observed when a transfer from its kind names no target or one found in its expression.

    Targets are looked up in an index of the distinct expressions by substrings of up to six characters.  A target can
    only occur where all its substrings do, so one with a substring in no expression is dropped, and the others meet
    the expressions that hold their rarest substring.  Repeated expressions are searched once.  An expression or target
    that is null counts as one without text and without target.
    """
    seen = cut(events.where("event = 'transfer'").select(
        F.regexp_extract("from_name", r"^<(.*)>$", 1).alias("_kind"),
        F.lower(F.trim(F.coalesce("to_name", F.lit("")))).alias("_target")).where("_kind <> ''").distinct())
    blank = F.col("_target").isin("", "unknown")
    whole = seen.where(blank).select("_kind").distinct().withColumn("_all", F.lit(True))
    width = F.least(F.length("_target"), F.lit(GRAM))
    named = seen.where(~blank).withColumn("_q", width)
    sizes = sorted(row[0] for row in named.select("_q").distinct().collect())  # GRAM of them at most
    text = F.lower(F.coalesce("expression", F.lit("")))
    out = found.withColumn("_kind", F.col("kind")).withColumn("_text", text).join(whole, "_kind", "left")
    hit = F.col("_all")
    if sizes:
        grams = F.array_distinct(F.concat(*[_grams(F.col("_text"), q) for q in sizes]))
        index = cut(found.select(F.col("kind").alias("_kind"), text.alias("_text")).distinct().select(
            "_kind", "_text", F.explode(grams).alias("_gram")))
        known = index.groupBy("_kind", "_gram").agg(F.count(F.lit(1)).alias("_f"))
        parts = named.select("_kind", "_target", F.explode(_grams(F.col("_target"), F.col("_q"))).alias("_gram"))
        keys = parts.join(known, ["_kind", "_gram"], "left").groupBy("_kind", "_target").agg(
            F.min_by("_gram", F.struct("_f", "_gram")).alias("_gram"), F.bool_and(F.col("_f").isNotNull()).alias("_whole")).where("_whole")
        hits = keys.join(index, ["_kind", "_gram"]).where(F.contains("_text", F.col("_target"))).select("_kind", "_text").distinct()
        out = out.join(hits.withColumn("_named", F.lit(True)), ["_kind", "_text"], "left")
        hit = F.coalesce(hit, F.col("_named"))
    status = F.when(hit, "runtime-observed").otherwise("static-candidate")
    return out.select(*found.columns, status.alias("status"))
