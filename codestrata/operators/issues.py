"""Issues, obligations and scores over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import flow
from ..functions.common import lookup, round_half_up
from .windows import first_per, latest_per

# Weights of evidence and of verification states.
STATUS_WEIGHT = {"Confirmed": 100, "Likely": 72, "Possible": 38, "Unknown": 12}
STATE_SCORE = {"proved": 100, "observed": 62, "violated": 20, "unproved": 28, "blocked": 12}
GRADE_WEIGHT = {
    "heuristic": 0.45, "parser": 0.62, "compiler": 0.76, "knowledge": 0.68, "runtime": 0.9, "benchmark": 0.95, "formal": 1.0,
}
SEVERITY_RANK = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}
STATUS_RANK = {"Confirmed": 4, "Likely": 3, "Possible": 2, "Unknown": 1}
STRUCTURE_PAIRS = {
    "transaction": (
        r"(?i)\b(?:beginTransaction|BEGIN\s+TRANSACTION|(?:db|session|transaction)\.begin)\b", r"(?i)\b(?:commit|rollback)\s*\("),
    "resource": (
        r"(?i)\b(?:open|fopen|connect|acquire|lock)\s*\(|new\s+(?:FileInputStream|FileOutputStream|Socket)\b",
        r"(?i)\b(?:close|fclose|dispose|unlock|release)\s*\(|\btry\s*\("),
    "lifecycle": (
        r"(?:\.start\s*\(|\bstart[A-Z_]\w*\s*\()",
        r"(?:\.(?:stop|shutdown|terminate|dispose)\s*\(|\b(?:stop|shutdown|terminate|dispose)[A-Z_]\w*\s*\()"),
}


def union_issues(parts: Sequence[DataFrame]) -> DataFrame:
    """Issues of all sources; of equal (project, category, title, evidence) the first source's stays."""
    tagged = [p.withColumn("_src", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    return first_per(out, ["project_id", "category", "title", "evidence"], ["_src", "issue_id"]).drop("_src")


def union_obligations(parts: Sequence[DataFrame]) -> DataFrame:
    """Obligations of all sources, the last one per id; of several in one source the one with the largest values."""
    tagged = [p.withColumn("_src", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    keys = ["project_id", "obligation_id"]
    rest = sorted(set(parts[0].columns) - set(keys))
    return latest_per(out, keys, ["_src", *rest]).drop("_src")


def evidence_audit(issues: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Weighted evidence of a project's issues and its state (``runtime_confirmed`` column counts usable runs)."""
    count = {s: F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUS_WEIGHT}
    out = issues.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), *count.values(),
        F.count_if(F.col("evidence").rlike("heuristic")).alias("heuristic_candidates"),
        F.max("runtime_confirmed").alias("runtime_confirmed"))
    score = sum((F.col(s.lower()) * w for s, w in STATUS_WEIGHT.items()), F.lit(0))
    weak, strong = F.col("possible") + F.col("unknown"), F.col("confirmed") + F.col("likely")
    return out.withColumn("score", round_half_up(score / F.col("total"))).withColumn(
        "audit_status", F.when((weak == 0) & (F.col("runtime_confirmed") > 0), "closed").when(strong > weak, "partial")
        .otherwise("heuristic"))


def penalty_score(issues: DataFrame, keys: Sequence[str] = ("project_id",), name: str = "score") -> DataFrame:
    """100 minus the severity penalties, at least 0."""
    total = issues.groupBy(*keys).agg(F.sum(flow.severity_penalty(F.col("severity"))).alias("_p"))
    return total.select(*keys, F.greatest(F.lit(0), 100 - F.col("_p")).alias(name))


def closure_score(nodes: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Closure of the flow map: penalties per node state and per breakpoint."""
    penalty = F.when(F.col("status") == "Open", 18).when(F.col("status") == "Overflow Risk", 14).when(
        F.col("status") == "Blocked", 16).when(F.col("status") == "Unknown", 6).otherwise(0)
    total = nodes.groupBy(*keys).agg(F.sum(penalty + F.when(F.col("is_stop"), 4).otherwise(0)).alias("_p"))
    return total.select(*keys, F.greatest(F.lit(0), 100 - F.col("_p")).alias("closure_score"))


def grouped_report(issues: DataFrame) -> DataFrame:
    """Issues of one category and title: highest confidence, strongest severity and state, distinct locations."""
    title = F.lower(F.trim(F.regexp_replace("title", r"\s+", " ")))
    rank = lambda col, table: lookup(F.col(col), table, 1)
    # distinct locations are counted after collapsing repeated ones
    per_place = issues.groupBy("project_id", "category", title.alias("title_key"), "evidence").agg(
        F.count(F.lit(1)).alias("_n"), F.max("confidence").alias("_c"), F.max(rank("severity", SEVERITY_RANK)).alias("_s"),
        F.max(rank("status", STATUS_RANK)).alias("_t"))
    out = per_place.groupBy("project_id", "category", "title_key").agg(
        F.sum("_n").alias("occurrences"), F.count(F.lit(1)).alias("locations"), F.max("_c").alias("confidence"),
        F.max("_s").alias("_s"), F.max("_t").alias("_t"))
    back = lambda col, table: lookup(F.col(col), {v: k for k, v in table.items()})
    return out.select("project_id", "category", "title_key", "occurrences", "locations", "confidence",
                      back("_s", SEVERITY_RANK).alias("severity"), back("_t", STATUS_RANK).alias("status"))


def file_summary(files: DataFrame, functions: DataFrame, issues: DataFrame) -> DataFrame:
    """Functions, roles (at most five) and issues of each file; an issue names its file as ``path:line``."""
    per_fn = functions.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("function_count"), F.slice(F.array_sort(F.collect_set("role")), 1, 5).alias("roles"))
    # the mention of a file is read off the evidence once, so the match is an equi-join
    named = issues.select(F.regexp_extract("evidence", r"([\w./-]+\.[A-Za-z]+)", 1).alias("path")).where("path <> ''")
    per_issue = named.groupBy("path").agg(F.count(F.lit(1)).alias("issue_count"))
    return files.join(per_fn, "file_id", "left").join(per_issue, "path", "left").select(
        "file_id", "path", F.coalesce("function_count", F.lit(0)).alias("function_count"),
        F.coalesce("roles", F.array().cast("array<string>")).alias("roles"), F.coalesce("issue_count", F.lit(0)).alias("issue_count"))


def obligation_score(state: Column, grade: Column, confidence: Column) -> Column:
    return round_half_up(lookup(state, STATE_SCORE, 12) * lookup(grade, GRADE_WEIGHT, 0.45) * (0.6 + confidence / 250))


def issue_obligations(issues: DataFrame) -> DataFrame:
    """Every issue as something to verify."""
    text = F.lower("evidence")
    grade = (
        F.when(text.contains("runtime"), "runtime").when(text.contains("compiler") | text.contains("lsp"), "compiler")
        .when(text.contains("parser") | text.contains("tree-sitter") | text.contains("ast"), "parser")
        .when(text.contains("knowledge"), "knowledge").otherwise("heuristic"))
    domain = lookup(F.col("category"), {
        "security": "security", "performance": "performance", "environment": "environment", "flow": "stability"}, "functionality")
    state = F.when(F.col("status") == "Confirmed", "violated").when(F.col("status") == "Likely", "observed").otherwise("unproved")
    return issues.select(
        "project_id", F.concat(F.lit("verify-issue-"), F.col("issue_id").cast("string")).alias("obligation_id"),
        domain.alias("domain"), state.alias("state"), grade.alias("grade"), "confidence")


def verification_report(obligations: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Score of a project's obligations, capped by its best evidence."""
    out = obligations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("obligations"),
        *[F.count_if(F.col("state") == s).alias(f"{s}_count") for s in STATE_SCORE],
        *[F.count_if(F.col("grade") == g).alias(f"{g}_evidence") for g in ("formal", "runtime", "benchmark")],
        F.sum(obligation_score(F.col("state"), F.col("grade"), F.col("confidence"))).alias("_sum"))
    open_ = F.col("violated_count") + F.col("unproved_count") + F.col("blocked_count") > 0
    cap = F.when((F.col("formal_evidence") > 0) & ~open_, 100).when(
        (F.col("benchmark_evidence") > 0) & (F.col("runtime_evidence") > 0), 82).when(F.col("runtime_evidence") > 0, 72).otherwise(48)
    return out.withColumn("cap", cap).withColumn(
        "score", F.least(F.col("cap"), round_half_up(F.col("_sum") / F.col("obligations")))).drop("_sum")


def structural_pairs(functions: DataFrame) -> DataFrame:
    """Functions that acquire something, and whether they release it."""
    rows = F.array_compact(F.array(*[
        F.when(F.col("body").rlike(acq), F.struct(F.lit(kind).alias("kind"), F.col("body").rlike(rel).alias("released")))
        for kind, (acq, rel) in STRUCTURE_PAIRS.items()
    ]))
    return functions.select("function_id", F.inline(rows))


def exception_lines(functions: DataFrame, limit: int | None = None) -> DataFrame:
    """Lines that raise explicitly, or the first ``limit`` of each function."""
    lines = F.transform(F.split("body", r"\r?\n"), lambda l, i: F.struct(i.cast("long").alias("offset"), F.trim(l).alias("predicate")))
    hits = F.filter(lines, lambda l: l["predicate"].rlike(r"\b(throw|raise)\b"))
    hits = F.slice(hits, 1, limit) if limit else hits
    return functions.select("function_id", F.inline(hits))


def contract_coverage(functions: DataFrame, clauses: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Share of functions with a clause, clauses by kind and by strength of evidence."""
    per_fn = clauses.groupBy("function_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("kind") == "security").alias("_sec"),
        F.count_if(F.col("grade").isin("compiler", "lsp", "ast")).alias("_strong"))
    out = functions.join(per_fn, "function_id", "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("functions"), F.count("_n").alias("covered"), F.coalesce(F.sum("_n"), F.lit(0)).alias("clauses"),
        F.coalesce(F.sum("_sec"), F.lit(0)).alias("security_clauses"), F.coalesce(F.sum("_strong"), F.lit(0)).alias("strong_clauses"))
    return out.withColumn("status", F.when(F.col("clauses") == 0, "empty").when(
        (F.col("covered") == F.col("functions")) & (F.col("strong_clauses") > 0), "contract-ready").otherwise("partial"))


def repair_gates(runs: DataFrame, static_pass: DataFrame, counterexamples: DataFrame) -> DataFrame:
    """Gates of every repair candidate from its paired baseline and candidate runs.

    ``runs``: ``variant, side`` (``baseline``/``candidate``), ``experiment_kind, status, isolated, stdout, leaked, seq``;
    ``static_pass``: ``variant, static_pass``; ``counterexamples``: ``variant`` rows with an open counterexample.
    """
    ok = (F.col("status") == "passed") & F.col("isolated")
    regression = runs.where("experiment_kind = 'baseline'").groupBy("variant", "side").agg(
        F.max_by(F.struct(ok.alias("ok"), F.sha2("stdout", 256).alias("out")), "seq").alias("_r"))
    base = regression.where("side = 'baseline'").select("variant", F.col("_r").alias("_b"))
    cand = regression.where("side = 'candidate'").select("variant", F.col("_r").alias("_c"))
    paired = base.join(cand, "variant", "full_outer").select(
        "variant", F.coalesce(F.col("_b.ok") & F.col("_c.ok") & (F.col("_b.out") == F.col("_c.out")), F.lit(False)).alias("regression"))
    others = runs.where("side = 'candidate'").groupBy("variant").agg(
        (F.count_if((F.col("experiment_kind") == "stress") & ok) >= 16).alias("benchmark"),
        F.bool_or((F.col("experiment_kind") == "security") & ok & ~F.col("leaked")).alias("security"))
    open_ = counterexamples.select("variant").distinct().withColumn("_open", F.lit(True))
    joined = static_pass.join(paired, "variant", "left").join(others, "variant", "left").join(open_, "variant", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    formal = F.col("_open").isNull()
    passed = sum((F.when(c, 1).otherwise(0) for c in (
        flag("static_pass"), formal, flag("regression"), flag("benchmark"), flag("security"))), F.lit(0))
    return joined.select(
        "variant", flag("static_pass").alias("static_pass"), formal.alias("formal"), flag("regression").alias("regression"),
        flag("benchmark").alias("benchmark"), flag("security").alias("security"),
        F.when(~formal, "rejected").when(passed >= 5, "eligible").otherwise("proposed").alias("status"))
