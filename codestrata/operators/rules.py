"""Rule evaluation over functions (C03, D02, D03, F01, B35, D16, rule evidence)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import flow, taint
from ..functions.common import clamp, flags, lookup, nonempty, round_half_up
from ..functions.rule_table import (
    CONTEXTS, MUTATION_WORDS, PATTERN_SIGNALS, RULES, STRUCTURAL_SIGNALS, WEAK_TOKEN_BAD, WEAK_TOKEN_GOOD, Context, Rule,
)
from .windows import top_n

SEARCHED = (
    "name", "path", "language", "return_type", "data_shape", "summary", "body", "source", "parser",
)


def rules_frame(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    return spark.createDataFrame(
        [(r.rule_id, r.category, r.severity, r.base, list(r.signals), list(r.tags), r.language) for r in rules],
        "rule_id string, category string, severity string, base double, signals array<string>, tags array<string>, "
        "language string")


def _structural(name: str) -> Column:
    text = F.col("_text")
    if name in PATTERN_SIGNALS:
        return text.rlike(PATTERN_SIGNALS[name])
    parser = F.concat_ws(" ", "parser", F.concat_ws(" ", "parse_evidence"))
    return {
        "outdegree = 0": F.col("out_degree") == 0,
        "return missing": ~flow.has_real_output(F.col("outputs")),
        "sideeffects empty": F.size("side_effects") == 0,
        "unknown + typed": F.exists("params", lambda p: p.rlike("(?i)unknown|any")),
        "parser fact": F.col("source") == "Parser Fact",
        "ast": parser.rlike("(?i)ast|compiler|typescript"),
        "heuristic": (F.col("source") == "Heuristic") | F.col("parser").rlike("(?i)heuristic"),
        "entry function": (F.col("in_degree") == 0) & (F.col("out_degree") > 0),
        "call edge": F.col("in_degree") + F.col("out_degree") > 0,
        "unreachable function": F.col("in_degree") + F.col("out_degree") == 0,
        "calls itself": F.col("self_call"),
        "recursive": text.rlike(r"\brecurs") | F.col("self_call"),
    }.get(name, F.lit(False))


def matched_signals(rules: Sequence[Rule]) -> Column:
    """All signals a function shows, one pass over its text per kind of signal.

    Whole-word signals are found by intersecting the set of words of the text, the others by substring search; the
    cost does not depend on how many rules share a signal.
    """
    names = list(dict.fromkeys(s for r in rules for s in r.signals))
    special = [s for s in names if s in STRUCTURAL_SIGNALS]
    words = [s for s in names if s not in STRUCTURAL_SIGNALS and re.fullmatch("[a-z0-9_]+", s)]
    parts = [s for s in names if s not in STRUCTURAL_SIGNALS and s not in words]
    text = F.col("_text")
    tokens = F.regexp_extract_all(text, F.lit("[a-z0-9_]+"), 0)
    found = [
        F.array_intersect(F.array(*map(F.lit, words)), tokens) if words else None,
        F.filter(F.array(*map(F.lit, parts)), lambda s: F.contains(text, s)) if parts else None,
        flags([(s, _structural(s)) for s in special]) if special else None,
    ]
    return F.concat(*[f for f in found if f is not None])


def _context_condition(ctx: Context) -> Column:
    text = F.col("_text")
    terms = [text.rlike(p) for p in ctx.need] + [~text.rlike(p) for p in ctx.forbid]
    if ctx.need_or_input:
        terms.append(text.rlike(ctx.need_or_input) | nonempty(F.col("external_inputs")))
    if ctx.signals:
        terms.append(F.arrays_overlap("matched", F.array(*map(F.lit, ctx.signals))))
    if ctx.any_of:
        terms.append(reduce(
            lambda a, b: a | b, [text.rlike(p) & (text.rlike(q) if q else F.lit(True)) for p, q in ctx.any_of]))
    if ctx.extra:
        terms.append({
            "no-validations": ~nonempty(F.col("validations")),
            "open-leaf": (F.col("out_degree") == 0) & ~flow.has_real_output(F.col("outputs"))
            & (F.size("side_effects") == 0),
            "graph-root": (F.col("in_degree") == 0) & (F.col("out_degree") > 0),
            "weak-token-check": ~text.rlike(WEAK_TOKEN_GOOD) | text.rlike(WEAK_TOKEN_BAD),
            "two-mutations": F.size(F.filter(F.array(*map(F.lit, MUTATION_WORDS)), lambda w: F.contains(text, w))) >= 2,
        }[ctx.extra])
    return reduce(lambda a, b: a & b, terms)


def rule_matches(functions: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per (function, rule) that applies.

    ``functions`` carries its degrees.  Rules are a small literal array, so the evaluation is a map: no join with the
    rule table and no shuffle.  The context condition of a rule is only evaluated for functions that show its signals.
    """
    text = F.lower(F.concat_ws(
        "\n", *SEARCHED, F.concat_ws(" ", "params"), F.concat_ws(" ", "outputs"), F.concat_ws(" ", "parse_evidence")))
    seen = functions.withColumn("_text", text).withColumn("_seen", matched_signals(rules))
    table = F.array(*[
        F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"),
            F.lit(r.base).alias("base"), F.array(*map(F.lit, r.signals)).alias("signals"),
            F.array(*map(F.lit, r.tags)).alias("tags"))
        for r in rules
    ])
    # only rules that own one of the seen signals are looked at
    owners: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for signal in r.signals:
            owners.setdefault(signal, []).append(i)
    by_signal = F.create_map(*[c for s, ids in owners.items() for c in (F.lit(s), F.array(*map(F.lit, ids)))])
    wanted = F.array_distinct(F.flatten(F.transform("_seen", lambda s: by_signal[s])))
    hits = F.transform(wanted, lambda i: F.get(table, i).withField(
        "matched", F.array_intersect(F.get(table, i)["signals"], F.col("_seen"))))
    rows = seen.withColumn("_r", F.explode(hits)).select("*", "_r.rule_id", "_r.severity", "_r.base", "_r.tags",
                                                         F.col("_r.category").alias("rule_category"),
                                                         F.col("_r.matched").alias("matched"))
    condition = None
    for r in rules:
        if r.rule_id in CONTEXTS:
            term = _context_condition(CONTEXTS[r.rule_id])
            condition = F.when(F.col("rule_id") == r.rule_id, term) if condition is None else condition.when(
                F.col("rule_id") == r.rule_id, term)
    if condition is not None:
        rows = rows.where(condition.otherwise(F.lit(True)))
    grade = taint.rule_evidence_grade(F.col("source"), F.col("parser"), F.col("parse_evidence"))
    rows = rows.withColumn("evidence_grade", grade)
    parser_bonus = F.when(F.col("source") == "Parser Fact", 5).when(F.contains("parser", F.lit("Compiler")), 7).otherwise(0)
    own = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (F.col("confidence") - 70) / 4))
    raw = round_half_up(F.col("base") * 100 + parser_bonus + F.least(F.lit(10), F.size("matched") * 3) + own)
    raw = F.greatest(F.lit(45), F.least(F.lit(96), raw))
    score = F.when(F.col("evidence_grade") == "heuristic", F.least(F.lit(68), raw)).otherwise(raw)
    return rows.select(
        "project_id", "function_id", "rule_id", "rule_category", "severity", "tags", "matched", "evidence_grade",
        score.cast("long").alias("match_confidence"))


def rule_summary(matches: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Totals per project; functions are counted after collapsing each function to one row."""
    per_fn = matches.groupBy(*keys, "function_id").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col("severity") == s).alias(f"_{s}") for s in ("critical", "risk", "warn", "info")])
    return per_fn.groupBy(*keys).agg(
        F.sum("_n").alias("total_matches"), F.count(F.lit(1)).alias("matched_functions"),
        *[F.sum(f"_{s}").alias(f"{s}_count") for s in ("critical", "risk", "warn", "info")])


def severity_weight(severity: Column) -> Column:
    return lookup(severity, flow.RULE_SEVERITY_WEIGHT, 1)


def top_matches(matches: DataFrame, n: int = 10, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """most severe, then most certain matches of each project."""
    order = [F.desc(severity_weight(F.col("severity"))), F.desc("match_confidence"), F.col("function_id"), F.col("rule_id")]
    return top_n(matches, keys, order, n, "match_rank")


def risk_label(rule_id: Column) -> Column:
    """Risk written onto a function for a matched rule."""
    return (
        F.when(rule_id.isin("security-sql-injection", "security-orm-raw-query")
               | rule_id.rlike("sqlalchemy|queryraw|java-sql"), "sql-injection")
        .when(rule_id.isin("security-command-exec", "language-api-node-exec", "language-api-python-subprocess")
              | rule_id.rlike("java-runtime|c-system"), "command-execution")
        .when(rule_id.isin("security-path-traversal", "language-api-node-readfile", "language-api-python-open"),
              "path-traversal")
        .when(rule_id.contains("c-strcpy"), "overflow")
        .when(rule_id.contains("device-offline"), "device-offline")
        .when(rule_id.contains("watchdog"), "watchdog-missing")
        .when(rule_id == "efficiency-unbounded-growth", "overflow")
        .when(rule_id == "stability-infinite-loop", "infinite-loop")
        .otherwise(rule_id)
    )


def apply_matches(functions: DataFrame, matches: DataFrame) -> DataFrame:
    """Functions with the risks of their matches and an averaged confidence.

    A function has at most one match per rule, so the collected sets are bounded by the rule table.
    """
    per_fn = matches.groupBy("function_id").agg(
        F.collect_set(F.when(F.col("severity") != "info", risk_label(F.col("rule_id")))).alias("_risks"),
        F.greatest(F.lit(50), F.max("match_confidence")).alias("_best"))
    joined = functions.join(per_fn, "function_id", "left")
    own = F.greatest(F.lit(35), F.least(F.lit(96), round_half_up((F.col("confidence") + F.col("_best")) / 2)))
    return joined.select(
        *[c for c in functions.columns if c not in ("risks", "confidence")],
        F.array_union("risks", F.coalesce(F.array_sort("_risks"), F.array().cast("array<string>"))).alias("risks"),
        F.coalesce(own, F.col("confidence")).cast("long").alias("confidence"))


def rule_issues(matches: DataFrame, k: int = 20, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """The ``k`` most severe non-informational matches of each project as issues."""
    best = top_matches(matches.where(F.col("severity") != "info"), k, keys)
    effective = F.when(F.col("evidence_grade") == "heuristic", F.least(F.lit(68), F.col("match_confidence"))).otherwise(
        F.col("match_confidence"))
    return best.select(
        *keys, "function_id", F.col("rule_id").alias("title"), "match_rank",
        flow.issue_category(F.col("rule_category"), F.col("tags"), F.col("severity")).alias("category"),
        lookup(F.col("severity"), flow.RULE_TO_ISSUE_SEVERITY, "Low").alias("severity"),
        F.when((F.col("evidence_grade") != "heuristic") & (effective >= 76), "Likely").otherwise("Possible").alias("status"),
        effective.cast("long").alias("confidence"))


def rule_evidence(rules: DataFrame) -> DataFrame:
    """Evidence rows a rule calls for: a static one always, runtime and dependency ones by tag and category."""
    kind = F.when(F.col("category") == "security", "regex").when(F.col("category") == "language_api", "ast").otherwise("type")
    runtime = F.arrays_overlap("tags", F.array(*map(F.lit, ("timeout", "retry", "concurrency", "memory"))))
    dependency = (F.col("category") == "language_api") | F.arrays_overlap(
        "tags", F.array(*map(F.lit, ("node", "python", "go", "rust", "database"))))
    weight = lambda d: F.greatest(F.lit(0.5), F.round(F.col("base") - d, 2))
    rows = F.array_compact(F.array(
        F.struct(kind.alias("evidence_type"), F.col("base").alias("weight")),
        F.when(runtime, F.struct(F.lit("runtime").alias("evidence_type"), weight(0.08).alias("weight"))),
        F.when(dependency, F.struct(F.lit("dependency").alias("evidence_type"), weight(0.06).alias("weight")))))
    return rules.select("rule_id", F.inline(rows))


def rule_coverage(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """Per area, 0.68 of the count ratio plus 0.32 of the required-tag ratio.

    ``targets`` has ``category, target_count, required_tags``; a rule covers a tag when it carries it.
    """
    counts = rules.groupBy("category").agg(F.count(F.lit(1)).alias("rule_count"))
    tags = rules.select("category", F.explode("tags").alias("tag")).distinct()
    wanted = targets.select("category", F.explode("required_tags").alias("tag"))
    covered = wanted.join(tags, ["category", "tag"], "left_semi").groupBy("category").agg(F.count(F.lit(1)).alias("covered"))
    joined = targets.join(counts, "category", "left").join(covered, "category", "left").fillna(0, ["rule_count", "covered"])
    return joined.select(
        "category", "rule_count", "target_count", (F.size("required_tags") - F.col("covered")).alias("missing_tags"),
        round_half_up(percent(F.col("rule_count"), F.col("target_count")) * 0.68
                      + percent(F.col("covered"), F.size("required_tags")) * 0.32).alias("coverage"))


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage, at most 100."""
    return F.least(F.lit(100), round_half_up(F.try_divide(part * 100.0, whole)))


def library_audit(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Per category, 0.42 of the entry, 0.34 of the core-domain and 0.24 of the core-entry percentage.

    ``entries``: category, domain, maturity; ``targets``: category, target_count, core_domains.
    """
    counts = entries.groupBy("category").agg(
        F.count(F.lit(1)).alias("entry_count"),
        *[F.count_if(F.col("maturity") == m).alias(f"{m}_count") for m in ("core", "extended", "planned")])
    wanted = targets.select("category", F.explode("core_domains").alias("domain"))
    covered = wanted.join(entries.select("category", "domain").distinct(), ["category", "domain"], "left_semi").groupBy(
        "category").agg(F.count(F.lit(1)).alias("covered_domains"))
    joined = targets.join(counts, "category", "left").join(covered, "category", "left").fillna(0)
    need = F.greatest(F.lit(1.0), F.col("target_count") * 0.62)
    score = round_half_up(
        percent(F.col("entry_count"), F.col("target_count")) * 0.42
        + percent(F.col("covered_domains"), F.size("core_domains")) * 0.34
        + percent(F.col("core_count"), need) * 0.24)
    out = joined.withColumn("percent", F.greatest(F.lit(0), F.least(F.lit(100), score)))
    status = (
        F.when((F.col("percent") >= 82) & (F.col("entry_count") >= F.col("target_count")), "mature")
        .when(F.col("percent") >= 58, "partial").otherwise("needed"))
    return out.withColumn("status", status)


# Target count and required tags per rule area.
AREA_TARGETS = (
    ("math", 8, "graph capacity confidence boundary coverage"),
    ("algorithm", 8, "big-o graph search sort stream"),
    ("efficiency", 12, "concurrency database memory io blocking orm index"),
    ("security", 18, "taint injection xss ssrf auth crypto csrf cors jwt dependency framework"),
    ("stability", 14, "timeout retry transaction cleanup idempotency lock device hardware"),
    ("language_api", 24, "javascript python go rust java c cpp orm framework hardware security stability"),
)


def area_targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(c, n, t.split()) for c, n, t in AREA_TARGETS], "category string, target_count int, required_tags array<string>")


# Entries of each kind a seeded library should hold; levels of seeds without signed sources.
LIBRARY_TARGETS = {
    "version_constraint": 18, "sdk_api": 18, "fault_sample": 20, "benchmark": 16, "repair_recipe": 16, "environment": 10, "hardware": 10,
}
SEED_LEVELS = {"traceability": 42, "freshness": 24, "conflict_control": 30}
SEED_BENCHMARK, SEED_REPAIR = 44, 22


def data_quality(entries: DataFrame, keys: Sequence[str] = ("library_id",)) -> DataFrame:
    """Data quality of knowledge libraries from the entries they hold (``kind``; other kinds do not count).

    Coverage is the mean share of the seven targets; benchmarks and repairs count by being there at all.
    """
    counts = entries.groupBy(*keys).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in LIBRARY_TARGETS])
    shares = sum((F.least(F.lit(100.0), F.col(k) / n * 100) for k, n in LIBRARY_TARGETS.items()), F.lit(0.0))
    levels = {k: F.lit(v).cast("long").alias(k) for k, v in SEED_LEVELS.items()}
    out = counts.select(
        *keys, clamp(round_half_up(shares / len(LIBRARY_TARGETS)), 0, 100).alias("coverage"), *levels.values(),
        F.when(F.col("benchmark") > 0, SEED_BENCHMARK).otherwise(0).cast("long").alias("benchmark_reproducibility"),
        F.when(F.col("repair_recipe") > 0, SEED_REPAIR).otherwise(0).cast("long").alias("repair_verification"))
    score = (
        F.col("coverage") * 0.34 + F.col("traceability") * 0.2 + F.col("freshness") * 0.12 + F.col("benchmark_reproducibility") * 0.14
        + F.col("repair_verification") * 0.12 + F.col("conflict_control") * 0.08)
    out = out.withColumn("score", clamp(round_half_up(score), 0, 100))
    return out.withColumn("status", F.when(F.col("score") >= 82, "validated").when(F.col("score") >= 55, "reviewable").otherwise("seed"))
