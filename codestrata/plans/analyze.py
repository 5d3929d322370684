"""The whole workspace analysis as one set of lazily composed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import flow
from ..functions.rule_table import RULES
from ..operators import binding, edges as E, issues as I, pointsto as P, rules as R, taint as T
from ..session import cut
from ..sources import code, manifests, tree
from . import reports


def extract_facts(files: DataFrame) -> dict[str, DataFrame]:
    """Files (``project_id, file_id, path, content``) to functions, calls, declarations and dependencies."""
    described = files if "language" in files.columns else files.withColumn(
        "language", tree.detect_language(F.col("path"), F.col("content")))
    functions = code.function_facts(code.extract_functions(described)).withColumn(
        "function_id", F.concat_ws(":", "file_id", "name", "start_line"))
    functions = functions.withColumn("summary", F.concat_ws(" ", "name", F.concat_ws(" ", "params"), F.concat_ws(" ", "outputs")))
    functions = cut(functions.withColumn("source", F.lit("Heuristic")).withColumn("parser", F.lit("SignatureScan")).withColumn(
        "parse_evidence", F.array(F.concat(F.col("language"), F.lit(" signature rule")))))
    declarations, fields = code.extract_declarations(described)
    return {
        "files": described, "functions": functions, "calls": E.resolve_calls(functions), "declarations": declarations, "fields": fields,
        "dependencies": manifests.dependencies(described), "routes": code.web_routes(described),
    }


def analyze(files: DataFrame, cfg: DataFrame | None = None, rules=RULES) -> dict[str, DataFrame]:
    """Facts, rule matches, flow roles, issues and scores; with control-flow facts also taint and points-to."""
    facts = extract_facts(files)
    functions = facts["functions"]
    edges = cut(E.build_edges(functions, facts["calls"]).withColumn("ord", F.xxhash64("dst")))
    deg = E.degrees(edges)
    f = functions.join(deg, functions.function_id == deg.node, "left").drop("node").fillna(0, ["in_degree", "out_degree"]).withColumn(
        "self_call", F.lit(False))
    matches = cut(R.rule_matches(f, rules))
    applied = R.apply_matches(f, matches)
    nodes = applied.withColumn("is_stop", F.lit(False)).withColumn("status", flow.node_status(
        F.col("risks"), F.col("validations"), F.col("external_inputs"), F.col("outputs"), F.col("out_degree"), F.lit(False)))
    modules = reports.module_labels(nodes)
    issues = R.rule_issues(matches).withColumn("issue_id", F.concat_ws("/", "function_id", "title")).withColumn(
        "evidence", F.concat(F.lit("heuristic "), F.col("function_id").cast("string")))
    out = {
        **facts, "edges": edges, "matches": matches, "nodes": nodes, "modules": reports.module_rollup(modules, edges), "issues": issues,
        "entries": reports.entry_functions(nodes), "rule_summary": R.rule_summary(matches), "readiness": reports.readiness(nodes),
        "panel": reports.query_panel(nodes, edges), "security_score": I.penalty_score(issues.where("category = 'security'")),
        "bindings": binding.bind_arguments(functions, edges),
    }
    if cfg is not None:
        variables, _ = T.taint_fixpoint(functions, cfg, edges)
        out["taint"] = variables
        out["sinks"] = T.sink_verdicts(functions, variables)
        out["points_to"] = P.points_to(functions, cfg, edges)["pts"]
    return out
