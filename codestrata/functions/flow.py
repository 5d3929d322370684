"""Flow roles, node states, capacities and risk levels of functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .common import first_match, has, lookup, matches, nonempty
from .text import SEVERE_RISKS

# Scores and labels of the flow model.
CAPACITY_SCORES = {"lake": 92, "reservoir": 84, "pond": 70, "river": 52, "creek": 32}
ROLE_CAPACITY = {"tank": "lake", "overflow": "lake", "pump": "pond", "reflux": "pond", "pipe": "river", "outlet": "river"}
STAGE_LABELS = {
    "entry": "spring", "intake": "inlet", "filter": "purifier", "transform": "main-channel", "dispatch": "fork",
    "merge": "confluence", "store": "lake", "result": "outflow", "fault": "warning",
}
RISK_LEVEL_WEIGHT = {"critical": 4, "risk": 3, "warn": 2, "none": 1}
SEVERITY_PENALTY = {"Critical": 28, "High": 18, "Medium": 10, "Low": 4}
RULE_SEVERITY_WEIGHT = {"critical": 4, "risk": 3, "warn": 2, "info": 1}
RULE_TO_ISSUE_SEVERITY = {"critical": "Critical", "risk": "High", "warn": "Medium", "info": "Low"}
STATUS_CONFIDENCE = {"Closed": 88, "Partially Closed": 72, "Unknown": 54, "Open": 62}
BASIN_PATTERNS = (
    ("security", r"auth|login|token|permission|security|validate|sanitize"),
    ("language", r"parse|parser|syntax|ast|compiler|lsp|language"),
    ("storage", r"database|repository|crud|sql|sqlite|model|schema"),
    ("runtime", r"runtime|sandbox|process|execute|runner|trace|debug"),
    ("scheduling", r"task|job|schedule|queue|reminder"),
    ("workspace", r"project|workspace|file|folder|import"),
    ("interface", r"render|view|page|component|ui|display"),
    ("graph", r"graph|flow|water|hydrology|edge|node"),
)
VOID_OUTPUTS = ("void", "state change/void")


def has_real_output(outputs: Column) -> Column:
    return F.exists(outputs, lambda o: ~o.isin(*VOID_OUTPUTS))


def flow_role(name, category, risks, validations, side_effects, external_inputs, outputs, self_call) -> Column:
    """The first of nine roles that applies."""
    return first_match(
        [
            ("blocked", has(risks, "infinite-loop")),
            ("overflow", has(risks, "overflow")),
            ("reflux", matches("(?i)recursive|recurse", name) | self_call),
            ("valve", nonempty(validations)),
            ("tank", has(side_effects, "cache-container") | has(side_effects, "state-write")),
            ("pump", has(side_effects, "async-schedule")),
            ("source", nonempty(external_inputs) | (category == "input")),
            ("outlet", nonempty(outputs) & ~has(outputs, "state change/void")),
        ],
        "pipe",
    )


def node_status(risks, validations, external_inputs, outputs, out_degree, stopped) -> Column:
    """State of a function node; ``stopped`` is membership in the breakpoint set."""
    severe = F.arrays_overlap(risks, F.array(*[F.lit(r) for r in SEVERE_RISKS]))
    real = has_real_output(outputs)
    return (
        F.when(stopped | has(risks, "infinite-loop"), "Blocked")
        .when(has(risks, "overflow"), "Overflow Risk")
        .when(severe, "Blocked")
        .when(nonempty(risks), "Partially Closed")
        .when(nonempty(external_inputs) & ~nonempty(validations) & (out_degree > 0), "Partially Closed")
        .when(real | (out_degree > 0) | nonempty(validations), "Closed")
        .otherwise("Open")
    )


def capacity(name, rtype, shape, body, risks, side_effects, complexity, outputs, in_degree, out_degree) -> Column:
    """Capacity class from container words, effects and degree."""
    text = F.lower(F.concat_ws(" ", name, rtype, shape, body))
    return (
        F.when(has(risks, "overflow"), "lake")
        .when(matches(r"\blist\b|list<|list\[", text), "lake")
        .when(matches(r"\barray\b|array<|\[\]|flatmap|\.map\(", text), "reservoir")
        .when(matches(r"\bbuffer\b|\bqueue\b|\bcache\b|map<|set<|new map|new set", text), "lake")
        .when(has(side_effects, "cache-container") | has(side_effects, "state-write"), "reservoir")
        .when(has(side_effects, "async-schedule") | (complexity >= 6), "pond")
        .when((in_degree + out_degree >= 3) | has_real_output(outputs), "river")
        .otherwise("creek")
    )


def role_capacity(role: Column) -> Column:
    """Capacity implied by a role when none was inferred."""
    return lookup(role, ROLE_CAPACITY, "creek")


def capacity_score(cap: Column) -> Column:
    return lookup(cap, CAPACITY_SCORES, 32).cast("long")


def node_confidence(confidence: Column, status: Column) -> Column:
    """Own confidence or the default of the state, in 35..96."""
    base = F.coalesce(confidence.cast("long"), lookup(status, STATUS_CONFIDENCE, 66).cast("long"))
    return F.greatest(F.lit(35), F.least(F.lit(96), base))


def stage_role(is_entry, status, risks, external_inputs, category, validations, side_effects, in_degree, out_degree,
               outputs) -> Column:
    """Role of a function in the data-flow order."""
    return first_match(
        [
            ("entry", is_entry),
            ("fault", status.isin("Blocked", "Overflow Risk") | nonempty(risks)),
            ("intake", nonempty(external_inputs) | (category == "input")),
            ("filter", nonempty(validations)),
            ("store", has(side_effects, "cache-container") | has(side_effects, "state-write")),
            ("merge", in_degree > 1),
            ("dispatch", (out_degree > 1) | has(side_effects, "async-schedule")),
            ("result", (out_degree == 0) & has_real_output(outputs)),
        ],
        "transform",
    )


def stage_label(role: Column) -> Column:
    return lookup(role, STAGE_LABELS)


def stage_risk(status, risks, confidence, external_inputs, validations) -> Column:
    """B15."""
    severe = F.arrays_overlap(risks, F.array(*[F.lit(r) for r in SEVERE_RISKS]))
    return (
        F.when((status == "Blocked") | severe, "critical")
        .when(status.isin("Overflow Risk", "Open") | nonempty(risks) | (confidence < 60), "risk")
        .when(
            (status == "Partially Closed") | (confidence < 75)
            | (nonempty(external_inputs) & ~nonempty(validations)), "warn",
        )
        .otherwise("none")
    )


def stage_data_in(params, external_inputs, in_degree) -> Column:
    """Up to four distinct inputs, else a note about upstream outputs."""
    values = F.array_distinct(F.concat(params, external_inputs))
    return (
        F.when(F.size(values) > 0, F.slice(values, 1, 4))
        .when(in_degree > 0, F.array(F.concat(in_degree.cast("string"), F.lit(" upstream outputs"))))
        .otherwise(F.array(F.lit("no explicit input")))
    )


def stage_data_out(outputs, side_effects, out_degree) -> Column:
    real = F.filter(outputs, lambda o: ~o.isin(*VOID_OUTPUTS))
    return (
        F.when(F.size(real) > 0, F.slice(real, 1, 4))
        .when(nonempty(side_effects), F.slice(side_effects, 1, 4))
        .when(out_degree > 0, F.array(F.concat(F.lit("passed to "), out_degree.cast("string"), F.lit(" downstream"))))
        .otherwise(F.array(F.lit("no recognised return")))
    )


def basin(name, params, outputs, path) -> Column:
    """Domain by the first pattern over name, data names and path, else the parent directory."""
    signals = F.lower(F.concat_ws(" ", name, F.concat_ws(" ", params), F.concat_ws(" ", outputs), path))
    parts = F.split(path, "/")
    parent = F.when(F.size(parts) >= 2, F.element_at(parts, -2))
    return F.coalesce(
        first_match([(label, matches(pattern, signals)) for label, pattern in BASIN_PATTERNS]),
        F.when(parent != "", F.concat(parent, F.lit(" module"))),
        F.lit("general"),
    )


def issue_category(rule_category, tags, severity) -> Column:
    """Report category of a rule match."""
    return (
        F.when(rule_category == "security", "security")
        .when(rule_category.isin("efficiency", "algorithm"), "performance")
        .when(rule_category == "stability", "flow")
        .when((rule_category == "language_api") & (has(tags, "security") | (severity == "critical")), "security")
        .otherwise("quality")
    )


def severity_penalty(severity: Column) -> Column:
    return lookup(severity, SEVERITY_PENALTY, 4).cast("long")


def is_test_file(path: Column) -> Column:
    """B37."""
    return matches(r"(^|/)(test|tests|__tests__|spec)(/|$)|\.(test|spec)\.", F.lower(path))


def is_lock_file(path: Column) -> Column:
    return matches(r"(package-lock\.json|pnpm-lock\.yaml|yarn\.lock|cargo\.lock|poetry\.lock|go\.sum)$", F.lower(path))


def is_manifest(path: Column) -> Column:
    return matches(r"(package\.json|requirements\.txt|pyproject\.toml|go\.mod|cargo\.toml)$", F.lower(path))


def entry_score(name, external_inputs, category, in_degree, out_degree) -> Column:
    """Score of a function as the program entry."""
    return (
        out_degree * 12 - in_degree * 4
        + F.when(matches(r"\b(main|start|run|init|bootstrap|analyze|execute|handler|controller)\b", F.lower(name)), 30)
        .otherwise(0)
        + F.when(nonempty(external_inputs), 12).otherwise(0)
        + F.when(category.isin("input", "simulate"), 8).otherwise(0)
    ).cast("long")


def main_file_score(path, content, function_count) -> Column:
    """Score of a file as the main control file."""
    lower = F.lower(path)
    return (
        function_count * 3
        + F.when(matches(
            r"(^|/)(main|index|app|server|cli|controller|pipeline|workflow)\.(ts|tsx|js|jsx|py|go|rs|java|cs)$", lower),
            34).otherwise(0)
        + F.when(matches(r"(package\.json|go\.mod|cargo\.toml|pyproject\.toml)$", lower), 8).otherwise(0)
        + F.when(matches(r"\b(start|run|init|bootstrap|listen|analyze|execute|main)\b", F.lower(content)), 18).otherwise(0)
        + F.when(matches(r"\bimport\b|\brequire\(|from\s+\w+\s+import", content), 7).otherwise(0)
    ).cast("long")


def network_score(in_entry_tree, in_degree, out_degree, external_inputs, outputs, validations, risks, complexity):
    """visibility score of a function in the call network."""
    return (
        F.when(in_entry_tree, 80).otherwise(0)
        + F.when(in_degree == 0, 24).otherwise(0)
        + F.when(nonempty(external_inputs), 28).otherwise(0)
        + F.when(has_real_output(outputs), 18).otherwise(0)
        + F.when(nonempty(validations), 16).otherwise(0)
        + F.when(nonempty(risks), 22).otherwise(0)
        + (in_degree + out_degree) * 6
        + F.least(F.lit(12), complexity)
    ).cast("long")
