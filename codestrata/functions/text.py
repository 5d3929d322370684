"""Facts read off a function's name, parameters and body text.

Every regular expression, keyword and score below is a fixed value of the analysis model: results must be
reproducible across engines, so the patterns keep their exact meaning (including alternations that bind ``\\b`` only
to the outermost branches).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .common import all_groups, first_match, flags, matches, nonempty, round_half_up

# Category keywords in priority order.
CATEGORY_WORDS = {
    "parse": ("parse", "read", "collect", "scan", "detect"),
    "build": ("build", "render", "create", "make", "compose"),
    "validate": ("validate", "check", "guard", "assert"),
    "simulate": ("simulate", "debug", "trace", "step", "run"),
    "input": ("load", "fetch", "query", "open", "input"),
    "output": ("save", "write", "emit", "send", "export", "return"),
    "model": ("model", "score", "optimize", "rank", "calculate"),
}
COMPLEXITY_WORDS = r"\b(if|else if|for|while|switch|case|catch|try|await)\b"
RISK_PATTERNS = {
    "code-injection": (r"\beval\s*\(|new function|innerhtml|dangerouslysetinnerhtml", None),
    "command-execution": (r"\bexec|spawn|system\(|subprocess|shell\b", None),
    "infinite-loop": (r"\bwhile\s*\(\s*true\s*\)|for\s*\(\s*;\s*;\s*\)", None),
    "overflow": (r"\bpush\(|append\(|queue\.add|cache\.set", r"\blimit|max|capacity|backpressure\b"),
    "sql-injection": (r"\bselect\b.*\+|query\s*\(.*\+|sql.*\$\{", None),
    "path-traversal": (r"\.\./|path\.join\([^)]*input|readfile\([^)]*request", None),
}
SEVERE_RISKS = ("code-injection", "command-execution", "sql-injection", "path-traversal")
VALIDATION_PATTERNS = {
    "input-validation": r"\bvalidate|schema|zod|joi|assert|guard|sanitize|escape\b",
    "access-check": r"\bauth|permission|role|token|session\b",
    "exception-handling": r"\btry\b|\bcatch\b|except\b|finally\b",
    "type-range-check": r"\btypeof|instanceof|isnan|length\s*[<>]=?|range|min|max\b",
}
SIDE_EFFECT_PATTERNS = {
    "state-write": r"\bwrite|save|insert|update|delete|commit|publish|send|emit\b",
    "async-schedule": r"\bsettimeout|setinterval|thread|worker|queue|schedule|async|await\b",
    "resource-operation": r"\breadfile|writefile|open\(|close\(|fs\.|socket\b",
    "cache-container": r"\bcache|buffer|queue|list|array|map|set\b",
}
EXTERNAL_INPUT_PATTERNS = {
    "external-input": r"\b(req|request|payload|body|query|params|input|stdin|sensor)\b",
    "environment-variable": r"\bprocess\.env|env\.|config\b",
    "network-device-input": r"\bfetch|axios|http|socket|mqtt|serial\b",
    "file-database-input": r"\breadfile|open\(|fs\.|database|select\b",
}
OUTPUT_TAG_PATTERNS = {
    "log": r"\bconsole\.",
    "side effect": r"(?i)\b(write|save|emit|send|dispatch|publish)\b",
    "network response": r"(?i)\b(res\.json|sendResponse|response|reply)\b",
}
SIGNATURE_LANGUAGES = (
    "TypeScript", "JavaScript", "Python", "Go", "Rust", "Java", "C#", "C++", "C", "PHP", "Ruby", "Kotlin", "Swift",
)
# Algorithm families and data structures recognised in a function.
REMEDY_HINTS = (
    ("parameterize-queries", r"(?i)sql|orm|injection"),
    ("allowlist-commands", r"(?i)command|exec|system|code-injection"),
    ("confine-paths", r"(?i)path|file|read"),
    ("csrf-token", r"(?i)csrf"),
    ("explicit-origins", r"(?i)cors"),
    ("verify-token-claims", r"(?i)jwt"),
    ("lock-order-timeout", r"(?i)lock|deadlock|concurrency"),
    ("heartbeat-watchdog", r"(?i)device|hardware|watchdog|offline"),
    ("capacity-limit", r"(?i)overflow|capacity"),
    ("timeout-backoff", r"(?i)timeout|retry"),
)


def category(name: Column) -> Column:
    """Category of a function by the first keyword group its name contains."""
    lower = F.lower(name)
    return first_match(
        [(label, _contains_any(lower, words)) for label, words in CATEGORY_WORDS.items()], "business"
    )


def _contains_any(text: Column, words) -> Column:
    cond = F.lit(False)
    for word in words:
        cond = cond | text.contains(word)
    return cond


def complexity(body: Column) -> Column:
    """Branch keywords + 1."""
    return (F.regexp_count(body, F.lit(COMPLEXITY_WORDS)) + 1).cast("long")


def risks(body: Column) -> Column:
    """Risk flags; an ``overflow`` needs growth without a visible bound."""
    lower = F.lower(body)
    pairs = []
    for label, (pattern, guard) in RISK_PATTERNS.items():
        cond = matches(pattern, lower)
        pairs.append((label, cond & ~matches(guard, lower) if guard else cond))
    return flags(pairs)


def _flag_table(text: Column, table: dict[str, str]) -> Column:
    return flags([(label, matches(pattern, text)) for label, pattern in table.items()])


def validations(body: Column) -> Column:
    """B04."""
    return _flag_table(F.lower(body), VALIDATION_PATTERNS)


def side_effects(body: Column) -> Column:
    """B05."""
    return _flag_table(F.lower(body), SIDE_EFFECT_PATTERNS)


def external_inputs(name: Column, body: Column, params: Column) -> Column:
    """Searched in name, body and parameters together."""
    lower = F.lower(F.concat_ws(" ", name, body, F.concat_ws(" ", params)))
    return _flag_table(lower, EXTERNAL_INPUT_PATTERNS)


def shorten(text: Column, size: int) -> Column:
    """White space collapsed, then cut to ``size`` characters with a trailing ellipsis."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(clean) > size, F.concat(F.substring(clean, 1, size - 1), F.lit("..."))).otherwise(clean)


def outputs(body: Column, return_type: Column) -> Column:
    """First two return expressions, then effect tags, else the return type."""
    returned = F.slice(
        F.transform(all_groups(body, r"\breturn\s+([^;\n]+)"), lambda e: shorten(F.trim(e), 24)), 1, 2
    )
    tags = _flag_table(body, OUTPUT_TAG_PATTERNS)
    found = F.concat(returned, tags)
    fallback = F.array(F.when(return_type == "void", F.lit("state change/void")).otherwise(return_type))
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def return_type(hint: Column, body: Column) -> Column:
    """Declared type, else ``inferred`` when a return statement exists, else ``void``."""
    clean = F.trim(F.regexp_replace(F.coalesce(hint, F.lit("")), r"[{\n\r]", " "))
    return (
        F.when(clean != "", shorten(clean, 28))
        .when(matches(r"\breturn\b", body), F.lit("inferred"))
        .otherwise(F.lit("void"))
    )


def params(text: Column) -> Column:
    """Parameter list of a signature without default values and sigils."""
    trimmed = F.transform(F.split(text, ","), lambda p: F.trim(p))
    kept = F.filter(trimmed, lambda p: p != "")
    return F.transform(kept, lambda p: F.regexp_replace(F.regexp_replace(p, r"(?s)\s*=.*", ""), r"^\$", ""))


def binding_name(param: Column) -> Column:
    """Parameter name for argument binding (first token before ``:``, ``=`` or space)."""
    bare = F.regexp_replace(param, r"^\s*(?:self|this)\s*,?", "")
    return F.regexp_replace(F.element_at(F.split(bare, r"[:=\s]"), 1), r"^\*+", "")


def variable_name(param: Column) -> Column:
    """Parameter name as a program variable (last word before ``:`` or ``=``, modifiers dropped)."""
    head = F.element_at(F.split(param, "[:=]"), 1)
    bare = F.trim(F.regexp_replace(head, r"^(?:const|let|var|final|mut|ref|in|out)\s+", ""))
    return F.element_at(F.split(bare, r"\s+"), -1)


def parameter_type(param: Column) -> Column:
    """Annotated type after ``:``, else a leading type word, else ``inferred``."""
    annotated = F.trim(F.regexp_extract(param, r":\s*([^=,)]+)", 1))
    words = F.split(F.trim(param), r"\s+")
    return (
        F.when(matches(r":\s*([^=,)]+)", param), annotated)
        .when(F.size(words) > 1, F.element_at(words, 1))
        .otherwise(F.lit("inferred"))
    )


def parse_confidence(language: Column, body: Column, rtype: Column) -> Column:
    """Base by language support plus bonuses, at most 92."""
    score = (
        F.when(language.isin(*SIGNATURE_LANGUAGES), 76).otherwise(42)
        + F.when(~rtype.isin("inferred", "unknown"), 8).otherwise(0)
        + F.when(nonempty(validations(body)), 5).otherwise(0)
        + F.when(body.contains("{") | (language == "Python"), 4).otherwise(0)
    )
    return F.least(score, F.lit(92)).cast("long")


def data_shape(params_col: Column, rtype: Column) -> Column:
    """``(type, type, type) -> return``."""

    def one(p: Column) -> Column:
        typed = F.trim(F.coalesce(F.get(F.split(p, ":"), F.lit(1)), F.lit("")))
        last = F.element_at(F.split(p, r"\s+"), -1)
        return F.when(typed != "", typed).when(last != "", last).otherwise(F.lit("unknown"))

    names = F.concat_ws(", ", F.slice(F.transform(params_col, one), 1, 3))
    return F.concat(
        F.lit("("), F.when(names != "", names).otherwise(F.lit("void")), F.lit(") -> "), rtype
    )


def remedy_hints(risk_labels: Column) -> Column:
    """Per risk the first fitting hint, distinct, at most four."""
    one = lambda r: first_match([(hint, matches(pattern, r)) for hint, pattern in REMEDY_HINTS])
    return F.slice(F.array_distinct(F.array_compact(F.transform(risk_labels, one))), 1, 4)


def recommendations(fn: dict[str, Column]) -> Column:
    """Advice codes for one function; keys: return_type, external_inputs, validations, risks, complexity, calls."""
    found = flags([
        ("type-evidence", fn["return_type"].isin("inferred", "unknown")),
        ("add-input-guard", nonempty(fn["external_inputs"]) & ~nonempty(fn["validations"])),
        ("bound-capacity", F.array_contains(fn["risks"], "overflow")),
        ("split-branches", fn["complexity"] >= 5),
        ("test-leaf", F.size(fn["calls"]) == 0),
    ])
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("stable-node")))


def token_set(text: Column) -> Column:
    """Distinct lower-case tokens of three or more characters."""
    parts = F.split(F.lower(text), r"[^a-z0-9_.$#/@+-]+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 3))


def keyword_ratio(text: Column, words: list[str]) -> Column:
    """Share of ``words`` contained in the text."""
    lower = F.lower(text)
    hits = sum((F.when(lower.contains(w.lower()), 1).otherwise(0) for w in words), F.lit(0))
    return hits.cast("double") / F.lit(float(max(1, len(words))))


def loose_package_match(left: Column, right: Column) -> Column:
    """Equal after normalising, or one contains the other."""
    a = F.regexp_replace(F.regexp_replace(F.lower(left), "^node:", ""), r"[^a-z0-9]+", "")
    b = F.regexp_replace(F.regexp_replace(F.lower(right), "^node:", ""), r"[^a-z0-9]+", "")
    return (a != "") & (b != "") & ((a == b) | a.contains(b) | b.contains(a))


def label_confidence(base: Column, best_match: Column) -> Column:
    """Mean of own and best rule confidence, in 35..96."""
    return F.greatest(F.lit(35), F.least(F.lit(96), round_half_up((base + best_match) / 2)))
