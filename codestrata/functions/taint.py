"""Source, sink and sanitizer classes, evidence grades and dynamic boundaries.

Two vocabularies exist on purpose: one for path enumeration, one for the variable-level fixpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .common import first_match, matches, nonempty

# Evidence grades from weakest to strongest.
GRADES = ("lexical", "ast", "compiler", "lsp", "runtime")
BOUNDARY_PATTERNS = {
    "dynamic-code": r"\b(?:eval|exec|compile|new\s+Function|Function)\s*\(",
    "reflection": r"\b(?:getattr|setattr|hasattr|Class\.forName|getMethod|getDeclaredMethod|Method\.invoke|reflect\.|"
                  r"Type\.GetType|Activator\.CreateInstance)\s*\(",
    "dynamic-import": r"\b(?:import|require|importlib\.import_module|__import__)\s*\(",
    "ffi": r"\b(?:ctypes\.|cffi\.|ffi\.|dlopen|dlsym|LoadLibrary|GetProcAddress|JNIEXPORT|native\s+\w+|"
           r"extern\s+[\"']C[\"']|libloading)\b",
    "native-process": r"\b(?:child_process|subprocess|ProcessBuilder|Runtime\.getRuntime|std::process::Command|"
                      r"system\s*\(|popen\s*\()\b",
}

# Vocabularies of the path analysis, the first match counts.
PATH_SOURCES = (
    ("environment", r"\b(env|environment|process\.env|os\.getenv)\b"),
    ("file", r"\b(read_file|readfile|open\s*\(|file|path)\b"),
    ("network", r"\b(fetch|http|socket|websocket|network)\b"),
    ("device", r"\b(sensor|serial|gpio|device|hardware)\b"),
    ("database", r"\b(select|database|db|repository|cursor)\b"),
    ("request", r"\b(request|req|payload|body|query|form|header|cookie)\b"),
)
PATH_PARAMETER = r"\b(params?|argument|argv|input|stdin)\b"
PATH_SOURCE_API = r"\b(env|process\.env|os\.getenv|fetch|socket|read_file|readfile|stdin|argv|sensor|device)\b"
PATH_ROOT_INPUT = r"\b(request|req|payload|body|query|params|input)\b"
PATH_SINKS = (
    ("command", r"\b(exec|spawn|system|popen|subprocess|eval|shell|command)\b|command-execution"),
    ("dom", r"innerhtml|dangerouslysetinnerhtml|document\.write|dom sink|xss"),
    ("file", r"\b(writefile|write_file|appendfile|unlink|remove_file|rename|file\.write|open\s*\([^)]*[\"'][awx])\b"),
    ("network", r"\b(send|post|put|upload|fetch|socket\.write|http\.request)\b"),
    ("sql", r"sql-injection|\b(execute|executemany|raw_sql|rawquery)\b|\b(insert|update|delete)\s+(?:into|from|\w+\s+set)\b"),
    ("database-write", r"\b(commit|flush|save|persist|repository\.(?:add|update|delete)|session\.(?:add|delete|commit))\b"),
    ("shared-state", r"\b(global|shared_state|cache\.(?:set|put)|state\s*=|store\.set)\b|state-write"),
)
# kinds of sink, what neutralises them in name, summary and validations, and in the body
PATH_SANITIZERS = (
    (("sql", "database-write"), r"\b(parameterized|bindparam|prepared|orm|schema|validate|parse_safe)\b|input-validation",
     r"\b(bindparam|prepare|parameterized)\b"),
    (("dom",), r"\b(sanitize|escape|encode|textcontent)\b", r"\b(dom_purify|escape_html)\b"),
    (("file",), r"\b(resolve|realpath|normalize|allowlist|whitelist|validate_path)\b", r"\b(realpath|resolve_path)\b"),
    (("command",), r"\b(allowlist|whitelist|validate|authorize|permission)\b|input-validation|access-check", None),
)
PATH_SANITIZER = r"\b(validate|sanitize|authorize|permission|allowlist|schema)\b"


def _signals(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def path_source_kind(name, summary, external_inputs, body, is_root) -> Column:
    """Kind of input a function acquires, null when it is no source."""
    text = _signals(name, summary, F.concat_ws(" ", external_inputs), body)
    declared = nonempty(external_inputs)
    chain = [(kind, matches(pattern, text)) for kind, pattern in PATH_SOURCES]
    kind = first_match([*chain, ("parameter", matches(PATH_PARAMETER, text) | declared)], "unknown")
    return F.when(declared | matches(PATH_SOURCE_API, text) | (is_root & matches(PATH_ROOT_INPUT, text)), kind)


def path_sink_kind(name, summary, risks, side_effects, body) -> Column:
    """Sensitive operation a function performs, null when none."""
    text = _signals(name, summary, F.concat_ws(" ", risks), F.concat_ws(" ", side_effects), body)
    return first_match([(kind, matches(pattern, text)) for kind, pattern in PATH_SINKS])


def is_path_sanitizer(name, summary, validations, body, sink_kind) -> Column:
    """Whether a function on a path neutralises data for that kind of sink."""
    text = _signals(name, summary, F.concat_ws(" ", validations))
    code = F.lower(body)
    chain = None
    for kinds, in_text, in_code in PATH_SANITIZERS:
        found = matches(in_text, text)
        found = found | matches(in_code, code) if in_code else found
        chain = F.when(sink_kind.isin(*kinds), found) if chain is None else chain.when(sink_kind.isin(*kinds), found)
    return chain.otherwise(nonempty(validations) | matches(PATH_SANITIZER, text))


def edge_sink_class(name, summary, side_effects, outputs, params) -> Column:
    """Where the data of an edge ends up, judged by the called function."""
    text = _signals(name, summary, F.concat_ws(" ", side_effects))
    concrete = F.exists(outputs, is_concrete)
    return first_match(
        [
            ("database", matches(r"sql|database|db|orm", text)),
            ("file", matches(r"file|path|resource-operation", text)),
            ("network", matches(r"http|fetch|socket|network", text)),
            ("process", matches(r"exec|spawn|process|command", text)),
            ("state", matches(r"state|cache", text)),
            ("return", concrete),
            ("function_parameter", nonempty(params)),
        ],
        "unknown",
    )


def is_concrete(name: Column) -> Column:
    return (name != "") & ~name.isin("void", "state change/void", "unknown", "inferred")


def is_variable_source(name, external_inputs, params) -> Column:
    """Function whose parameters carry outside data in the variable-level analysis."""
    text = F.concat_ws(" ", name, F.concat_ws(" ", external_inputs), F.concat_ws(" ", params))
    words = matches(r"(?i)request|input|stdin|argv|query|param|header|cookie|upload|socket|message|event", text)
    return words | nonempty(external_inputs)


def is_variable_sanitizer(name, validations) -> Column:
    text = F.concat_ws(" ", name, F.concat_ws(" ", validations))
    return matches(r"(?i)sanitize|escape|validate|encode|parameterize|allowlist|permission|authorize|verify", text)


def statement_sanitizes(uses: Column, definitions: Column) -> Column:
    text = F.concat_ws(" ", F.concat_ws(" ", uses), F.concat_ws(" ", definitions))
    return matches(r"(?i)sanitize|escape|validate|encode|parameterize|allowlist", text)


def variable_sink_kind(name, body, side_effects) -> Column:
    text = F.concat_ws(" ", name, body, F.concat_ws(" ", side_effects))
    return first_match(
        [
            ("sql", matches(r"(?i)execute|query|rawsql|cursor\.execute", text)),
            ("command", matches(r"(?i)exec|spawn|system\s*\(|runtime\.getruntime", text)),
            ("file", matches(r"(?i)writefile|open\s*\(|sendfile|path\.join", text)),
            ("network", matches(r"(?i)fetch|request|http|socket", text)),
            ("dom-template", matches(r"(?i)innerhtml|render|template", text)),
        ]
    )


def evidence_grade(evidence: Column, observed: Column) -> Column:
    """Strength of the evidence text behind an edge; an observed run wins."""
    text = F.coalesce(evidence, F.lit(""))
    return (
        F.when(observed, "runtime")
        .when(matches(r"\bLSP\b|(?i:reference)", text), "lsp")
        .when(matches("(?i)compiler", text), "compiler")
        .when(matches("(?i)ast|tree-sitter", text), "ast")
        .otherwise("lexical")
    )


def rule_evidence_grade(source: Column, parser: Column, parse_evidence: Column) -> Column:
    """Grade of the facts behind a rule match."""
    text = F.concat_ws(" ", F.coalesce(parser, F.lit("")), F.concat_ws(" ", parse_evidence))
    return (
        F.when(matches("(?i)compiler|typechecker|language service", text), "compiler")
        .when((source == "Parser Fact") & ~matches("(?i)heuristic|fallback", text), "parser")
        .otherwise("heuristic")
    )


def grade_rank(grade: Column) -> Column:
    chain = None
    for rank, name in enumerate(GRADES):
        chain = F.when(grade == name, rank) if chain is None else chain.when(grade == name, rank)
    return chain.otherwise(0)


def grade_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(g) for g in GRADES]), (rank + 1).cast("int"))


def weakest_grade(grades: Column) -> Column:
    """Weakest grade of an array, ``lexical`` when empty."""
    return grade_of_rank(F.coalesce(F.array_min(F.transform(grades, grade_rank)), F.lit(0)))
