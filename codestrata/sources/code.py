"""Function, declaration and route facts from source text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text
from ..functions.common import first_match

# Function signatures by language.
_FN_TYPED = r"(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(([^)]*)\)\s*(?::\s*([^{=>]+))?\s*\{"
_ARROW_TYPED = r"(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*(?::\s*([^=]+))?\s*=>"
SIGNATURES: dict[str, tuple[str, ...]] = {
    "TypeScript": (_FN_TYPED, _ARROW_TYPED),
    "JavaScript": (
        r"(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(([^)]*)\)\s*\{",
        r"(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*=>"),
    "Python": (r"(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(([^)]*)\)\s*(?:->\s*([^:]+))?:",),
    "Go": (
        r"func\s+(?:\([^)]+\)\s*)?([A-Za-z_]\w*)\s*\(([^)]*)\)\s*([A-Za-z_][\w[\]*.]*|\([^)]+\))?\s*\{",),
    "Rust": (r"(?:pub\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)\s*\(([^)]*)\)\s*(?:->\s*([^{]+))?\s*\{",),
    "Java": (
        r"(?:public|private|protected|static|final|synchronized|\s)+\s*([A-Za-z_<>\[\]?]+)\s+([A-Za-z_]\w*)\s*"
        r"\(([^)]*)\)\s*\{",),
    "C#": (
        r"(?:public|private|protected|internal|static|async|override|virtual|\s)+\s*([A-Za-z_<>\[\]?]+)\s+"
        r"([A-Za-z_]\w*)\s*\(([^)]*)\)\s*\{",),
    "C++": (r"(?:[A-Za-z_][\w:<>\*&\s]+)\s+([A-Za-z_]\w*)\s*\(([^;{}]*)\)\s*\{",),
    "C": (r"(?:[A-Za-z_][\w\*&\s]+)\s+([A-Za-z_]\w*)\s*\(([^;{}]*)\)\s*\{",),
    "PHP": (r"function\s+([A-Za-z_]\w*)\s*\(([^)]*)\)\s*(?::\s*([^{]+))?\s*\{",),
    "Ruby": (r"def\s+([A-Za-z_]\w*[!?=]?)\s*(?:\(([^)]*)\)|([^\n]*))",),
    "Kotlin": (r"fun\s+([A-Za-z_]\w*)\s*\(([^)]*)\)\s*(?::\s*([^{=]+))?",),
    "Swift": (r"func\s+([A-Za-z_]\w*)\s*\(([^)]*)\)\s*(?:->\s*([^{]+))?\s*\{",),
}
TYPE_FIRST = ("Java", "C#")
BLOCK_LESS = ("Python", "Ruby", "Kotlin")
_COMPILED = {k: [re.compile(p, re.ASCII) for p in v] for k, v in SIGNATURES.items()}
# pieces of code that can hide or carry a brace; a lone opener means the rest of the file is inside it
_BRACE_TOKENS = re.compile(
    r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|(?P<open>\{)|(?P<close>\})|"
    r"(?P<lost>/\*|[\"'`])", re.DOTALL)
FUNCTION_SCHEMA = (
    "file_id {id}, project_id {pid}, path string, language string, name string, start_line int, end_line int, "
    "params_text string, hint string, body string")


def block_end(content: str, start: int, fallback: int) -> int:
    """End of the balanced block that opens after ``start``; ``fallback`` when there is none."""
    opening = content.find("{", start)
    if opening < 0 or opening > fallback:
        return fallback
    depth = 0
    for token in _BRACE_TOKENS.finditer(content, opening):
        if token.lastgroup == "lost":
            return fallback
        if token.lastgroup == "open":
            depth += 1
        elif token.lastgroup == "close":
            depth -= 1
            if depth == 0:
                return token.end()
    return fallback


def _functions_of(content: str, language: str) -> list[tuple]:
    found = []
    for pattern in _COMPILED.get(language, ()):
        for m in pattern.finditer(content):
            g = m.groups() + (None,) * 3
            if language in TYPE_FIRST:
                found.append((m.start(), g[1], g[2] or "", g[0] or ""))
            else:
                found.append((m.start(), g[0], g[1] if g[1] is not None else g[2] or "", g[2] or ""))
    found.sort(key=lambda f: f[0])
    rows = []
    for (start, name, params, hint), following in zip(found, [*found[1:], (len(content),)]):
        end = following[0] if language in BLOCK_LESS else block_end(content, start, following[0])
        body = content[start:end]
        first = content.count("\n", 0, start) + 1
        rows.append((name, first, first + body.count("\n") + 1, params, hint, body))
    return rows


def extract_functions(files: DataFrame) -> DataFrame:
    """One row per function found by the language's signature patterns.

    A body runs to its balanced brace, else to the next signature.  Files are independent, so this is one Arrow pass
    without a shuffle; all further facts are column expressions over its output.
    """
    kept = files.where(F.col("language").isin(*SIGNATURES)).select("file_id", "project_id", "path", "language", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file_id", "project_id", "path", "language", "name", "start_line", "end_line", "params_text", "hint", "body"]
        for batch in batches:
            rows = [
                (f.file_id, f.project_id, f.path, f.language, *row)
                for f in batch.itertuples(index=False) for row in _functions_of(f.content, f.language)
            ]
            yield pd.DataFrame(rows, columns=columns)

    types = {k: files.schema[k].dataType.simpleString() for k in ("file_id", "project_id")}
    return kept.mapInPandas(run, FUNCTION_SCHEMA.format(id=types["file_id"], pid=types["project_id"]))


def function_facts(functions: DataFrame) -> DataFrame:
    """B01-B10 on extracted functions."""
    f = functions.withColumn("params", text.params(F.col("params_text")))
    f = f.withColumn("return_type", text.return_type(F.col("hint"), F.col("body")))
    return f.select(
        "*", text.category(F.col("name")).alias("category"), text.complexity(F.col("body")).alias("complexity"),
        text.risks(F.col("body")).alias("risks"), text.validations(F.col("body")).alias("validations"),
        text.side_effects(F.col("body")).alias("side_effects"),
        text.external_inputs(F.col("name"), F.col("body"), F.col("params")).alias("external_inputs"),
        text.outputs(F.col("body"), F.col("return_type")).alias("outputs"),
        text.data_shape(F.col("params"), F.col("return_type")).alias("data_shape"),
        text.parse_confidence(F.col("language"), F.col("body"), F.col("return_type")).alias("confidence"))


def signature_spans(signatures: DataFrame) -> DataFrame:
    """A signature's span ends where the next one of the file starts (files bound the window)."""
    return signatures.withColumn(
        "next_line", F.lead("start_line").over(Window.partitionBy("file_id").orderBy("start_line")))


# Kinds and roles of class declarations.
DECLARATION_ROLES = (
    ("input-contract", r"Request$|Create$|Payload$|Input$"), ("update-contract", r"Update$|Patch$"),
    ("output-contract", r"Out$|Response$|Result$|View$"), ("shared-fields", r"Base$"), ("hierarchy", r"Tree"),
)
ANNOTATED = r"^\s*([A-Za-z_]\w*)\s*:\s*(.+?)(?:\s*=\s*(.+))?\s*$"
ORM_FIELD = r"(?i)^\s*([A-Za-z_]\w*)\s*=\s*((?:mapped_)?column|relationship)\s*\((.*)$"


def _lines(files: DataFrame) -> DataFrame:
    raw = files.select("project_id", "file_id", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line"))
    indent = F.length(F.regexp_replace(F.regexp_extract("line", r"^(\s*)", 1), "\t", "    "))
    code = (F.trim("line") != "") & ~F.ltrim("line").startswith("#")
    return raw.select("*", indent.alias("indent"), code.alias("code"))


def extract_declarations(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Top-level Python classes and their direct fields.

    Each top-level code line opens a block; a class is a block whose first line is a class header.  Its direct members
    are the lines at the smallest positive indentation.  Returns ``(declarations, fields)``.
    """
    lines = _lines(files.where(F.col("language") == "Python"))
    order = Window.partitionBy("file_id").orderBy("pos")
    top = F.col("code") & (F.col("indent") == 0)
    blocks = lines.withColumn("block", F.sum(top.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    header = r"^class\s+([A-Za-z_]\w*)\s*(?:\(([^)]*)\))?\s*:"
    heads = blocks.where(top & F.col("line").rlike(header)).select(
        "project_id", "file_id", "block", (F.col("pos") + 1).alias("start_line"),
        F.regexp_extract("line", header, 1).alias("name"), F.regexp_extract("line", header, 2).alias("_bases"))
    bases = F.filter(F.transform(F.split("_bases", ","), lambda x: F.trim(x)), lambda x: x != "")
    heads = heads.select("*", bases.alias("base_types")).drop("_bases")
    spans = blocks.groupBy("file_id", "block").agg(
        F.max("pos").alias("_last"),
        F.min(F.when(F.col("code") & (F.col("indent") > 0), F.col("indent"))).alias("_direct"))
    inside = blocks.join(heads.select("file_id", "block", "name", "start_line"), ["file_id", "block"]).join(
        spans, ["file_id", "block"]).where(F.col("pos") + 1 > F.col("start_line"))
    direct = inside.where(F.col("indent") == F.col("_direct"))
    is_annotated, is_orm = F.col("line").rlike(ANNOTATED), F.col("line").rlike(ORM_FIELD)
    default = F.nullif(F.trim(F.regexp_extract("line", ANNOTATED, 3)), F.lit(""))
    orm_args = F.regexp_extract("line", ORM_FIELD, 3)
    fields = direct.where(is_annotated | is_orm).select(
        "project_id", "file_id", "block", (F.col("pos") + 1).alias("line_no"), F.col("name").alias("owner"),
        F.when(is_annotated, F.regexp_extract("line", ANNOTATED, 1)).otherwise(
            F.regexp_extract("line", ORM_FIELD, 1)).alias("name"),
        F.when(is_annotated, F.trim(F.regexp_extract("line", ANNOTATED, 2))).otherwise(F.coalesce(
            F.nullif(F.regexp_extract(orm_args, r"^\s*([A-Za-z_][\w.]*)", 1), F.lit("")), F.lit("ORM field"))).alias("type"),
        F.when(is_annotated, default.isNull() | (default == "...")).otherwise(
            ~orm_args.rlike(r"nullable\s*=\s*True")).alias("required"),
        F.when(is_annotated, default).otherwise(
            F.concat(F.regexp_extract("line", ORM_FIELD, 2), F.lit("(...)"))).alias("default_value"))
    config = F.trim("line").rlike(r"^(?:model_config\s*=|from_attributes\s*=|orm_mode\s*=)")
    method = F.col("line").rlike(r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(") & (F.col("indent") == F.col("_direct"))
    members = inside.groupBy("file_id", "block").agg(
        F.count_if(method).alias("method_count"), F.count_if(config).alias("config_count"))
    orm = fields.groupBy("file_id", "block").agg(
        F.count(F.lit(1)).alias("field_count"),
        F.bool_or(F.coalesce(F.col("default_value").rlike("(?i)column|relationship"), F.lit(False))).alias("_orm"))
    d = heads.join(spans.drop("_direct"), ["file_id", "block"]).join(members, ["file_id", "block"], "left").join(
        orm, ["file_id", "block"], "left").fillna(0, ["method_count", "config_count", "field_count"])
    base_text = F.lower(F.concat_ws(" ", "base_types"))
    dto = base_text.contains("basemodel") | F.exists(
        "base_types", lambda x: x.rlike(r"(?i)(?:create|update|out|request|payload)$") | (
            (x != "Base") & x.rlike(r"(?i)Base$")))
    kind = F.when(
        base_text.rlike(r"declarativebase|sqlmodel|db\.model|models?\.model") | F.coalesce("_orm", F.lit(False)), "orm-model"
    ).when(dto, "data-model").otherwise("class")
    d = d.withColumn("kind", kind)
    role = F.coalesce(
        first_match([(r, F.col("name").rlike(p)) for r, p in DECLARATION_ROLES]),
        F.when(F.col("kind") == "orm-model", "entity").when(F.col("kind") == "data-model", "transfer").otherwise("object"))
    declarations = d.select(
        "project_id", "file_id", "name", "kind", role.alias("role"), "base_types", "field_count", "method_count",
        "config_count", "start_line", (F.col("_last") + 1).alias("end_line"))
    return declarations, fields.drop("block")


def web_routes(files: DataFrame) -> DataFrame:
    """Declared routes of five web frameworks: framework, method, path."""
    content, path = F.col("content"), F.col("path")
    app = lambda p: F.coalesce(F.nullif(F.regexp_extract("content", p, 1), F.lit("")), F.lit("app"))
    grab = lambda pat, group: F.call_function("regexp_extract_all", content, pat, F.lit(group))
    verbs = r"(get|post|put|patch|delete)\s*\(\s*[\"']([^\"']+)[\"']"

    def pairs(framework, pattern, method_group=1, path_group=2, method=None):
        methods = grab(pattern, method_group) if method_group else F.transform(grab(pattern, path_group), lambda _: F.lit("GET"))
        if method is not None:
            methods = F.transform(methods, method)
        return F.transform(
            F.arrays_zip(methods.alias("m"), grab(pattern, path_group).alias("p")),
            lambda z: F.struct(F.lit(framework).alias("framework"), F.upper(z["m"]).alias("method"), z["p"].alias("route")))

    fastapi = F.concat(F.lit(r"(?i)@\Q"), app(r"\b([A-Za-z_]\w*)\s*=\s*FastAPI\s*\("), F.lit(r"\E\." + verbs))
    flask = F.concat(F.lit(r"(?i)@\Q"), app(r"\b([A-Za-z_]\w*)\s*=\s*Flask\s*\("),
                     F.lit(r"\E\.route\s*\(\s*[\"']([^\"']+)[\"']([^)]*)"))
    express = F.concat(F.lit(r"(?i)\b\Q"), app(r"\b([A-Za-z_$][\w$]*)\s*=\s*express\s*\("), F.lit(r"\E\." + verbs))
    spring = F.lit(r"@(Get|Post|Put|Patch|Delete)Mapping\s*\(\s*(?:value\s*=\s*)?[\"']([^\"']*)[\"']")
    django = F.lit(r"\bpath\s*\(\s*[\"']([^\"']*)[\"']")
    verb = lambda t: F.coalesce(
        F.nullif(F.regexp_extract(t, r"(?i)[\"'](GET|POST|PUT|PATCH|DELETE)[\"']", 1), F.lit("")), F.lit("GET"))
    own = (
        F.when(content.rlike(r"\bFastAPI\s*\("), pairs("fastapi", fastapi))
        .when(content.rlike(r"\bFlask\s*\("), pairs("flask", flask, 2, 1, verb))
        .when(content.rlike(r"\b(?:express\s*\(|require\([\"']express[\"']\)|from\s+[\"']express[\"'])"),
              pairs("express", express))
    )
    direct = files.select("project_id", "file_id", F.inline(own))
    # two frameworks keep their routes in other files of the project than the one that reveals the framework
    marks = files.groupBy("project_id").agg(
        F.bool_or(content.rlike(r"\bSpringApplication\.run\s*\(|@SpringBootApplication\b")).alias("_spring"),
        (F.bool_or(path.rlike(r"(?i)settings\.py$")) & F.bool_or(path.rlike(r"(?i)(?:^|/)manage\.py$"))).alias("_django"))
    marked = files.join(marks.where("_spring OR _django"), "project_id")
    springs = marked.where("_spring").select("project_id", "file_id", F.inline(pairs("spring", spring)))
    djangos = marked.where(F.col("_django") & path.rlike(r"(?i)urls\.py$")).select(
        "project_id", "file_id", F.inline(pairs("django", django, None, 1)))
    djangos = djangos.withColumn("route", F.regexp_replace(F.concat(F.lit("/"), "route"), "/+", "/"))
    springs = springs.withColumn("route", F.when(F.col("route") == "", "/").otherwise(F.col("route")))
    return direct.unionByName(springs).unionByName(djangos)
