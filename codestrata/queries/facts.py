"""Function facts computed from the derived bodies: by the library for Spark, by plain SQL for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import flow, text
from ..session import spread
from .bindings import ORACLE_DEPENDS, ORACLE_RELATIONS, Bound


def function_facts(b: Bound) -> DataFrame:
    """Every text-derived column of a function."""
    df = spread(b.fn, "function_id").select(
        "function_id", "project_id", "file_id", "slot", "path", "name", "language", "body", "hint", "p_size",
        text.params(F.col("params_text")).alias("params"),
    )
    df = df.withColumn("return_type", text.return_type(F.col("hint"), F.col("body")))
    df = df.select(
        "*",
        text.category(F.col("name")).alias("category"),
        text.complexity(F.col("body")).alias("complexity"),
        text.risks(F.col("body")).alias("risks"),
        text.validations(F.col("body")).alias("validations"),
        text.side_effects(F.col("body")).alias("side_effects"),
        text.external_inputs(F.col("name"), F.col("body"), F.col("params")).alias("external_inputs"),
        text.outputs(F.col("body"), F.col("return_type")).alias("outputs"),
        text.data_shape(F.col("params"), F.col("return_type")).alias("data_shape"),
        text.parse_confidence(F.col("language"), F.col("body"), F.col("return_type")).alias("confidence"),
    )
    return df.withColumn("summary", F.concat_ws(" ", "name", F.concat_ws(" ", "params"), F.concat_ws(" ", "outputs")))


def with_degrees(facts: DataFrame, edges: DataFrame) -> DataFrame:
    from ..operators.edges import degrees

    deg = degrees(edges)
    return facts.join(deg, facts.function_id == deg.node, "left").drop("node").fillna(0, ["in_degree", "out_degree"])


def q(text_: str) -> str:
    return "'" + text_.replace("'", "''") + "'"


def sql_flags(pairs) -> str:
    cases = ", ".join(f"CASE WHEN {cond} THEN {q(name)} END" for name, cond in pairs)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def sql_rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def _risk_cond(pattern, guard):
    base = sql_rx("lower(body)", pattern)
    return f"{base} AND NOT {sql_rx('lower(body)', guard)}" if guard else base


_CATEGORY = " ".join(
    "WHEN " + " OR ".join(f"contains(lower(name), {q(w)})" for w in words) + f" THEN {q(label)}"
    for label, words in text.CATEGORY_WORDS.items()
)
_EXT = "lower(name || ' ' || body || ' ' || array_to_string(params, ' '))"

ORACLE_RELATIONS["facts0"] = f"""
    SELECT *, CASE WHEN hint <> '' THEN hint WHEN regexp_matches(body, '\\breturn\\b') THEN 'inferred' ELSE 'void' END
                  AS return_type,
           CASE {_CATEGORY} ELSE 'business' END AS category,
           CAST(len(regexp_extract_all(body, {q(text.COMPLEXITY_WORDS)})) + 1 AS BIGINT) AS complexity,
           {sql_flags((n, _risk_cond(p, g)) for n, (p, g) in text.RISK_PATTERNS.items())} AS risks,
           {sql_flags((n, sql_rx('lower(body)', p)) for n, p in text.VALIDATION_PATTERNS.items())} AS validations,
           {sql_flags((n, sql_rx('lower(body)', p)) for n, p in text.SIDE_EFFECT_PATTERNS.items())} AS side_effects,
           {sql_flags((n, sql_rx(_EXT, p)) for n, p in text.EXTERNAL_INPUT_PATTERNS.items())} AS external_inputs
    FROM (SELECT *, list_filter(list_transform(string_split(params_text, ','), lambda x: trim(x)), lambda x: x <> '')
                 AS params FROM fn)"""
ORACLE_DEPENDS["facts0"] = ("fn",)
ORACLE_RELATIONS["facts"] = f"""
    SELECT *, name || ' ' || CASE WHEN len(params) > 0 THEN array_to_string(params, ' ') || ' ' ELSE ' ' END
              || array_to_string(outputs, ' ') AS summary,
           CAST(least(92, 76 + CASE WHEN return_type <> 'inferred' THEN 8 ELSE 0 END
                + CASE WHEN len(validations) > 0 THEN 5 ELSE 0 END
                + CASE WHEN contains(body, '{{') OR language = 'Python' THEN 4 ELSE 0 END) AS BIGINT) AS confidence,
           '(' || CASE WHEN len(params) = 0 THEN 'void' ELSE array_to_string(list_transform(params[1:3],
                lambda p: CASE WHEN contains(p, ':') THEN trim(string_split(p, ':')[2]) ELSE p END), ', ') END
              || ') -> ' || return_type AS data_shape
    FROM (SELECT *, CASE WHEN len(found) > 0 THEN found
                        ELSE [CASE WHEN return_type = 'void' THEN 'state change/void' ELSE return_type END] END AS outputs
          FROM (SELECT *, list_concat(
                    list_transform(regexp_extract_all(body, '\\breturn\\s+([^;\\n]+)', 1)[1:2], lambda e: trim(e)),
                    {sql_flags((n, sql_rx('body', p)) for n, p in text.OUTPUT_TAG_PATTERNS.items())}) AS found
                FROM facts0))"""
ORACLE_DEPENDS["facts"] = ("facts0",)
ORACLE_RELATIONS["deg"] = """
    SELECT function_id AS node, CAST(count(*) FILTER (WHERE dst = function_id) AS BIGINT) AS in_degree,
           CAST(count(*) FILTER (WHERE src = function_id) AS BIGINT) AS out_degree
    FROM (SELECT src AS function_id, src, -1 AS dst FROM edges UNION ALL SELECT dst, -1, dst FROM edges)
    GROUP BY function_id"""
ORACLE_DEPENDS["deg"] = ("edges",)
ORACLE_RELATIONS["factsd"] = """
    SELECT facts.*, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree
    FROM facts LEFT JOIN deg ON node = function_id"""
ORACLE_DEPENDS["factsd"] = ("facts", "deg")
ORACLE_RELATIONS["nodes"] = """
    SELECT *, CASE WHEN function_id % 53 = 0 OR list_contains(risks, 'infinite-loop') THEN 'Blocked'
                WHEN list_contains(risks, 'overflow') THEN 'Overflow Risk'
                WHEN list_has_any(risks, ['code-injection', 'command-execution', 'sql-injection', 'path-traversal'])
                    THEN 'Blocked'
                WHEN len(risks) > 0 THEN 'Partially Closed'
                WHEN len(external_inputs) > 0 AND len(validations) = 0 AND out_degree > 0 THEN 'Partially Closed'
                WHEN real OR out_degree > 0 OR len(validations) > 0 THEN 'Closed' ELSE 'Open' END AS status
    FROM (SELECT *, len(list_filter(outputs, lambda o: o NOT IN ('void', 'state change/void'))) > 0 AS real FROM factsd)"""
ORACLE_DEPENDS["nodes"] = ("factsd",)


def flow_nodes(b: Bound) -> DataFrame:
    """Functions with degree and state; every 53rd function carries a breakpoint."""
    df = with_degrees(function_facts(b), b.edges)
    return df.withColumn(
        "status",
        flow.node_status(
            F.col("risks"), F.col("validations"), F.col("external_inputs"), F.col("outputs"), F.col("out_degree"),
            F.col("function_id") % 53 == 0,
        ),
    )
