"""Relations of the analysis model derived from the driver's tables.

The test tables hold no source code, so code-shaped facts are derived from them row by row: one function per
``part``, one run per ``event``, one dependency per ``lineitem`` and so on.  The derivation is plain SQL that both
Spark and the checking engine accept, so the two start from identical rows; the operators under test do not share
any text with the checks.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

VERBS = (
    "parse", "build", "validate", "run", "load", "save", "score", "handle_request", "sanitize", "execute_query",
    "render", "fetch",
)


def _verb(expr: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(VERBS))
    return f"CASE ({expr}) % {len(VERBS)} {cases} END || '_' || CAST({expr} AS STRING)"


_NL = "chr(10)"

RELATIONS: dict[str, str] = {
    # 40 functions per project, 8 per file, 1-2 calls each inside the project
    "fn_base": """
        SELECT p_partkey AS function_id,
               CAST(floor(p_partkey / 40) AS BIGINT) AS project_id,
               CAST(floor(p_partkey / 8) AS BIGINT) AS file_id,
               p_partkey % 8 AS slot,
               p_partkey % 40 AS local_ix,
               CAST(p_size AS BIGINT) AS p_size, p_brand, p_type, p_name,
               CASE WHEN p_partkey % 5 <> 4
                    THEN CAST(floor(p_partkey / 40) AS BIGINT) * 40 + (7 * (p_partkey % 40) + 3) % 40 END AS c1,
               CASE WHEN p_partkey % 3 = 0
                    THEN CAST(floor(p_partkey / 40) AS BIGINT) * 40 + (p_partkey % 40 + 1) % 40 END AS c2
        FROM part""",
    "fn_sig": f"""
        SELECT *, {_verb('function_id')} AS name,
               CASE file_id % 4 WHEN 0 THEN 'TypeScript' WHEN 1 THEN 'Python' WHEN 2 THEN 'Go' ELSE 'Rust' END
                   AS language,
               CASE p_size % 4 WHEN 0 THEN 'request: string, limit: number' WHEN 1 THEN 'value'
                    WHEN 2 THEN '' ELSE 'payload: string, user, mode: any' END AS params_text,
               CASE p_size % 4 WHEN 0 THEN 'request' WHEN 1 THEN 'value' WHEN 2 THEN 'seed' ELSE 'payload' END AS arg0,
               CASE WHEN p_size % 5 = 1 THEN '' ELSE 'string' END AS hint,
               {_verb('c1')} AS callee1, {_verb('c2')} AS callee2
        FROM fn_base""",
    "fn": f"""
        SELECT function_id, project_id, file_id, slot, local_ix, p_size, p_brand, p_type, c1, c2, name, language,
               'src/mod_' || CAST(project_id % 7 AS STRING) || '/file_' || CAST(file_id AS STRING)
                   || CASE file_id % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' ELSE '.rs' END AS path,
               params_text, arg0, hint, callee1, callee2,
               CASE language WHEN 'TypeScript' THEN 'export function ' || name || '(' || params_text || ')'
                         || CASE WHEN hint = '' THEN '' ELSE ': ' || hint END || ' {{'
                    WHEN 'Python' THEN 'def ' || name || '(' || params_text || ')'
                         || CASE WHEN hint = '' THEN '' ELSE ' -> ' || hint END || ':'
                    WHEN 'Go' THEN 'func ' || name || '(' || params_text || ') '
                         || hint || ' {{'
                    ELSE 'pub fn ' || name || '(' || params_text || ')'
                         || CASE WHEN hint = '' THEN '' ELSE ' -> ' || hint END || ' {{' END
               || CASE WHEN c1 IS NOT NULL THEN {_NL} || '  first = ' || callee1 || '(' || arg0 || ', 7)' ELSE '' END
               || {_NL} || CASE p_size % 10
                    WHEN 0 THEN '  eval(first)' WHEN 1 THEN '  subprocess.run(first)'
                    WHEN 2 THEN '  queue.push(first)' WHEN 3 THEN '  cache.set(first) # limit'
                    WHEN 4 THEN '  rows = db.query("select * from t where id=" + first)'
                    WHEN 5 THEN '  open("../data/" + first)' WHEN 6 THEN '  if (first < 10) {{ throw first }}'
                    WHEN 7 THEN '  try {{ validate(first) }} catch {{ }}' WHEN 8 THEN '  holder.left = first'
                    ELSE '  save(first)' END
               || CASE WHEN c2 IS NOT NULL THEN {_NL} || '  second = ' || callee2 || '(first)' ELSE '' END
               || CASE WHEN p_size % 2 = 0 THEN {_NL} || '  return first' ELSE '' END
               || CASE WHEN language = 'Python' THEN '' ELSE {_NL} || '}}' END AS body
        FROM fn_sig""".replace("{{", "{").replace("}}", "}"),
    "edges": """
        SELECT project_id, function_id AS src, c1 AS dst, CAST(0 AS BIGINT) AS ord,
               CAST(60 + function_id % 30 AS BIGINT) AS confidence FROM fn_base WHERE c1 IS NOT NULL
        UNION ALL
        SELECT project_id, function_id AS src, c2 AS dst, CAST(1 AS BIGINT) AS ord,
               CAST(55 + function_id % 40 AS BIGINT) AS confidence FROM fn_base
        WHERE c2 IS NOT NULL AND (c1 IS NULL OR c1 <> c2)""",
    # one isolated or plain run per event
    "runs": """
        SELECT event_id AS run_id, user_id AS project_id, event_type,
               CASE event_type WHEN 'view' THEN 'stress' WHEN 'click' THEN 'baseline' WHEN 'purchase' THEN 'security'
                    WHEN 'signup' THEN 'fault' ELSE 'baseline' END AS experiment_kind,
               CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'timeout' ELSE 'failed' END
                    WHEN event_id % 97 = 0 THEN 'unavailable' ELSE 'passed' END AS status,
               'stress-bounded-16x-' || CAST(user_id % 9 AS STRING) || '-'
                   || lpad(CAST(event_id % 20 AS STRING), 2, '0') AS sample_id,
               CAST(floor(value * 10) AS BIGINT) AS duration_ms,
               CAST(floor(value * 3) AS BIGINT) AS cpu_time_ms,
               CAST(floor(value * 1024) AS BIGINT) AS peak_memory_bytes,
               CASE WHEN event_id % 11 = 0 THEN 'none' ELSE 'container' END AS sandbox_kind,
               event_id * 1000 AS started_at
        FROM events""",
    "deps": """
        SELECT l_orderkey AS project_id, l_linenumber AS line,
               'pkg-' || CAST(l_partkey AS STRING) AS name,
               CASE l_returnflag WHEN 'A' THEN 'npm' WHEN 'N' THEN 'python' ELSE 'Cargo' END AS ecosystem,
               CASE WHEN l_linestatus = 'F' OR l_suppkey % 2 = 0
                    THEN CAST(l_linenumber AS STRING) || '.' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || '.'
                         || CAST(l_suppkey % 10 AS STRING)
                    ELSE '^' || CAST(l_linenumber AS STRING) || '.0' END AS version,
               l_linestatus = 'F' OR l_suppkey % 2 = 0 AS exact
        FROM lineitem""",
    "advs": """
        SELECT p_partkey AS advisory_key, 'CVE-2024-' || CAST(10000 + p_partkey AS STRING) AS external_id,
               CASE p_partkey % 3 WHEN 0 THEN 'osv' WHEN 1 THEN 'nvd' ELSE 'osv' END AS source_id,
               'PKG-' || CAST(p_partkey AS STRING) AS package_name,
               CASE p_partkey % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' WHEN 2 THEN 'crates.io' ELSE 'npm' END AS ecosystem,
               CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
               CAST(p_size % 5 AS STRING) || '.' || CAST(p_size AS STRING) || '.0' AS introduced,
               CASE WHEN p_size % 3 = 0 THEN NULL
                    ELSE CAST(p_size % 5 + 2 AS STRING) || '.0.' || CAST(p_size % 10 AS STRING) END AS fixed,
               CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN CAST(p_size % 5 + 1 AS STRING) || '.9.9' END AS last_affected,
               CASE WHEN p_size % 7 = 0 THEN '*' ELSE CAST(p_size % 7 AS STRING) || '.'
                    || CAST(p_size AS STRING) || '.' || CAST(p_partkey % 10 AS STRING) END AS cpe_version,
               p_size % 6 = 0 AS kev
        FROM part""",
    "issues": """
        SELECT l_orderkey * 10 + l_linenumber AS issue_id, l_suppkey AS project_id,
               CASE l_returnflag WHEN 'A' THEN 'security' WHEN 'N' THEN 'quality' ELSE 'environment' END AS category,
               CASE l_linenumber % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END
                   AS severity,
               CASE CAST(l_quantity AS BIGINT) % 4 WHEN 0 THEN 'Confirmed' WHEN 1 THEN 'Likely' WHEN 2 THEN 'Possible'
                    ELSE 'Unknown' END AS status,
               'issue ' || CAST(l_partkey % 50 AS STRING) AS title,
               CASE WHEN l_partkey % 4 = 0 THEN 'heuristic signal ' ELSE 'signal ' END
                   || CAST(l_partkey % 20 AS STRING) AS evidence,
               CAST(40 + l_partkey % 60 AS BIGINT) AS confidence
        FROM lineitem""",
    # four statements per function: parameter, call result, copy, return
    "cfg": """
        SELECT function_id, project_id, CAST(0 AS BIGINT) AS ord, 'entry' AS kind, arg0 AS defs, '' AS uses,
               CASE WHEN p_size % 4 = 2 THEN 'open' ELSE '' END AS ownership, '' AS concurrency FROM fn_sig
        UNION ALL
        SELECT function_id, project_id, CAST(1 AS BIGINT), 'statement', 'first', arg0, '',
               CASE WHEN p_size % 5 = 0 THEN 'spawn' ELSE '' END FROM fn_sig
        UNION ALL
        SELECT function_id, project_id, CAST(2 AS BIGINT),
               CASE WHEN p_size % 3 = 2 THEN 'branch' ELSE 'statement' END,
               CASE WHEN p_size % 3 = 1 THEN 'sanitized_value' WHEN p_size % 3 = 2 THEN 'first' ELSE 'second' END, 'first',
               CASE WHEN p_size % 6 = 0 THEN 'close' ELSE '' END,
               CASE WHEN p_size % 5 = 0 THEN 'spawn' ELSE '' END FROM fn_sig
        UNION ALL
        SELECT function_id, project_id, CAST(3 AS BIGINT), 'statement', 'shared_total',
               CASE WHEN p_size % 3 = 1 THEN 'sanitized_value' WHEN p_size % 3 = 2 THEN 'first' ELSE 'second' END, '',
               CASE WHEN p_size % 10 = 0 THEN 'mutex spawn' WHEN p_size % 5 = 0 THEN 'spawn' ELSE '' END FROM fn_sig
        UNION ALL
        SELECT function_id, project_id, CAST(4 AS BIGINT), 'return', '', 'shared_total', '', '' FROM fn_sig""",
}

_DEPENDS = {
    "fn_base": (), "fn_sig": ("fn_base",), "fn": ("fn_base", "fn_sig"), "edges": ("fn_base",), "runs": (),
    "deps": (), "advs": (), "issues": (), "cfg": ("fn_base", "fn_sig"),
}


ORACLE_RELATIONS: dict[str, str] = {}
ORACLE_DEPENDS: dict[str, tuple[str, ...]] = {}


def _chain(names: list[str]) -> list[str]:
    ordered: list[str] = []
    for name in names:
        direct = _DEPENDS[name] if name in _DEPENDS else tuple(_chain(list(ORACLE_DEPENDS[name])))
        for dep in (*direct, name):
            if dep not in ordered:
                ordered.append(dep)
    return ordered


def oracle_with(sql: str) -> str:
    """Prefix the derived relations that ``sql`` mentions as common table expressions."""
    known = {**RELATIONS, **ORACLE_RELATIONS}
    used = _chain([n for n in known if re.search(rf"\b{n}\b", sql)])
    if not used:
        return sql
    prefix = ",\n".join(f"{n} AS ({known[n]})" for n in used)
    stripped = sql.lstrip()
    if stripped.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {prefix},\n{stripped[len('WITH RECURSIVE'):]}"
    if stripped.upper().startswith("WITH"):
        return f"WITH {prefix},\n{stripped[len('WITH'):]}"
    return f"WITH {prefix}\n{sql}"


class Bound:
    """The relations for one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.table(name)
        if name in RELATIONS:
            chain = _chain([name])
            text = ",\n".join(f"{n} AS ({RELATIONS[n]})" for n in chain) + f"\nSELECT * FROM {name}"
            needed = [t for t in BASE_TABLES if re.search(rf"\b{t}\b", text)]
            heads = ",\n".join(f"{t} AS (SELECT * FROM parquet.`{self.sf_dir}/{t}.parquet`)" for t in needed)
            return self.spark.sql(f"WITH {heads},\n{text}")
        raise AttributeError(name)
