"""Source files: scan, language, references, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import flow
from ..functions.common import all_groups, first_match, lookup, round_half_up

# Languages by file extension, manifests, skipped folders.
LANGUAGE_BY_EXTENSION = {
    "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "py": "Python", "go": "Go",
    "rs": "Rust", "java": "Java", "cs": "C#", "cpp": "C++", "cc": "C++", "cxx": "C++", "c": "C", "h": "C/C++",
    "php": "PHP", "rb": "Ruby", "kt": "Kotlin", "swift": "Swift", "sh": "Shell", "bash": "Shell", "zsh": "Shell",
    "sql": "SQL", "json": "JSON", "toml": "TOML", "yaml": "YAML", "yml": "YAML", "md": "Markdown",
}
SKIPPED = r"(^|/)(node_modules|\.git|\.next|dist|build|target|venv|\.venv|__pycache__|coverage|vendor)(/|$)"
NAMED_MANIFEST = (
    r"(package\.json|requirements\.txt|go\.mod|Cargo\.toml|pyproject\.toml|Makefile|CMakeLists\.txt)$")
IMPORT_PATTERNS = (
    r"\bimport\s+(?:[^'\";]+?\s+from\s+)?[\"']([^\"']+)[\"']",
    r"\brequire\([\"']([^\"']+)[\"']\)",
    r"(?m)^\s*from\s+([\w.]+)\s+import\s+",
    r"(?m)^\s*import\s+([\w.]+)",
    r"(?m)^\s*#include\s+[<\"]([^>\"]+)[>\"]",
    r"(?m)^\s*package\s+([\w./-]+)",
    r"(?m)^\s*use\s+([\w:]+)(?:::|\s*;)",
)
ENVIRONMENT_PATTERNS = (
    r"\bprocess\.env\.([A-Z0-9_]+)\b",
    r"\bos\.environ(?:\.get)?\([\"']([A-Z0-9_]+)[\"']\)",
    r"\bos\.environ\[['\"]([A-Z0-9_]+)['\"]\]",
    r"\bos\.getenv\([\"']([A-Z0-9_]+)[\"']\)",
    r"\bgetenv\([\"']?([A-Z0-9_]+)[\"']?\)",
    r"\b(import\.meta\.env\.[A-Z0-9_]+)\b",
)
MANIFEST_NAME = (
    r"(?i)package\.json|next\.config|vite\.config|wrangler|dockerfile|compose|requirements|pyproject|go\.mod|"
    r"Cargo\.toml|CMakeLists")
WELL_KNOWN_VARIABLES = r"\b(PORT|DATABASE_URL|API_KEY|SECRET|TOKEN|NODE_ENV|PYTHONPATH|CLASSPATH)\b"
DEVICE_PATTERNS = (
    r"\b(Serial\.(?:read|available|write|begin))\b",
    r"\b(digital(?:Read|Write)|analog(?:Read|Write)|pinMode|attachInterrupt)\b",
    r"\b(GPIO|PWM|UART|I2C|SPI|ADC|DAC)\b",
    r"(?i)\b(relay|motor|sensor|watchdog|heartbeat|safeStop)\b",
)
FRAMEWORK_PATTERNS = {
    "FastAPI": r"\bfastapi\b", "Django": r"\bdjango\b", "Express": r"\bexpress\b",
    "Spring": r"\b(?:springframework|spring-boot)\b", "Rails": r"\b(?:rails|actioncontroller)\b",
    "React": r"\b(?:react-dom|from\s+[\"']react[\"'])", "Tauri": r"\b(?:tauri|__tauri__)\b",
}
FILE_ROLES = (
    ("environment", r"package json|requirements|cargo toml|pom xml|gradle|config|manifest|dockerfile"),
    ("test", r"test|spec|fixture|mock|benchmark"),
    ("entry", r"main|index|app|server|controller|bootstrap"),
    ("data-model", r"model|entity|schema|database|repository|crud"),
    ("interface", r"component|page|view|ui|screen"),
    ("analysis", r"parser|compiler|analyzer|flow|graph"),
)


def extension(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def is_project_file(path: Column) -> Column:
    """Known extension or manifest outside vendored and build folders."""
    normal = F.regexp_replace(path, r"\\", "/")
    known = extension(normal).isin(*LANGUAGE_BY_EXTENSION) | normal.rlike(NAMED_MANIFEST)
    return ~normal.rlike(SKIPPED) & known


def detect_language(path: Column, content: Column) -> Column:
    """By extension, else by the look of the first definitions."""
    return F.coalesce(
        lookup(extension(path), LANGUAGE_BY_EXTENSION),
        F.when(content.rlike(r"(?m)^\s*def\s+\w+"), "Python")
        .when(content.rlike(r"(?m)^\s*func\s+\w+"), "Go")
        .when(content.rlike(r"(?m)^\s*(export\s+)?function\s+\w+"), "JavaScript")
        .otherwise("Plain Text"),
    )


def _union(first: Column, *rest: Column) -> Column:
    out = first
    for part in rest:
        out = F.concat(out, part)
    return F.array_distinct(out)


def imports(path: Column, content: Column, limit: int | None = None) -> Column:
    """Imported names in order of the seven source patterns, then manifest entries."""
    base = F.lower(path)
    found = [all_groups(content, p) for p in IMPORT_PATTERNS]
    manifest = "struct<dependencies:map<string,string>,devDependencies:map<string,string>," \
               "peerDependencies:map<string,string>,optionalDependencies:map<string,string>>"
    parsed = F.from_json(content, manifest)
    empty = F.array().cast("array<string>")
    # text that is no JSON at all keeps the quoted keys, as far as they can be seen
    readable = F.try_parse_json(content).isNotNull()
    keys = F.when(readable, F.concat(*[
        F.coalesce(F.map_keys(parsed[k]), empty)
        for k in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    ])).otherwise(all_groups(content, r"\"([^\"]+)\":\s*\"[^\"]+\""))
    lines = F.transform(
        F.split(content, r"\r?\n"), lambda l: F.regexp_extract(F.trim(l), r"^([A-Za-z0-9_.@/-]+)", 1))
    kept = F.filter(lines, lambda d: (d != "") & ~d.rlike(r"^(module|require|\[|version|name)$"))
    out = _union(
        *found,
        F.when(base.endswith("package.json"), keys).otherwise(empty),
        F.when(base.rlike(r"(requirements\.txt|pyproject\.toml|go\.mod|cargo\.toml)$"), kept).otherwise(empty),
    )
    return F.slice(out, 1, limit) if limit else out


def environment_refs(path: Column, content: Column, limit: int | None = None) -> Column:
    """Names of environment variables and hints that a file depends on its environment."""
    both = F.concat(path, F.lit("\n"), content)
    empty = F.array().cast("array<string>")
    base = F.element_at(F.split(path, "/"), -1)
    out = _union(
        *[all_groups(both, p) for p in ENVIRONMENT_PATTERNS],
        F.when(path.rlike(MANIFEST_NAME), F.array(F.concat(F.lit("manifest:"), base))).otherwise(empty),
        F.when(content.rlike(WELL_KNOWN_VARIABLES), F.array(F.lit("runtime-env"))).otherwise(empty),
    )
    return F.slice(out, 1, limit) if limit else out


def device_refs(content: Column, limit: int | None = None) -> Column:
    """A06."""
    out = _union(*[all_groups(content, p) for p in DEVICE_PATTERNS])
    return F.slice(out, 1, limit) if limit else out


def content_hash(content: Column) -> Column:
    """A03."""
    return F.sha2(content, 256)


def describe_files(files: DataFrame) -> DataFrame:
    """A02-A06 for files with ``path`` and ``content``."""
    path, content = F.col("path"), F.col("content")
    return files.select(
        "*", detect_language(path, content).alias("language"), content_hash(content).alias("hash"),
        F.octet_length(content).cast("long").alias("size"), imports(path, content).alias("imports"),
        environment_refs(path, content).alias("environment_refs"), device_refs(content).alias("device_refs"))


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every project file below ``root``; listing, reading and filtering run as one partitioned scan.

    The path filter is applied to the file's metadata, so skipped folders cost a listing entry but no read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = raw.where(is_project_file(F.col("path")))
    return kept.select(
        "path", F.unix_millis("modificationTime").alias("last_modified"),
        F.decode("content", "UTF-8").alias("content"))


def fingerprint(df: DataFrame, keys: Sequence[str], parts: Sequence[str], name: str = "fingerprint") -> DataFrame:
    """Hash of the multiset of rows of each group, independent of row order.

    Four 60-bit lanes of every row's SHA-256 are added up modulo 2^60 and hashed once more.  The sums combine
    map-side, so a group of any size needs no sorted or collected list.
    """
    row = F.sha2(F.concat_ws(":", *parts), 256)
    hashed = df.select(*keys, row.alias("_h"))
    lanes = [F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = hashed.groupBy(*keys).agg(*[F.sum(lane).alias(f"_l{i}") for i, lane in enumerate(lanes)])
    width = F.lit(str(2 ** 60)).cast("decimal(20,0)")
    joined = F.concat_ws("-", *[(F.col(f"_l{i}") % width).cast("decimal(20,0)").cast("string") for i in range(4)])
    return sums.select(*keys, F.sha2(joined, 256).alias(name))


def changed_files(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Files whose hash is new; unchanged ones are left out by an anti-join on (project, path, hash)."""
    return current.join(previous.select("project_id", "path", "hash"), ["project_id", "path", "hash"], "left_anti")


def framework_tags(files: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Frameworks a project mentions, one boolean aggregate per tag."""
    text = F.lower(F.concat_ws("\n", "path", "content"))
    per_file = files.select(*keys, *[text.rlike(p).alias(f"_{n}") for n, p in FRAMEWORK_PATTERNS.items()])
    seen = per_file.groupBy(*keys).agg(*[F.bool_or(f"_{n}").alias(f"_{n}") for n in FRAMEWORK_PATTERNS])
    return seen.select(*keys, F.array_compact(F.array(*[
        F.when(F.col(f"_{n}"), F.lit(n)) for n in FRAMEWORK_PATTERNS])).alias("frameworks"))


def word_text(column: Column) -> Column:
    """Identifier split into lower-case words."""
    split = F.regexp_replace(column, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(split, r"[^A-Za-z0-9]+", " ")))


def file_roles(files: DataFrame, functions: DataFrame) -> DataFrame:
    """Role of a file from its path, imports and function names."""
    names = functions.groupBy("file_id").agg(
        F.array_join(F.array_sort(F.collect_list("name")), " ").alias("_names"), F.count(F.lit(1)).alias("_n"))
    joined = files.join(names, "file_id", "left")
    text = word_text(F.concat_ws(" ", "path", F.concat_ws(" ", "imports"), "_names"))
    role = first_match([(label, text.rlike(p)) for label, p in FILE_ROLES])
    return joined.select(
        *files.columns,
        F.coalesce(role, F.when(F.col("_n").isNull(), "declaration").otherwise("implementation")).alias("role"))


def language_coverage(files: DataFrame, functions: DataFrame, diagnostics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Files, parsed files, functions and diagnostics per language, with a readiness state."""
    keys = [*keys, "language"]
    per_file = functions.groupBy("file_id").agg(F.count(F.lit(1)).alias("_fn"))
    diag = diagnostics.groupBy("file_id").agg(F.count(F.lit(1)).alias("_diag"))
    joined = files.join(per_file, "file_id", "left").join(diag, "file_id", "left")
    out = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("file_count"), F.count("_fn").alias("parsed_file_count"),
        F.coalesce(F.sum("_fn"), F.lit(0)).alias("function_count"),
        F.coalesce(F.sum("_diag"), F.lit(0)).alias("diagnostic_count"))
    return out.withColumn("status", F.when(
        F.col("parsed_file_count") == F.col("file_count"),
        F.when(F.col("diagnostic_count") == 0, "ast-ready").otherwise("ast-warning"))
        .when(F.col("parsed_file_count") > 0, "partial").otherwise("unsupported"))


def reliability(functions: DataFrame, warnings: Column, edges: Column, function_count: Column, average: Column) -> Column:
    """Parser reliability of a project, 42..93."""
    bonus = F.when(edges > 0, 7).when(function_count > 1, -5).otherwise(0)
    return F.greatest(F.lit(42), F.least(F.lit(93), round_half_up(average + bonus - warnings * 4)))


def environment_issues(files: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Missing lock file, missing tests, dependence on environment variables; all flags in one aggregate."""
    variables = F.concat(
        all_groups(F.col("content"), r"process\.env\.([A-Z0-9_]+)"),
        all_groups(F.col("content"), r"os\.environ\[['\"]([A-Z0-9_]+)['\"]\]"))
    path = F.lower("path")
    flags = files.groupBy(*keys).agg(
        F.bool_or(path.endswith("package.json")).alias("has_manifest"),
        F.bool_or(flow.is_lock_file(F.col("path"))).alias("has_lock"),
        F.bool_or(flow.is_test_file(F.col("path"))).alias("has_tests"),
        F.bool_or(F.size(variables) > 0).alias("uses_variables"))
    rows = F.array_compact(F.array(
        F.when(F.col("has_manifest") & ~F.col("has_lock"), F.struct(
            F.lit("missing-lock").alias("title"), F.lit("Medium").alias("severity"), F.lit("Likely").alias("status"),
            F.lit(79).alias("confidence"))),
        F.when(~F.col("has_tests"), F.struct(
            F.lit("missing-tests").alias("title"), F.lit("Medium").alias("severity"), F.lit("Possible").alias("status"),
            F.lit(68).alias("confidence"))),
        F.when(F.col("uses_variables"), F.struct(
            F.lit("environment-variables").alias("title"), F.lit("Low").alias("severity"),
            F.lit("Confirmed").alias("status"), F.lit(88).alias("confidence")))))
    return flags.select(*keys, F.inline(rows))


def parse_diagnostics(files: DataFrame, functions: DataFrame, declarations: DataFrame, edges: DataFrame) -> DataFrame:
    """Files and projects whose facts look incomplete."""
    per_fn = functions.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("_fn"), F.count_if(F.col("confidence") < 70).alias("_low"))
    per_decl = declarations.groupBy("file_id").agg(F.count(F.lit(1)).alias("_decl"))
    f = files.join(per_fn, "file_id", "left").join(per_decl, "file_id", "left").fillna(0, ["_fn", "_low", "_decl"])
    from ..functions.text import SIGNATURE_LANGUAGES

    code = F.col("language").isin(*SIGNATURE_LANGUAGES)
    rows = F.array_compact(F.array(
        F.when((F.col("_fn") == 0) & (F.col("_decl") == 0) & code, F.struct(
            F.lit("no-functions").alias("kind"), F.lit("Warning").alias("severity"))),
        F.when((F.col("_fn") == 0) & (F.col("_decl") > 0), F.struct(
            F.lit("declarations-only").alias("kind"), F.lit("Info").alias("severity"))),
        F.when(F.col("_low") > 0, F.struct(F.lit("low-confidence").alias("kind"), F.lit("Risk").alias("severity")))))
    per_file = f.select("project_id", F.col("file_id"), F.inline(rows))
    linked = edges.select("project_id").distinct().withColumn("_linked", F.lit(True))
    project = f.groupBy("project_id").agg(
        F.count_if(code & (F.col("_fn") > 0)).alias("_exec"), F.sum("_fn").alias("_fns"),
        F.count_if(code & (F.col("_fn") == 0) & (F.col("_decl") == 0)).alias("_isolated"))
    project = project.join(linked, "project_id", "left")
    project_rows = F.array_compact(F.array(
        F.when((F.col("_exec") > 1) & (F.col("_fns") > 1) & F.col("_linked").isNull(), F.struct(
            F.lit("no-call-edges").alias("kind"), F.lit("Warning").alias("severity"))),
        F.when(F.col("_isolated") > 0, F.struct(
            F.lit("isolated-files").alias("kind"), F.lit("Info").alias("severity")))))
    per_project = project.select(
        "project_id", F.lit(None).cast(files.schema["file_id"].dataType).alias("file_id"), F.inline(project_rows))
    return per_file.unionByName(per_project)


def validate_backup(files: DataFrame, expected: DataFrame, max_projects: int = 200, max_files: int = 50_000,
                    max_bytes: int = 100_000_000) -> DataFrame:
    """Limits and checksum of a backup (key ``backup_id``); one verdict row each.

    ``expected`` has ``backup_id, checksum``; the checksum is :func:`fingerprint` over project, path and content hash.
    """
    sized = files.select(
        "backup_id", "project_id", "path", F.sha2("content", 256).alias("hash"), F.length("content").cast("long").alias("_b"))
    per_project = sized.groupBy("backup_id", "project_id").agg(F.count(F.lit(1)).alias("_f"), F.sum("_b").alias("_b"))
    totals = per_project.groupBy("backup_id").agg(
        F.count(F.lit(1)).alias("projects"), F.sum("_f").alias("files"), F.sum("_b").alias("bytes"))
    actual = fingerprint(sized, ["backup_id"], ["project_id", "path", "hash"], "_actual")
    joined = totals.join(actual, "backup_id").join(expected, "backup_id", "left")
    ok = (F.col("projects") <= max_projects) & (F.col("files") <= max_files) & (F.col("bytes") <= max_bytes)
    return joined.select(
        "backup_id", "projects", "files", "bytes", ok.alias("within_limits"),
        F.coalesce(F.col("checksum") == F.col("_actual"), F.lit(False)).alias("checksum_ok"))
