"""Dependencies from manifests and lock files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import versions
from ..operators.windows import carry_forward

STATEFUL = ("yarn.lock", "poetry.lock", "cargo.lock", "cargo.toml")
_ROW = "array<struct<name:string,version:string,ecosystem:string,resolution:string,forced:boolean>>"


def _row(name: Column, version: Column, ecosystem: str, resolution: str, forced: bool) -> Column:
    return F.struct(
        name.alias("name"), version.alias("version"), F.lit(ecosystem).alias("ecosystem"),
        F.lit(resolution).alias("resolution"), F.lit(forced).alias("forced"))


def _entries(map_column: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.map_entries(F.coalesce(map_column, empty))


def _package_json(content: Column) -> Column:
    groups = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    parsed = F.from_json(content, "struct<" + ",".join(f"{g}:map<string,string>" for g in groups) + ">")
    entries = F.concat(*[_entries(parsed[g]) for g in groups])
    return F.transform(entries, lambda e: _row(e["key"], e["value"], "npm", "manifest", False))


def _package_lock(content: Column) -> Column:
    entry = "map<string,struct<version:string>>"
    parsed = F.from_json(content, f"struct<packages:{entry},dependencies:{entry}>")
    empty = F.create_map().cast(entry)
    packages = F.filter(
        F.map_entries(F.coalesce(parsed["packages"], empty)),
        lambda e: e["key"].contains("node_modules/") & e["value"]["version"].isNotNull())
    packages = F.transform(packages, lambda e: _row(
        F.regexp_extract(e["key"], r"(?s)^.*node_modules/(.*)$", 1), e["value"]["version"], "npm", "lockfile", True))
    old = F.filter(F.map_entries(F.coalesce(parsed["dependencies"], empty)), lambda e: e["value"]["version"].isNotNull())
    old = F.transform(old, lambda e: _row(e["key"], e["value"]["version"], "npm", "lockfile", True))
    return F.when(parsed["packages"].isNotNull(), packages).otherwise(old)


def _by_line(content: Column, pattern: str, name, version, ecosystem: str, resolution: str, forced: bool, trim=True) -> Column:
    lines = F.split(content, r"\r?\n")
    if trim:
        lines = F.transform(lines, lambda x: F.trim(x))
    kept = F.filter(lines, lambda l: l.rlike(pattern))
    return F.transform(kept, lambda l: _row(name(l), version(l), ecosystem, resolution, forced))


def _g(pattern: str, group: int):
    return lambda line: F.regexp_extract(line, pattern, group)


REQUIREMENT = r"^([A-Za-z0-9_.-]+)(?:\[[^\]]+\])?\s*(?:===|==|~=|>=|<=|>|<)?\s*([^\s;#]+)?"
PNPM = r"^\s{2,}[\"']?/?((?:@[^/\s]+/)?[^@:\s]+)@([^:\s(]+)(?:\([^)]*\))?[\"']?:\s*$"
GO_MOD = r"^(?:require\s+)?([^\s()]+)\s+v([0-9][^\s]*)$"
GO_SUM = r"^([^\s]+)\s+v([^\s/]+)(?:/go\.mod)?\s+h1:"
GRADLE = r"^([^:#\s]+):([^:\s]+):([^=\s]+)="
MAVEN = (
    r"<dependency>[\s\S]*?<groupId>([^<]+)</groupId>[\s\S]*?<artifactId>([^<]+)</artifactId>[\s\S]*?"
    r"(?:<version>([^<]+)</version>)?[\s\S]*?</dependency>")


def _stateless(base: Column, content: Column) -> Column:
    maven = F.arrays_zip(
        F.regexp_extract_all(content, F.lit(MAVEN), 1).alias("g"), F.regexp_extract_all(content, F.lit(MAVEN), 2).alias("a"),
        F.regexp_extract_all(content, F.lit(MAVEN), 3).alias("v"))
    go_mod = F.filter(
        _by_line(content, GO_MOD, _g(GO_MOD, 1), _g(GO_MOD, 2), "Go", "manifest", True),
        lambda r: ~r["name"].isin("go", "module"))
    return (
        F.when(base == "package.json", _package_json(content))
        .when(base.isin("package-lock.json", "npm-shrinkwrap.json"), _package_lock(content))
        .when(base == "pnpm-lock.yaml", _by_line(
            content, PNPM, _g(PNPM, 1), _g(PNPM, 2), "npm", "lockfile", True, trim=False))
        .when(base.rlike(r"^requirements(?:-[^.]+)?\.txt$"), _by_line(
            content, REQUIREMENT, _g(REQUIREMENT, 1), _g(REQUIREMENT, 2), "PyPI", "manifest", False))
        .when(base == "go.mod", go_mod)
        .when(base == "go.sum", _by_line(content, GO_SUM, _g(GO_SUM, 1), _g(GO_SUM, 2), "Go", "lockfile", True))
        .when(base == "pom.xml", F.transform(maven, lambda m: _row(
            F.concat(m["g"], F.lit(":"), m["a"]), m["v"], "Maven", "manifest", False)))
        .when(base.endswith(".lockfile"), _by_line(
            content, GRADLE, lambda l: F.concat(F.regexp_extract(l, GRADLE, 1), F.lit(":"), F.regexp_extract(l, GRADLE, 2)),
            _g(GRADLE, 3), "Maven", "lockfile", True))
        .otherwise(F.array().cast(_ROW))
    )


def selector_name(selector: Column) -> Column:
    """Package name of a yarn selector (scope kept, range dropped)."""
    plain = F.regexp_replace(selector, r"^['\"]|['\"]$", "")
    scoped = F.regexp_extract(plain, r"^(@[^/]*/?[^@]*)", 1)
    return F.when(plain.startswith("@"), scoped).otherwise(F.element_at(F.split(plain, "@"), 1))


def _stateful(files: DataFrame) -> DataFrame:
    """Formats whose version lines refer to an earlier line: carry the last name, selector or section forward."""
    lines = files.select(
        "project_id", "file_id", "path", "_base", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line"))
    line, base = F.col("line"), F.col("_base")
    package = base.isin("poetry.lock", "cargo.lock")
    name_line = F.regexp_extract("line", r"^name\s*=\s*\"([^\"]+)\"", 1)
    section = F.regexp_extract(F.trim("line"), r"^\[([^\]]+)\]$", 1)
    head = (base == "yarn.lock") & line.endswith(":") & ~line.rlike(r"^\s") & (line != "")
    mark = (
        F.when(package & (F.trim("line") == "[[package]]"), F.lit(""))
        .when(package & (name_line != ""), name_line)
        .when((base == "cargo.toml") & (section != ""), section)
        .when(head, F.substring("line", 1, 100_000_000))
    )
    carried = carry_forward(lines.withColumn("_mark", mark), ["file_id"], ["pos"], "_mark", "_state")
    version = F.regexp_extract("line", r"^version\s*=\s*\"([^\"]+)\"", 1)
    yarn_version = F.regexp_extract("line", r"^\s+version\s+[\"']([^\"']+)[\"']", 1)
    toml = r"^\s*([A-Za-z0-9_-]+)\s*=\s*(?:\"([^\"]+)\"|\{[^}]*version\s*=\s*\"([^\"]+)\")"
    toml_version = F.coalesce(
        F.nullif(F.regexp_extract("line", toml, 2), F.lit("")), F.regexp_extract("line", toml, 3))
    selectors = F.filter(F.transform(
        F.split(F.regexp_replace("_state", ":$", ""), r",\s*"), selector_name), lambda s: s != "")
    eco = F.when(base == "poetry.lock", "PyPI").otherwise("crates.io")
    package_rows = F.array(F.struct(
        F.col("_state").alias("name"), version.alias("version"), eco.alias("ecosystem"),
        F.lit("lockfile").alias("resolution"), F.lit(True).alias("forced")))
    rows = (
        F.when(package & (version != "") & (F.col("_state") != ""), package_rows)
        .when((base == "yarn.lock") & (yarn_version != ""), F.transform(
            selectors, lambda s: _row(s, yarn_version, "npm", "lockfile", True)))
        .when((base == "cargo.toml") & F.col("_state").rlike(r"(?:^|\.)dependencies$") & line.rlike(toml),
              F.array(_row(F.regexp_extract("line", toml, 1), toml_version, "crates.io", "manifest", False)))
        .otherwise(F.array().cast(_ROW))
    )
    return carried.select("project_id", "file_id", "path", "pos", F.posexplode(rows).alias("_sub", "_d"))


def dependencies(files: DataFrame) -> DataFrame:
    """One row per declared dependency of twelve manifest and lock-file formats, in file order."""
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    kept = files.withColumn("_base", base)
    plain = kept.where(~F.col("_base").isin(*STATEFUL)).select(
        "project_id", "file_id", "path", F.posexplode(_stateless(F.col("_base"), F.col("content"))).alias("pos", "_d"))
    plain = plain.withColumn("_sub", F.lit(0))
    both = plain.unionByName(_stateful(kept.where(F.col("_base").isin(*STATEFUL))))
    constraint = F.trim(F.coalesce("_d.version", F.lit("")))
    exact = F.col("_d.forced") | versions.is_exact(constraint)
    return both.select(
        "project_id", "file_id", F.col("path").alias("source_file"),
        F.struct("file_id", "pos", "_sub").alias("ordinal"), F.trim("_d.name").alias("name"),
        F.when(exact, versions.clean_version(constraint)).otherwise(constraint).alias("version"),
        constraint.alias("version_constraint"), F.col("_d.ecosystem").alias("ecosystem"),
        F.col("_d.resolution").alias("resolution"), exact.alias("exact"))
