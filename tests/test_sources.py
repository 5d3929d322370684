"""Files, manifests, advisories, fusion and sinks on fixtures with known answers."""

import json

import pytest
from pyspark.sql import functions as F

from codestrata.functions import versions
from codestrata.operators import advisories, fusion
from codestrata.operators.windows import next_in_order
from codestrata.plans.analyze import analyze
from codestrata.sources import code, feeds, manifests, sinks, traces, tree

FILES = "project_id int, file_id int, path string, content string"


def test_dependency_extraction_order_and_exactness(spark):
    files = [
        (0, 1, "package.json", json.dumps({"dependencies": {"next": "^16.2.12"}})), (0, 2, "requirements.txt", "fastapi==0.116.0\n# note"),
        (0, 3, "Cargo.toml", "[dependencies]\nserde = \"1.0.219\"\n"), (0, 4, "go.mod", "module x\nrequire example.org/lib v1.2.3\n"),
        (0, 5, "pom.xml", "<dependency><groupId>org.demo</groupId><artifactId>core</artifactId><version>2.1.0</version></dependency>")]
    got = manifests.dependencies(spark.createDataFrame(files, FILES)).orderBy("ordinal").collect()
    assert [(r["ecosystem"], r["name"], r["version"], r["exact"]) for r in got] == [
        ("npm", "next", "^16.2.12", False), ("PyPI", "fastapi", "0.116.0", True), ("crates.io", "serde", "1.0.219", True),
        ("Go", "example.org/lib", "1.2.3", True), ("Maven", "org.demo:core", "2.1.0", True)]


def test_lockfile_beats_manifest(spark):
    files = [
        (0, 1, "package.json", json.dumps({"dependencies": {"next": "^16.2.0"}})),
        (0, 2, "package-lock.json", json.dumps({"packages": {"": {}, "node_modules/next": {"version": "16.2.12"}}})),
        (0, 3, "pnpm-lock.yaml", "packages:\n  /@scope/a@1.2.3(peer@1):\n"), (0, 4, "go.sum", "example.org/lib v1.2.3/go.mod h1:abc=\n")]
    deps = advisories.dedupe_dependencies(manifests.dependencies(spark.createDataFrame(files, FILES)))
    got = {r["name"]: (r["version"], r["resolution"], r["exact"]) for r in deps.collect()}
    assert got["next"] == ("16.2.12", "lockfile", True) and got["@scope/a"][0] == "1.2.3" and got["example.org/lib"][2]


@pytest.mark.parametrize("version,expected", [
    ("1.5.0", "affected"), ("2.0.0", "not-affected"), ("1.0.0", "affected"), ("1.0.0-rc.1", "not-affected"), ("workspace:*", "unknown"),
    ("2.0.0-beta.2", "affected")])
def test_version_window(spark, version, expected):
    window = F.array(F.struct(F.lit("1.0.0").alias("introduced"), F.lit("2.0.0").alias("fixed"), F.lit(None).cast("string").alias("last_affected")))
    row = spark.range(1).select(versions.window_match(F.lit(version), F.array().cast("array<string>"), window).alias("m")).first()
    assert row["m"] == expected


def test_cpe_equality_and_prerelease_order(spark):
    row = spark.range(1).select(
        versions.cpe_match(F.lit("3.2.1"), F.array(F.lit("3.2.1"))).alias("a"), versions.cpe_match(F.lit("3.2.2"), F.array(F.lit("3.2.1"))).alias("b"),
        versions.cpe_match(F.lit("3.2.2"), F.array(F.lit("*"), F.lit("3.2.2"))).alias("c"),
        (versions.sort_key(F.lit("1.0.0-alpha.2")) < versions.sort_key(F.lit("1.0.0-alpha.10"))).alias("d"),
        (versions.sort_key(F.lit("1.0.0-9")) < versions.sort_key(F.lit("1.0.0-a"))).alias("e"),
        (versions.sort_key(F.lit("1.0.0-a")) < versions.sort_key(F.lit("1.0.0-a.1"))).alias("f"),
        (versions.sort_key(F.lit("1.0.0-z")) < versions.sort_key(F.lit("1.0.0"))).alias("g")).first()
    assert tuple(row) == ("affected", "not-affected", "unknown", True, True, True, True)


def test_function_extraction_with_braces_in_strings(spark):
    text = 'export function first(a: string): string {\n  const t = "}";\n  return a; // }\n}\n\nconst second = (b) => {\n  return b;\n}\ntrailing();\n'
    files = spark.createDataFrame([(0, 1, "a.ts", "TypeScript", text)], "project_id int, file_id int, path string, language string, content string")
    rows = code.function_facts(code.extract_functions(files)).orderBy("start_line").collect()
    assert [(r["name"], r["start_line"], r["end_line"], r["return_type"], r["params"]) for r in rows] == [
        ("first", 1, 5, "string", ["a: string"]), ("second", 6, 9, "inferred", ["b"])]
    assert rows[0]["body"].endswith("// }\n}") and rows[0]["confidence"] == 88


@pytest.mark.parametrize("language,text,name", [
    ("Java", "public static int addOne(int a) {\n return a;\n}", "addOne"), ("Rust", "pub fn go(x: i32) -> i32 {\n x\n}", "go"),
    ("Ruby", "def run!(a)\n a\nend", "run!"), ("PHP", "function f($a) {\n return $a;\n}", "f"), ("Kotlin", "fun f(a: Int): Int = a", "f"),
    ("Swift", "func f(a: Int) -> Int {\n return a\n}", "f"), ("C++", "int ns(int a) {\n return a;\n}", "ns"), ("C#", "public int F(int a) {\n return a;\n}", "F")])
def test_signature_languages(spark, language, text, name):
    files = spark.createDataFrame([(0, 1, "x", language, text)], "project_id int, file_id int, path string, language string, content string")
    assert [r["name"] for r in code.extract_functions(files).collect()] == [name]


def test_scan_tree_skips_vendored(spark, tmp_path):
    for p in ("src/a.py", "node_modules/b.js", "Makefile", "notes.bin"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("import os\n")
    got = {r["path"].split("/")[-1] for r in tree.scan_tree(spark, str(tmp_path)).collect()}
    assert got == {"a.py", "Makefile"}


def test_read_cwe_xml(spark, tmp_path):
    (tmp_path / "c.xml").write_text("<Weaknesses><Weakness ID='79' Name='XSS' Abstraction='Base'><D>x</D></Weakness><Weakness ID='89' Name='SQLi' Abstraction='Base'/></Weaknesses>")
    got = feeds.normalize_cwe(feeds.read_cwe(spark, str(tmp_path / "c.xml")))
    assert {(r["external_id"], r["title"]) for r in got.collect()} == {("CWE-79", "XSS"), ("CWE-89", "SQLi")}


def test_boundaries_count_each_match_once(spark):
    fns = spark.createDataFrame([(0, "f", 10, "x = new Function('a')\ny = eval('b'); eval('c')\n")], "project_id int, function_id string, start_line int, body string")
    got = sorted((r["line"], r["expression"]) for r in traces.boundaries(fns).where("kind = 'dynamic-code'").collect())
    assert got == [(10, "new Function('a')"), (11, "eval('b'); eval('c')"), (11, "eval('c')")]


def test_fusion(spark):
    base = spark.createDataFrame([("1", "a.ts", "load", 10, ["x"], "inferred", 70), ("2", "a.ts", "other", 40, [], "void", 60)],
                                 "function_id string, path string, name string, start_line int, params array<string>, return_type string, confidence int")
    facts = spark.createDataFrame([(7, "a.ts", "Box.load", "load", 12, ["x: number"], "number", 95), (8, "a.ts", "extra", "extra", 90, [], "void", 92)],
                                  "fact_id int, path string, name string, short_name string, start_line int, params array<string>, return_type string, confidence int")
    got = {r["function_id"]: (r["origin"], r["return_type"], r["params"]) for r in fusion.fuse_functions(base, facts).collect()}
    assert got["1"] == ("merged", "number", ["x: number"]) and got["2"][0] == "base" and got["compiler:8"][0] == "added"


def test_next_in_order_across_empty_buckets(spark):
    rows = [(1, t, t * 10) for t in (1, 2, 900, 901, 5000)] + [(2, 7, 70)]
    df = spark.createDataFrame(rows, "k int, t int, v int")
    got = {(r["k"], r["t"]): r["next_v"] for r in next_in_order(df, ["k"], ["t"], ["v"], F.floor(F.col("t") / 100)).collect()}
    assert got == {(1, 1): 20, (1, 2): 9000, (1, 900): 9010, (1, 901): 50000, (1, 5000): None, (2, 7): None}


def test_upsert_and_index(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string, ts int")
    sinks.upsert_table(frame([(1, "a", 1), (2, "b", 1)]), path, ["k"], ["ts"], "a")
    sinks.upsert_table(frame([(1, "old", 0), (2, "new", 2), (3, "c", 1)]), path, ["k"], ["ts"], "b")
    now = sinks.read_latest(spark, path, frame([(1, "a", 1)]).schema, ["k"], ["ts"])
    assert {(r["k"], r["v"]) for r in now.collect()} == {(1, "a"), (2, "new"), (3, "c")}
    sinks.write_index({"t": now.withColumn("run_id", F.lit(5))}, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index/t")).where("run_id = 5").count() == 3


def test_analyze_end_to_end(spark):
    files = [(0, 1, "src/main.py", "def handle(request):\n    value = parse(request)\n    eval(value)\n    return value\n\ndef parse(text):\n    return text\n"),
             (0, 2, "requirements.txt", "flask==2.0.1\n")]
    out = analyze(spark.createDataFrame(files, FILES))
    assert {(r["name"]) for r in out["functions"].collect()} == {"handle", "parse"}
    assert out["edges"].count() == 1 and out["dependencies"].count() == 1
    assert "security-command-exec" in {r["rule_id"] for r in out["matches"].collect()}
    assert out["entries"].first()["name"] == "handle" and out["bindings"].count() == 1
    assert out["readiness"].first()["readiness"] > 0
