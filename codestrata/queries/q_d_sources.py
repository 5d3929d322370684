"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import code, feeds, manifests, sinks, traces, tree
from .bindings import ORACLE_DEPENDS, ORACLE_RELATIONS
from .facts import function_facts, q, sql_rx
from .registry import query

_HREF_PAGE = "html"


def pages_as_files(b):
    """Pages read as script files: links become imports, some get environment references."""
    body = F.concat(
        F.regexp_replace("html", "<a href=\"([^\"]*)\">", "\nrequire(\"$1\")\n"),
        F.when(F.col("page_id") % 3 == 0, "\nprocess.env.PAGE_KEY os.getenv(\"HOME_DIR\")").otherwise(""),
        F.when(F.col("page_id") % 4 == 0, "\nSerial.read digitalWrite GPIO").otherwise(""))
    path = F.concat(
        F.lit("src/"), F.when(F.col("page_id") % 7 == 0, "node_modules/").otherwise(""), F.lit("page_"),
        F.col("page_id").cast("string"),
        F.when(F.col("page_id") % 5 == 0, ".js").when(F.col("page_id") % 5 == 1, ".xyz")
        .when(F.col("page_id") % 5 == 2, "/package.json").otherwise(".md"))
    return b.pages.select("page_id", path.alias("path"), body.alias("content"))


ORACLE_RELATIONS["page_files"] = """
    SELECT page_id, 'src/' || CASE WHEN page_id % 7 = 0 THEN 'node_modules/' ELSE '' END || 'page_' || CAST(page_id AS VARCHAR)
           || CASE page_id % 5 WHEN 0 THEN '.js' WHEN 1 THEN '.xyz' WHEN 2 THEN '/package.json' ELSE '.md' END AS path,
           html, CASE WHEN page_id % 3 = 0 THEN chr(10) || 'process.env.PAGE_KEY os.getenv("HOME_DIR")' ELSE '' END
           || CASE WHEN page_id % 4 = 0 THEN chr(10) || 'Serial.read digitalWrite GPIO' ELSE '' END AS tail FROM pages"""
ORACLE_DEPENDS["page_files"] = ()


@query("source_scan_filter", """
    SELECT page_id, path, CASE page_id % 5 WHEN 0 THEN 'JavaScript' WHEN 2 THEN 'JSON' ELSE 'Markdown' END AS language
    FROM page_files WHERE page_id % 7 <> 0 AND page_id % 5 <> 1""")
def source_scan_filter(b):
    f = pages_as_files(b).where(tree.is_project_file(F.col("path")))
    return f.select("page_id", "path", tree.detect_language(F.col("path"), F.col("content")).alias("language"))


@query("import_extract", """
    SELECT page_id, CAST(len(l) AS BIGINT) AS n, array_to_string(l[1:5], '|') AS first_imports FROM (
        SELECT page_id, (SELECT list(m ORDER BY i) FROM (SELECT m, min(i) AS i FROM (
            SELECT unnest(x) AS m, generate_subscripts(x, 1) AS i) GROUP BY m)) AS l
        FROM (SELECT page_id, list_concat(list_filter(regexp_extract_all(html, '<a href="([^"]*)">', 1), lambda h: h <> ''),
                CASE WHEN page_id % 5 = 2 THEN regexp_extract_all(html, '"([^"]+)":\\s*"[^"]+"', 1) ELSE [] END) AS x FROM page_files)) WHERE l IS NOT NULL""")
def import_extract(b):
    f = pages_as_files(b)
    out = f.select("page_id", tree.imports(F.col("path"), F.col("content"), limit=None).alias("l")).where("size(l) > 0")
    return out.select("page_id", F.size("l").cast("long").alias("n"), F.array_join(F.slice("l", 1, 5), "|").alias("first_imports"))


def _distinct_sql(lists: str) -> str:
    return f"(SELECT coalesce(string_agg(m, '|' ORDER BY i), '') FROM (SELECT m, min(i) AS i FROM (SELECT unnest(x) AS m, generate_subscripts(x, 1) AS i FROM (SELECT {lists} AS x)) GROUP BY m))"


def _groups_sql(text: str, patterns) -> str:
    return "flatten([" + ", ".join(f"regexp_extract_all({text}, {q(p)}, 1)" for p in patterns) + "])"


_ENVIRONMENT_SQL = f"""list_concat({_groups_sql("path || chr(10) || content", tree.ENVIRONMENT_PATTERNS)}, list_concat(
    CASE WHEN page_id % 5 = 2 THEN ['manifest:package.json'] ELSE [] END, CASE WHEN {sql_rx("content", tree.WELL_KNOWN_VARIABLES)} THEN ['runtime-env'] ELSE [] END))"""


@query("environment_and_device_refs", f"""
    SELECT page_id, {_distinct_sql(_ENVIRONMENT_SQL)} AS env_refs, {_distinct_sql(_groups_sql("content", tree.DEVICE_PATTERNS))} AS device_refs
    FROM (SELECT page_id, path, html || tail AS content FROM page_files)""")
def environment_and_device_refs(b):
    return pages_as_files(b).select(
        "page_id", F.array_join(tree.environment_refs(F.col("path"), F.col("content")), "|").alias("env_refs"),
        F.array_join(tree.device_refs(F.col("content")), "|").alias("device_refs"))


_LANES = " || '-' || ".join(
    f"CAST(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT)::HUGEINT) % 1152921504606846976 AS VARCHAR)" for i in range(4))


@query("project_fingerprint", f"""
    SELECT source, sha256({_LANES}) AS fingerprint FROM (
        SELECT source, sha256(CAST(doc_id AS VARCHAR) || ':' || sha256(text)) AS h FROM documents) GROUP BY source""")
def project_fingerprint(b):
    f = b.documents.select("source", "doc_id", tree.content_hash(F.col("text")).alias("hash"))
    return tree.fingerprint(f, ["source"], ["doc_id", "hash"])


@query("changed_files", """
    SELECT doc_id FROM documents WHERE doc_id % 9 = 0 OR doc_id % 10 = 7""")
def changed_files(b):
    cur = b.documents.select(
        F.lit(1).alias("project_id"), "doc_id", F.col("doc_id").cast("string").alias("path"),
        F.sha2("text", 256).alias("hash"))
    old = cur.where("doc_id % 10 <> 7").withColumn("hash", F.when(F.col("doc_id") % 9 == 0, "old").otherwise(F.col("hash")))
    return tree.changed_files(cur, old).select("doc_id")


def code_files(b):
    """Source files of eight functions each, in slot order."""
    parts = b.fn.groupBy("project_id", "file_id", "path", "language").agg(
        F.array_sort(F.collect_list(F.struct("slot", "body"))).alias("_p"))
    return parts.select(
        "project_id", "file_id", "path", "language",
        F.concat(F.lit("# header\n"), F.array_join(F.transform("_p", lambda p: p["body"]), "\n\n"), F.lit("\n")).alias("content"))


@query("extract_functions", """
    WITH sized AS (SELECT *, CAST(len(body) - len(replace(body, chr(10), '')) AS BIGINT) + 1 AS n_lines FROM fn)
    SELECT file_id, name, CAST(2 + coalesce(sum(n_lines + 1) OVER w, 0) AS BIGINT) AS start_line, params_text, hint,
           CAST(len(body) AS BIGINT) AS body_length, c1 IS NOT NULL AS calls
    FROM sized WINDOW w AS (PARTITION BY file_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def extract_functions(b):
    f = code.extract_functions(code_files(b))
    body = F.regexp_replace("body", r"\n+$", "")
    return f.select(
        "file_id", "name", F.col("start_line").cast("long").alias("start_line"), "params_text",
        F.trim("hint").alias("hint"), F.length(body).cast("long").alias("body_length"),
        F.col("body").contains("first = ").alias("calls"))


@query("signature_spans", """
    WITH sized AS (SELECT *, CAST(len(body) - len(replace(body, chr(10), '')) AS BIGINT) + 1 AS n_lines FROM fn),
         starts AS (SELECT file_id, name, CAST(2 + coalesce(sum(n_lines + 1) OVER w, 0) AS BIGINT) AS start_line
             FROM sized WINDOW w AS (PARTITION BY file_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT file_id, name, start_line, lead(start_line) OVER (PARTITION BY file_id ORDER BY start_line) AS next_line FROM starts""")
def signature_spans(b):
    return code.signature_spans(code.extract_functions(code_files(b))).select(
        "file_id", "name", F.col("start_line").cast("long").alias("start_line"), F.col("next_line").cast("long").alias("next_line"))


def class_files(b):
    """One Python file per customer: a class with annotated and ORM fields and a method."""
    k = F.col("c_custkey")
    base = F.when(k % 4 == 0, "BaseModel").when(k % 4 == 1, "DeclarativeBase").when(k % 4 == 2, "").otherwise("OrderBase")
    suffix = F.when(k % 5 == 0, "Request").when(k % 5 == 1, "Out").when(k % 5 == 2, "Base").otherwise("Item")
    name = F.concat(F.lit("C"), k.cast("string"), suffix)
    content = F.concat(
        F.lit("import x\n\nclass "), name, F.when(base == "", "").otherwise(F.concat(F.lit("("), base, F.lit(")"))), F.lit(":\n"),
        F.lit("    name: str = \"n\"\n    age: int\n"),
        F.when(k % 3 == 0, "    key = mapped_column(Integer, nullable=True)\n").otherwise(""),
        F.lit("    model_config = {}\n\n    def run(self):\n        inner: int = 3\n        return 1\n# note\n\nvalue = 3\n"))
    return b.customer.select(
        (k % 10).alias("project_id"), k.alias("file_id"), F.concat(F.lit("m"), k.cast("string"), F.lit(".py")).alias("path"),
        F.lit("Python").alias("language"), content.alias("content"))


@query("class_declarations", """
    SELECT c_custkey AS file_id, 'C' || CAST(c_custkey AS VARCHAR) || CASE c_custkey % 5 WHEN 0 THEN 'Request' WHEN 1 THEN 'Out'
               WHEN 2 THEN 'Base' ELSE 'Item' END AS name,
           CASE WHEN c_custkey % 4 = 1 OR c_custkey % 3 = 0 THEN 'orm-model' WHEN c_custkey % 4 IN (0, 3) THEN 'data-model' ELSE 'class' END AS kind,
           CASE c_custkey % 5 WHEN 0 THEN 'input-contract' WHEN 1 THEN 'output-contract' WHEN 2 THEN 'shared-fields' ELSE
               CASE WHEN c_custkey % 4 = 1 OR c_custkey % 3 = 0 THEN 'entity' WHEN c_custkey % 4 IN (0, 3) THEN 'transfer' ELSE 'object' END END AS role,
           CAST(CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 2 END AS BIGINT) AS field_count, CAST(1 AS BIGINT) AS method_count,
           CAST(1 AS BIGINT) AS config_count, CAST(3 AS BIGINT) AS start_line,
           CAST(CASE WHEN c_custkey % 3 = 0 THEN 13 ELSE 12 END AS BIGINT) AS end_line FROM customer""")
def class_declarations(b):
    d, _ = code.extract_declarations(class_files(b))
    return d.select("file_id", "name", "kind", "role", *[
        F.col(c).cast("long").alias(c) for c in ("field_count", "method_count", "config_count", "start_line", "end_line")])


@query("class_fields", """
    SELECT c_custkey AS file_id, 'name' AS name, 'str' AS type, false AS required FROM customer
    UNION ALL SELECT c_custkey, 'age', 'int', true FROM customer
    UNION ALL SELECT c_custkey, 'key', 'Integer', false FROM customer WHERE c_custkey % 3 = 0""")
def class_fields(b):
    _, fields = code.extract_declarations(class_files(b))
    return fields.select("file_id", "name", "type", "required")


def route_files(b):
    k = F.col("s_suppkey")
    key = k.cast("string")
    fw = k % 5
    content = (
        F.when(fw == 0, F.concat(F.lit("api = FastAPI()\n@api.get(\"/a"), key, F.lit("\")\n@api.post('/b"), key, F.lit("')\n")))
        .when(fw == 1, F.concat(F.lit("web = Flask(__name__)\n@web.route(\"/f"), key, F.lit("\", methods=[\"POST\"])\n@web.route('/g')\n")))
        .when(fw == 2, F.concat(F.lit("const srv = express()\nsrv.delete(\"/e"), key, F.lit("\", h)\n")))
        .when(fw == 3, F.concat(F.lit("@SpringBootApplication\n@GetMapping(\"/s"), key, F.lit("\")\n@PostMapping(value = \"\")\n")))
        .otherwise(F.concat(F.lit("urlpatterns = [path('d"), key, F.lit("/', v), path('/x', w)]\n"))))
    base = b.supplier.select(k.alias("project_id"), (k * 10).alias("file_id"), fw.alias("fw"), content.alias("content"))
    main = base.select("project_id", "file_id", F.when(F.col("fw") == 4, "app/urls.py").otherwise("app/main.py").alias("path"), "content")
    dj = base.where("fw = 4")
    return main.unionByName(
        dj.select("project_id", (F.col("file_id") + 1).alias("file_id"), F.lit("app/settings.py").alias("path"), F.lit("x=1").alias("content"))
    ).unionByName(
        dj.select("project_id", (F.col("file_id") + 2).alias("file_id"), F.lit("manage.py").alias("path"), F.lit("x=1").alias("content")))


@query("web_routes", """
    SELECT s_suppkey AS project_id, 'fastapi' AS framework, 'GET' AS method, '/a' || CAST(s_suppkey AS VARCHAR) AS route FROM supplier WHERE s_suppkey % 5 = 0
    UNION ALL SELECT s_suppkey, 'fastapi', 'POST', '/b' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 5 = 0
    UNION ALL SELECT s_suppkey, 'flask', 'POST', '/f' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 5 = 1
    UNION ALL SELECT s_suppkey, 'flask', 'GET', '/g' FROM supplier WHERE s_suppkey % 5 = 1
    UNION ALL SELECT s_suppkey, 'express', 'DELETE', '/e' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 5 = 2
    UNION ALL SELECT s_suppkey, 'spring', 'GET', '/s' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 5 = 3
    UNION ALL SELECT s_suppkey, 'spring', 'POST', '/' FROM supplier WHERE s_suppkey % 5 = 3
    UNION ALL SELECT s_suppkey, 'django', 'GET', '/d' || CAST(s_suppkey AS VARCHAR) || '/' FROM supplier WHERE s_suppkey % 5 = 4
    UNION ALL SELECT s_suppkey, 'django', 'GET', '/x' FROM supplier WHERE s_suppkey % 5 = 4""")
def web_routes(b):
    return code.web_routes(route_files(b)).select("project_id", "framework", "method", "route")


def manifest_files(b):
    """One manifest or lock file per order, in the format chosen by the order key."""
    d = b.deps
    fmt = F.col("project_id") % 9
    n, v = F.col("name"), F.concat(F.col("line").cast("string"), F.lit(".2."), F.col("line").cast("string"))
    item = (
        F.when(fmt == 0, F.concat(F.lit("\""), n, F.lit("\": \"^"), v, F.lit("\"")))
        .when(fmt == 1, F.concat(n, F.lit("=="), v))
        .when(fmt == 2, F.concat(F.lit("require "), n, F.lit(" v"), v))
        .when(fmt == 3, F.concat(F.lit("[[package]]\nname = \""), n, F.lit("\"\nversion = \""), v, F.lit("\"\n")))
        .when(fmt == 4, F.concat(F.lit("[[package]]\nname = \""), n, F.lit("\"\nversion = \""), v, F.lit("\"\n")))
        .when(fmt == 5, F.concat(n, F.lit("@^1.0, "), n, F.lit("@~1.1:\n  version \""), v, F.lit("\"\n")))
        .when(fmt == 6, F.concat(F.lit("org.x:"), n, F.lit(":"), v, F.lit("=compile")))
        .when(fmt == 7, F.concat(F.lit("<dependency><groupId>org.x</groupId><artifactId>"), n, F.lit("</artifactId><version>"), v,
                                 F.lit("</version></dependency>")))
        .otherwise(F.concat(n, F.lit(" = { version = \""), v, F.lit("\" }"))))
    grouped = d.withColumn("_fmt", fmt).groupBy("project_id", "_fmt").agg(
        F.array_sort(F.collect_list(F.struct("line", "name", item.alias("item")))).alias("_i"))
    # an order may repeat a line number; identical keys of one JSON object would collapse
    joined = F.array_join(F.transform("_i", lambda i: i["item"]), "\n")
    name = F.element_at(F.array(*map(F.lit, (
        "package.json", "requirements.txt", "go.mod", "poetry.lock", "Cargo.lock", "yarn.lock", "gradle.lockfile", "pom.xml",
        "Cargo.toml"))), (F.col("_fmt") + 1).cast("int"))
    content = (
        F.when(F.col("_fmt") == 0, F.concat(F.lit("{\"dependencies\": {"), F.array_join(F.transform(
            "_i", lambda i: i["item"]), ","), F.lit("}}")))
        .when(F.col("_fmt") == 8, F.concat(F.lit("[package]\nname = \"x\"\n[dependencies]\n"), joined, F.lit("\n[profile.dev]\nopt = \"3\"")))
        .otherwise(joined))
    return grouped.select("project_id", F.col("project_id").alias("file_id"), F.concat(F.lit("a/"), name).alias("path"),
                          content.alias("content"))


ORACLE_RELATIONS["dep_lines"] = """
    SELECT project_id, line, CASE project_id % 9 WHEN 6 THEN 'org.x:' || name WHEN 7 THEN 'org.x:' || name ELSE name END AS name,
           CASE WHEN project_id % 9 = 0 THEN '^' ELSE '' END || CAST(line AS VARCHAR) || '.2.' || CAST(line AS VARCHAR) AS version,
           CASE project_id % 9 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' WHEN 2 THEN 'Go' WHEN 3 THEN 'PyPI' WHEN 4 THEN 'crates.io' WHEN 5 THEN 'npm'
               WHEN 6 THEN 'Maven' WHEN 7 THEN 'Maven' ELSE 'crates.io' END AS ecosystem,
           CASE WHEN project_id % 9 IN (3, 4, 5, 6) THEN 'lockfile' ELSE 'manifest' END AS resolution,
           project_id % 9 <> 0 AS exact
    FROM deps"""
ORACLE_DEPENDS["dep_lines"] = ("deps",)


@query("manifest_dependencies", """
    SELECT project_id, name, version, ecosystem, resolution, exact,
           CAST(CASE WHEN project_id % 9 = 5 THEN count(*) * 2 ELSE count(*) END AS BIGINT) AS n
    FROM dep_lines WHERE project_id % 9 <> 0 GROUP BY project_id, name, version, ecosystem, resolution, exact
    UNION ALL
    SELECT project_id, name, version, ecosystem, resolution, exact, CAST(1 AS BIGINT) FROM dep_lines WHERE project_id % 9 = 0
      AND project_id NOT IN (SELECT project_id FROM dep_lines GROUP BY project_id, name HAVING count(*) > 1)""")
def manifest_dependencies(b):
    d = manifests.dependencies(manifest_files(b))
    out = d.groupBy("project_id", "name", "version", "ecosystem", "resolution", "exact").agg(F.count(F.lit(1)).alias("n"))
    # a JSON object with a repeated key is no valid input of the comparison
    repeated = b.deps.where("project_id % 9 = 0").groupBy("project_id", "name").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    return out.join(repeated.select("project_id").distinct(), "project_id", "left_anti")


@query("deduped_dependencies", """
    SELECT project_id, ecosystem, lower(name) AS key_name, version, exact FROM deps
    QUALIFY row_number() OVER (PARTITION BY project_id, lower(ecosystem), lower(name)
        ORDER BY CASE WHEN exact THEN 0 ELSE 1 END, line, version) = 1""")
def deduped_dependencies(b):
    from ..operators.advisories import dedupe_dependencies

    d = b.deps.select(
        "project_id", "name", "ecosystem", "version", "exact", F.lit("manifest").alias("resolution"),
        F.struct("line", "version").alias("ordinal"))
    return dedupe_dependencies(d).select("project_id", "ecosystem", F.lower("name").alias("key_name"), "version", "exact")


def trace_lines(b):
    e = b.events
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "transfer").when(
        F.col("event_type") == "view", "enter").when(F.col("event_type") == "signup", "exit").otherwise("noise")
    payload = F.to_json(F.struct(
        F.when(F.col("event_id") % 50 == 0, " ").otherwise(F.concat(F.lit("fn_"), (F.col("event_id") % 20).cast("string"))).alias("functionName"),
        kind.alias("event"), F.array(F.lit("v")).alias("dataNames"), F.lit("<ffi>").alias("from"),
        F.when(F.col("event_id") % 4 == 0, "unknown").alias("to")))
    source = F.when((F.col("user_id") % 3 == 0) & (F.col("event_id") % 2 == 0), "sidecar").otherwise("stdout")
    line = F.when(source == "sidecar", payload).when(F.col("event_id") % 13 == 0, payload).otherwise(
        F.concat(F.lit("  TRACE "), payload))
    return e.select(F.col("user_id").alias("run_id"), source.alias("source"), F.col("event_id").alias("seq"), line.alias("line"))


@query("trace_events", """
    WITH valid AS (SELECT user_id AS run_id, event_id AS seq, 'fn_' || CAST(event_id % 20 AS VARCHAR) AS function_name,
             CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'transfer' WHEN 'view' THEN 'enter' WHEN 'signup' THEN 'exit' END AS event,
             CASE WHEN user_id % 3 = 0 AND event_id % 2 = 0 THEN 'sidecar' ELSE 'stdout' END AS source FROM events
           WHERE event_id % 50 <> 0 AND event_type <> 'purchase'
             AND ((user_id % 3 = 0 AND event_id % 2 = 0) OR event_id % 13 <> 0))
    SELECT run_id, seq, function_name, event, source FROM valid
    WHERE source = 'sidecar' OR run_id NOT IN (SELECT run_id FROM valid WHERE source = 'sidecar')""")
def trace_events(b):
    return traces.read_traces(trace_lines(b)).select("run_id", "seq", "function_name", "event", "source")


@query("sanitizer_findings", """
    SELECT doc_id, CAST(len(l) AS BIGINT) AS n, coalesce(array_to_string(l, '|'), '') AS lines FROM (
        SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(string_split(t, chr(10)),
            lambda x: contains(x, 'AddressSanitizer') OR contains(x, 'runtime error:')), lambda x: trim(x)))) AS l
        FROM (SELECT doc_id, text || chr(10) || ' ERROR: AddressSanitizer x' || CAST(doc_id % 5 AS VARCHAR) || chr(10) || 'a.c: runtime error: y'
              || chr(10) || ' ERROR: AddressSanitizer x' || CAST(doc_id % 5 AS VARCHAR) AS t FROM documents))""")
def sanitizer_findings(b):
    tail = F.concat(F.lit("\n ERROR: AddressSanitizer x"), (F.col("doc_id") % 5).cast("string"))
    d = b.documents.select(
        "doc_id", traces.sanitizer_findings(F.concat("text", tail, F.lit("\na.c: runtime error: y"), tail)).alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("n"), F.array_join("l", "|").alias("lines"))


@query("input_leaks", """
    SELECT event_id AS run_id, 'taint-' || substr(sha256('user-' || CAST(user_id AS VARCHAR)), 1, 12) AS label, '<stdout>' AS sink FROM events WHERE event_id % 3 = 0
    UNION ALL SELECT event_id, 'taint-' || substr(sha256(event_type || '-deep'), 1, 12), '<stderr>' FROM events WHERE event_id % 5 = 0""")
def input_leaks(b):
    e = b.events
    stdin = F.to_json(F.struct(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("name"),
        F.array(F.struct(F.concat("event_type", F.lit("-deep")).alias("inner"), F.lit("abc").alias("tiny"))).alias("rows")))
    runs = e.select(
        F.col("event_id").alias("run_id"), stdin.alias("stdin"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("hi user-"), F.col("user_id").cast("string"), F.lit("!")))
        .otherwise("").alias("stdout"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("!!"), "event_type", F.lit("-deep tiny"))).otherwise("rows").alias("stderr"))
    return traces.leaks(runs)


@query("snapshot_diff", """
    SELECT coalesce(a.k, c.k) AS k, CASE WHEN a.k IS NULL THEN 'created' WHEN c.k IS NULL THEN 'deleted' ELSE 'modified' END AS kind,
           a.bytes AS before_bytes, c.bytes AS after_bytes
    FROM (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_custkey AS st FROM orders WHERE o_orderkey % 5 <> 0) a
    FULL OUTER JOIN (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS bytes,
        o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS st FROM orders WHERE o_orderkey % 6 <> 0) c ON a.k = c.k
    WHERE a.k IS NULL OR c.k IS NULL OR a.bytes <> c.bytes OR a.st <> c.st""")
def snapshot_diff(b):
    o = b.orders.select(F.col("o_orderkey").alias("k"), F.floor("o_totalprice").alias("bytes"), F.col("o_custkey").alias("st"))
    old = o.where("k % 5 <> 0")
    new = o.where("k % 6 <> 0").select(
        "k", (F.col("bytes") + F.when(F.col("k") % 7 == 0, 1).otherwise(0)).alias("bytes"),
        (F.col("st") + F.when(F.col("k") % 11 == 0, 1).otherwise(0)).alias("st"))
    return traces.snapshot_diff(old, new, ["k"], "bytes", "st")


def boundary_functions(b):
    return b.fn.select("project_id", "function_id", "name", (F.col("slot") * 10 + 1).alias("start_line"), "body")


ORACLE_RELATIONS["bound_sites"] = """
    SELECT function_id, project_id, CASE WHEN p_size % 10 = 0 THEN 'dynamic-code' ELSE 'native-process' END AS kind, CAST(0 AS BIGINT) AS occurrence,
           slot * 10 + 1 + CASE WHEN c1 IS NOT NULL THEN 2 ELSE 1 END AS line,
           CASE WHEN p_size % 10 = 0 THEN 'eval(first)' ELSE 'subprocess.run(first)' END AS expression
    FROM fn WHERE p_size % 10 IN (0, 1)"""
ORACLE_DEPENDS["bound_sites"] = ("fn",)


@query("dynamic_boundaries", "SELECT function_id, kind, occurrence, CAST(line AS BIGINT) AS line, expression FROM bound_sites")
def dynamic_boundaries(b):
    return traces.boundaries(boundary_functions(b)).drop("project_id")


@query("observed_boundaries", """
    SELECT function_id, kind, CASE WHEN kind = 'dynamic-code' THEN 'runtime-observed'
           WHEN EXISTS (SELECT 1 FROM events WHERE event_type = 'click') THEN 'runtime-observed' ELSE 'static-candidate' END AS status FROM bound_sites
    WHERE kind = 'dynamic-code' UNION ALL SELECT function_id, kind, 'static-candidate' FROM bound_sites WHERE kind <> 'dynamic-code'""")
def observed_boundaries(b):
    ev = b.events.where("event_type = 'click'").select(
        F.col("user_id").alias("run_id"), F.lit("transfer").alias("event"),
        F.when(F.col("event_id") % 2 == 0, "<dynamic-code>").otherwise("<native-process>").alias("from_name"),
        F.when(F.col("event_id") % 2 == 0, F.when(F.col("event_id") % 4 == 0, " EVAL ")).otherwise("popen").alias("to_name"))
    return traces.observe_boundaries(traces.boundaries(boundary_functions(b)), ev).select("function_id", "kind", "status")


@query("framework_tags", """
    SELECT CAST(page_id % 20 AS BIGINT) AS project_id, array_to_string(list_filter([CASE WHEN bool_or(page_id % 6 = 0) THEN 'FastAPI' END,
        CASE WHEN bool_or(page_id % 8 = 0) THEN 'Express' END], lambda x: x IS NOT NULL), '|') AS frameworks FROM pages GROUP BY 1""")
def framework_tags(b):
    f = b.pages.select(
        (F.col("page_id") % 20).cast("long").alias("project_id"), F.lit("p").alias("path"),
        F.concat("html", F.when(F.col("page_id") % 6 == 0, " import FastAPI ").otherwise(""),
                 F.when(F.col("page_id") % 8 == 0, " (express) ").otherwise("")).alias("content"))
    return tree.framework_tags(f).select("project_id", F.array_join("frameworks", "|").alias("frameworks"))


@query("file_roles", """
    WITH n AS (SELECT file_id, string_agg(replace(name, '_', ' '), ' ' ORDER BY name) AS names, min(path) AS path FROM fn GROUP BY file_id)
    SELECT file_id, CASE WHEN regexp_matches(t, 'package json|requirements|cargo toml|pom xml|gradle|config|manifest|dockerfile') THEN 'environment'
        WHEN regexp_matches(t, 'test|spec|fixture|mock|benchmark') THEN 'test' WHEN regexp_matches(t, 'main|index|app|server|controller|bootstrap') THEN 'entry'
        WHEN regexp_matches(t, 'model|entity|schema|database|repository|crud') THEN 'data-model'
        WHEN regexp_matches(t, 'component|page|view|ui|screen') THEN 'interface' WHEN regexp_matches(t, 'parser|compiler|analyzer|flow|graph') THEN 'analysis'
        ELSE 'implementation' END AS role
    FROM (SELECT file_id, regexp_replace(path, '[^A-Za-z0-9]+', ' ', 'g') || ' ' || names AS t FROM n)""")
def file_roles(b):
    fns = b.fn.select("file_id", "name", "path", "language")
    files = fns.groupBy("file_id").agg(F.min("path").alias("path")).withColumn("imports", F.array().cast("array<string>"))
    return tree.file_roles(files, fns).select("file_id", "role")


@query("language_coverage", """
    SELECT lang AS language, CAST(count(*) AS BIGINT) AS file_count, CAST(count(*) FILTER (WHERE doc_id % 4 <> 0) AS BIGINT) AS parsed_file_count,
           CAST(coalesce(sum(doc_id % 4) FILTER (WHERE doc_id % 4 <> 0), 0) AS BIGINT) AS function_count,
           CAST(count(*) FILTER (WHERE doc_id % 10 = 0) AS BIGINT) AS diagnostic_count, 'partial' AS status
    FROM documents GROUP BY lang""")
def language_coverage(b):
    files = b.documents.select(F.col("doc_id").alias("file_id"), F.col("lang").alias("language"))
    fns = files.where("file_id % 4 <> 0").select("file_id", F.explode(F.sequence(F.lit(1), (F.col("file_id") % 4).cast("int"))).alias("i"))
    return tree.language_coverage(files, fns, files.where("file_id % 10 = 0"))


def env_files(b):
    k = F.col("doc_id")
    path = (F.when(k % 11 == 0, "package.json").when(k % 37 == 0, "sub/yarn.lock").when(k % 29 == 0, "tests/a.py")
            .otherwise(F.concat(F.lit("src/f"), k.cast("string"), F.lit(".py"))))
    content = F.concat("text", F.when(k % 23 == 0, " process.env.API_ROOT").otherwise(""))
    return b.documents.select(F.col("source").alias("project_id"), k.alias("file_id"), path.alias("path"), content.alias("content"))


@query("environment_issues", """
    WITH f AS (SELECT source AS project_id, bool_or(doc_id % 11 = 0) AS m, bool_or(doc_id % 11 <> 0 AND doc_id % 37 = 0) AS l,
        bool_or(doc_id % 11 <> 0 AND doc_id % 37 <> 0 AND doc_id % 29 = 0) AS t, bool_or(doc_id % 23 = 0) AS v FROM documents GROUP BY source)
    SELECT project_id, 'missing-lock' AS title, 'Medium' AS severity, 'Likely' AS status, 79 AS confidence FROM f WHERE m AND NOT l
    UNION ALL SELECT project_id, 'missing-tests', 'Medium', 'Possible', 68 FROM f WHERE NOT t
    UNION ALL SELECT project_id, 'environment-variables', 'Low', 'Confirmed', 88 FROM f WHERE v""")
def environment_issues(b):
    return tree.environment_issues(env_files(b))


@query("parse_diagnostics", """
    WITH f AS (SELECT doc_id AS file_id, source AS project_id, CASE WHEN lang = 'en' THEN 'Python' ELSE 'Markdown' END AS language,
            CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS nf, CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS nd,
            CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END AS low FROM documents),
         p AS (SELECT project_id, count(*) FILTER (WHERE language = 'Python' AND nf > 0) AS ex, sum(nf) AS fns,
            count(*) FILTER (WHERE language = 'Python' AND nf = 0 AND nd = 0) AS iso FROM f GROUP BY project_id)
    SELECT project_id, file_id, 'no-functions' AS kind, 'Warning' AS severity FROM f WHERE nf = 0 AND nd = 0 AND language = 'Python'
    UNION ALL SELECT project_id, file_id, 'declarations-only', 'Info' FROM f WHERE nf = 0 AND nd > 0
    UNION ALL SELECT project_id, file_id, 'low-confidence', 'Risk' FROM f WHERE low > 0
    UNION ALL SELECT project_id, NULL, 'no-call-edges', 'Warning' FROM p WHERE ex > 1 AND fns > 1 AND project_id <> 'src1'
    UNION ALL SELECT project_id, NULL, 'isolated-files', 'Info' FROM p WHERE iso > 0""")
def parse_diagnostics(b):
    files = b.documents.select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("project_id"),
        F.when(F.col("lang") == "en", "Python").otherwise("Markdown").alias("language"))
    fns = files.where("file_id % 3 <> 0").withColumn("confidence", F.when(F.col("file_id") % 3 == 1, 60).otherwise(80))
    edges = files.where("project_id = 'src1'").select("project_id")
    return tree.parse_diagnostics(files, fns, files.where("file_id % 6 = 0"), edges)


def osv_payloads(b):
    k = F.col("p_partkey")
    pre = F.when(k % 4 == 0, "GHSA-").when(k % 4 == 1, "RUSTSEC-").when(k % 4 == 2, "UBUNTU-").otherwise("XYZ-")
    eco = F.when(k % 4 == 2, "Ubuntu:22.04").otherwise("npm")
    event = F.array(F.struct(F.lit("1.0.0").alias("introduced")), )
    item = F.struct(
        F.struct(eco.alias("ecosystem"), F.concat(F.lit("pkg-"), k.cast("string")).alias("name")).alias("package"),
        F.array(F.struct(F.lit("SEMVER").alias("type"), F.array(
            F.struct(F.lit("1.0.0").alias("introduced"), F.lit(None).cast("string").alias("fixed")),
            F.struct(F.lit(None).cast("string").alias("introduced"), F.concat((k % 9 + 1).cast("string"), F.lit(".0.0")).alias("fixed")))
            .alias("events"))).alias("ranges"))
    affected = F.when(k % 5 == 0, F.array().cast(
        "array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>>>")
    ).otherwise(F.array_repeat(item, (k % 3 + 1).cast("int")))
    return b.part.select("p_partkey", F.to_json(F.struct(
        F.when(k % 50 == 7, "").otherwise(F.concat(pre, k.cast("string"))).alias("id"), F.col("p_name").alias("summary"),
        affected.alias("affected"))).alias("payload"))


@query("normalize_osv", """
    SELECT 'osv-' || e || '-' || CAST(i AS VARCHAR) AS record_id, e AS external_id, CASE WHEN none THEN '' WHEN k % 4 = 2 THEN 'Ubuntu:22.04' ELSE 'npm' END AS ecosystem,
           CASE WHEN none THEN '' ELSE 'pkg-' || CAST(k AS VARCHAR) END AS package_name, p_name AS title,
           CASE WHEN k % 4 = 0 THEN 'CC-BY-4.0' WHEN k % 4 = 1 THEN 'CC0-1.0' WHEN k % 4 = 2 AND NOT none THEN 'CC-BY-SA-4.0' ELSE 'UNKNOWN' END AS license_id,
           CASE WHEN k % 4 IN (0, 1) OR (k % 4 = 2 AND NOT none) THEN 'accepted' ELSE 'quarantined' END AS status,
           CASE WHEN none THEN '' ELSE '1.0.0<' || CAST(k % 9 + 1 AS VARCHAR) || '.0.0' END AS window_text
    FROM (SELECT k, p_name, none, e, unnest(range(CASE WHEN none THEN 1 ELSE k % 3 + 1 END)) AS i FROM (
        SELECT p_partkey AS k, p_name, p_partkey % 5 = 0 AS none, CASE p_partkey % 4 WHEN 0 THEN 'GHSA-' WHEN 1 THEN 'RUSTSEC-' WHEN 2 THEN 'UBUNTU-' ELSE 'XYZ-' END
            || CAST(p_partkey AS VARCHAR) AS e FROM part WHERE p_partkey % 50 <> 7))""")
def normalize_osv(b):
    r = feeds.normalize_osv(osv_payloads(b))
    w = F.get("ranges", F.lit(0))
    return r.select(
        "record_id", "external_id", "ecosystem", "package_name", "title", "license_id", "status",
        F.coalesce(F.concat(w["introduced"], F.lit("<"), w["fixed"]), F.lit("")).alias("window_text"))


def nvd_payloads(b):
    k = F.col("p_partkey")
    cpe = lambda n: F.concat(F.lit("cpe:2.3:a:v:prod"), (k % 7).cast("string"), F.lit(":"), F.lit(n), F.lit(".0"))
    leaf = lambda n, vul: F.array(F.struct(F.lit(vul).alias("vulnerable"), cpe(n).alias("criteria")))
    conf = F.array(F.struct(F.array(F.struct(
        leaf("3", True).alias("cpeMatch"), F.array(F.struct(leaf("2", True).alias("cpeMatch")), F.struct(leaf("9", False).alias("cpeMatch")))
        .alias("nodes"))).alias("nodes")))
    metric = F.array(F.struct(F.struct(F.lit("HIGH").alias("baseSeverity")).alias("cvssData")))
    old = F.array(F.struct(F.lit("Medium").alias("baseSeverity")))
    return b.part.select(F.to_json(F.struct(F.struct(
        F.concat(F.lit("CVE-2024-"), (k + 10000).cast("string")).alias("id"),
        F.array(F.struct(F.lit("es").alias("lang"), F.lit("hola").alias("value")), F.struct(
            F.when(k % 2 == 0, "en").otherwise("fr").alias("lang"), F.lit("hello").alias("value"))).alias("descriptions"),
        F.array(F.struct(F.array(F.struct(F.lit("CWE-79").alias("value")), F.struct(F.lit("noinfo").alias("value")),
                                 F.struct(F.concat(F.lit("CWE-"), (k % 3 + 20).cast("string")).alias("value"))).alias("description"))).alias("weaknesses"),
        F.when(k % 3 != 0, conf).alias("configurations"),
        F.struct(F.when(k % 4 == 0, metric).alias("cvssMetricV31"), F.when(k % 4 < 2, old).alias("cvssMetricV2")).alias("metrics")
    ).alias("cve"))).alias("payload"))


@query("normalize_nvd", """
    SELECT 'CVE-2024-' || CAST(p_partkey + 10000 AS VARCHAR) AS external_id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'prod' || CAST(p_partkey % 7 AS VARCHAR) END AS package_name,
           CASE WHEN p_partkey % 4 = 0 THEN 'high' WHEN p_partkey % 4 = 1 THEN 'medium' ELSE 'unknown' END AS severity,
           'CWE-' || CAST(p_partkey % 3 + 20 AS VARCHAR) || '|CWE-79' AS cwes,
           CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '2.0|3.0' END AS cpe_versions FROM part""")
def normalize_nvd(b):
    return feeds.normalize_nvd(nvd_payloads(b)).select(
        "external_id", "package_name", "severity", F.array_join("cwe_ids", "|").alias("cwes"),
        F.array_join("cpe_versions", "|").alias("cpe_versions"))


def kev_payloads(b):
    k = F.col("p_partkey")
    return b.part.where("p_size % 6 = 0").select(F.to_json(F.struct(
        F.concat(F.lit("CVE-2024-"), (k + 10000).cast("string")).alias("cveID"), F.lit("Vendor").alias("vendorProject"),
        F.col("p_name").alias("product"), F.col("p_type").alias("vulnerabilityName"))).alias("payload"))


@query("normalize_kev", """
    SELECT 'kev-CVE-2024-' || CAST(p_partkey + 10000 AS VARCHAR) AS record_id, 'Vendor' AS ecosystem, p_name AS package_name, p_type AS title
    FROM part WHERE p_size % 6 = 0""")
def normalize_kev(b):
    return feeds.normalize_kev(kev_payloads(b)).select("record_id", "ecosystem", "package_name", "title")


def cwe_rows(b):
    xml = F.concat(F.lit("<Weakness ID=\""), F.col("p_partkey").cast("string"), F.lit("\" Name=\""), F.col("p_name"),
                   F.lit("\" Abstraction=\"Base\"></Weakness>"))
    return b.part.select(F.from_xml(xml, feeds.CWE_SCHEMA).alias("w")).select("w.*")


@query("normalize_cwe", """
    SELECT 'CWE-' || CAST(p_partkey AS VARCHAR) AS external_id, p_name AS title,
           sha256('{"source":"cwe","externalId":"CWE-' || CAST(p_partkey AS VARCHAR) || '","kind":"weakness","ecosystem":"language-independent","package":"","range":"","license":"MITRE-CWE-TERMS","normalized":"{\\"id\\":\\"CWE-'
               || CAST(p_partkey AS VARCHAR) || '\\",\\"name\\":\\"' || p_name || '\\",\\"abstraction\\":\\"Base\\"}"}') AS record_hash FROM part""")
def normalize_cwe(b):
    return feeds.normalize_cwe(cwe_rows(b)).select("external_id", "title", "record_hash")


def all_records(b):
    cols = ["record_id", "source_id", "external_id", "title", "status", "license_id", "commercial_allowed", "record_hash"]
    parts = [feeds.normalize_osv(osv_payloads(b)), feeds.normalize_nvd(nvd_payloads(b)), feeds.normalize_kev(kev_payloads(b)),
             feeds.normalize_cwe(cwe_rows(b))]
    out = parts[0].select(cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(cols))
    return out.withColumn("pack_id", F.pmod(F.xxhash64("external_id"), F.lit(2)) * 0 + F.length("external_id") % 3)


@query("feed_validation", """
    WITH r AS (
        SELECT 'osv' AS s, e AS x, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE p_partkey % 3 + 1 END AS n, k4 IN (0, 1) OR (k4 = 2 AND p_partkey % 5 <> 0) AS acc FROM (
            SELECT p_partkey, p_partkey % 4 AS k4, CASE p_partkey % 4 WHEN 0 THEN 'GHSA-' WHEN 1 THEN 'RUSTSEC-' WHEN 2 THEN 'UBUNTU-' ELSE 'XYZ-' END || CAST(p_partkey AS VARCHAR) AS e
            FROM part WHERE p_partkey % 50 <> 7)
        UNION ALL SELECT 'nvd', 'CVE-2024-' || CAST(p_partkey + 10000 AS VARCHAR), 1, true FROM part
        UNION ALL SELECT 'kev', 'CVE-2024-' || CAST(p_partkey + 10000 AS VARCHAR), 1, true FROM part WHERE p_size % 6 = 0
        UNION ALL SELECT 'cwe', 'CWE-' || CAST(p_partkey AS VARCHAR), 1, true FROM part),
      a AS (SELECT CAST(length(x) % 3 AS BIGINT) AS pack_id, CAST(sum(n) AS BIGINT) AS record_count, CAST(coalesce(sum(n) FILTER (WHERE acc), 0) AS BIGINT) AS accepted_count,
        CAST(0 AS BIGINT) AS invalid_count, count(*) FILTER (WHERE s = 'osv') > 0 AND count(*) FILTER (WHERE s = 'nvd') > 0 AND count(*) FILTER (WHERE s = 'kev') > 0
          AND count(*) FILTER (WHERE s = 'cwe') > 0 AS present FROM r GROUP BY 1)
    SELECT pack_id, record_count, accepted_count, invalid_count,
           CAST(CASE WHEN present THEN 45 ELSE 0 END + CASE WHEN accepted_count > 0 THEN 25 ELSE 0 END + 20 + CASE WHEN accepted_count >= 20 THEN 10 ELSE 5 END AS BIGINT) AS score FROM a""")
def feed_validation(b):
    return feeds.validate_pack(all_records(b)).select("pack_id", "record_count", "accepted_count", "invalid_count", "score")


@query("pack_hash", f"""
    SELECT o_custkey % 10 AS pack_id, sha256({_LANES}) AS pack_hash FROM (SELECT o_custkey, sha256(sha256(CAST(o_orderkey AS VARCHAR))) AS h FROM orders) GROUP BY 1""")
def pack_hash(b):
    return feeds.pack_hash(b.orders.select(
        (F.col("o_custkey") % 10).alias("pack_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("record_hash")))


@query("pack_state", """
    WITH e AS (SELECT o_custkey AS g, o_orderkey AS pack_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_orderstatus AS st,
                      CASE WHEN o_orderkey % 4 = 0 THEN 80 ELSE 95 END AS score FROM orders)
    SELECT g, pack_id, CASE WHEN st = 'F' OR score < 90 THEN CASE WHEN score >= 90 THEN 'signed' ELSE 'quarantined' END
        WHEN n = max(n) FILTER (WHERE st <> 'F' AND score >= 90) OVER (PARTITION BY g) THEN 'active' ELSE 'superseded' END AS status FROM e""")
def pack_state(b):
    """Every order is a pack of its customer: signed at its date, activated right after unless its status is F."""
    o = b.orders.select(
        F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("pack_id"), F.col("o_orderstatus").alias("st"),
        F.when(F.col("o_orderkey") % 4 == 0, 80).otherwise(95).alias("score"),
        (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) * 1_000_000 + F.col("o_orderkey")).alias("t"))
    signed = o.select("g", "pack_id", F.when(F.col("score") >= 90, "signed").otherwise("quarantined").alias("event"), "score",
                      (F.col("t") * 2).alias("seq"))
    act = o.where("st <> 'F'").select("g", "pack_id", F.lit("activate").alias("event"), F.lit(0).alias("score"), (F.col("t") * 2 + 1).alias("seq"))
    return feeds.pack_state(signed.unionByName(act), ["g"])


@query("bundle_validation", """
    WITH r AS (SELECT l_orderkey AS bundle_id, l_linenumber AS id, count(*) AS n,
               count(*) FILTER (WHERE l_partkey % 9 = 0 OR l_partkey % 10 = 3) AS bad FROM lineitem GROUP BY 1, 2)
    SELECT bundle_id, CAST(sum(n) AS BIGINT) AS record_count, CAST(sum(greatest(bad, n - 1)) AS BIGINT) AS faulty_count, sum(greatest(bad, n - 1)) = 0 AS valid FROM r GROUP BY 1""")
def bundle_validation(b):
    k = F.col("l_partkey")
    kind = F.when(k % 2 == 0, "sdk").otherwise("fault")
    payload = F.when(kind == "sdk", F.lit('{"ecosystem":"npm","package":"p","version":"1"}')).otherwise(
        F.lit('{"language":"go","failureMode":"x","reproduction":"y","extra":1}'))
    payload = F.when(k % 9 == 0, F.lit('{"ecosystem":"npm"}')).otherwise(payload)
    rec = b.lineitem.select(
        F.col("l_orderkey").alias("bundle_id"), F.col("l_linenumber").cast("string").alias("id"), kind.alias("kind"),
        F.lit("t").alias("title"), F.lit("e").alias("evidence"),
        F.when(k % 10 == 3, "2024-13-01").otherwise("2024-05-01T10:00:00Z").alias("observed_at"), payload.alias("payload"))
    return feeds.validate_bundle(rec)


@query("symbol_rows", """
    SELECT function_id, kind, name, pos AS position FROM (
        SELECT function_id, 'parameter' AS kind, unnest(params) AS name, generate_subscripts(params, 1) - 1 AS pos FROM facts
        UNION ALL SELECT function_id, 'output', unnest(outputs), generate_subscripts(outputs, 1) - 1 FROM facts
        UNION ALL SELECT function_id, 'external_input', unnest(external_inputs), generate_subscripts(external_inputs, 1) - 1 FROM facts
        UNION ALL SELECT function_id, 'validation', unnest(validations), generate_subscripts(validations, 1) - 1 FROM facts
        UNION ALL SELECT function_id, 'side_effect', unnest(side_effects), generate_subscripts(side_effects, 1) - 1 FROM facts
        UNION ALL SELECT function_id, 'risk', unnest(risks), generate_subscripts(risks, 1) - 1 FROM facts)""")
def symbol_rows(b):
    return sinks.symbol_rows(function_facts(b)).drop("project_id")


@query("symbol_count", """
    SELECT project_id, CAST(sum(len(params) + len(outputs) + len(external_inputs) + len(validations) + len(side_effects) + len(risks)) AS BIGINT) AS symbol_count
    FROM facts GROUP BY project_id""")
def symbol_count(b):
    return sinks.symbol_count(function_facts(b)).select("project_id", F.col("symbol_count").cast("long").alias("symbol_count"))


@query("retain_prefix", """
    SELECT source, doc_id FROM (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM documents) WHERE s <= 60000""")
def retain_prefix(b):
    d = b.documents.select("source", "doc_id", F.length("text").cast("long").alias("bytes"))
    return sinks.retain_prefix(d, ["source"], ["doc_id"], "bytes", 60000).select("source", "doc_id")


@query("retain_budget", """
    WITH RECURSIVE d AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS i FROM documents WHERE length(text) <= 8000),
      walk AS (SELECT source, CAST(0 AS BIGINT) AS i, CAST(2 AS BIGINT) AS used, CAST(0 AS BIGINT) AS kept, CAST(NULL AS BIGINT) AS doc_id FROM d GROUP BY source
        UNION ALL SELECT d.source, d.i, CASE WHEN ok THEN used + n ELSE used END, CASE WHEN ok THEN kept + 1 ELSE kept END, CASE WHEN ok THEN d.doc_id END
        FROM (SELECT d.*, walk.used, walk.kept, walk.used + d.n <= 30000 AND walk.kept < 20 AS ok FROM walk JOIN d ON d.source = walk.source AND d.i = walk.i + 1) d)
    SELECT source, doc_id FROM walk WHERE doc_id IS NOT NULL""")
def retain_budget(b):
    d = b.documents.select("source", "doc_id", F.length("text").cast("long").alias("bytes"))
    return sinks.retain_budget(d, ["source"], ["doc_id"], "bytes", 20, 30000, 8000).select("source", "doc_id")


@query("merge_journal", """
    SELECT k, v FROM (SELECT o_custkey AS k, o_orderkey AS v, o_orderdate AS t, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS inc FROM orders)
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC, v DESC, inc DESC) = 1""")
def merge_journal(b):
    o = b.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderdate").alias("t"))
    return sinks.merge_latest(o.where("v % 2 = 0"), o.where("v % 2 = 1"), ["k"], ["t", "v"]).select("k", "v")


@query("backup_validation", """
    SELECT lang AS backup_id, CAST(count(DISTINCT source) AS BIGINT) AS projects, CAST(count(*) AS BIGINT) AS files, CAST(sum(length(text)) AS BIGINT) AS bytes,
           count(*) <= 500 AS within_limits, lang <> 'en' AS checksum_ok FROM documents GROUP BY lang""")
def backup_validation(b):
    f = b.documents.select(F.col("lang").alias("backup_id"), F.col("source").alias("project_id"),
                           F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    good = tree.fingerprint(f.withColumn("hash", F.sha2("content", 256)), ["backup_id"], ["project_id", "path", "hash"], "checksum")
    expected = good.withColumn("checksum", F.when(F.col("backup_id") == "en", "bad").otherwise(F.col("checksum")))
    return tree.validate_backup(f, expected, max_files=500)
