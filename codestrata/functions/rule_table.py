"""The default rule table and its context conditions.

Fixed values: rule ids, severities, base confidences, signals and tags, and the patterns a function must or must not
show before a rule counts.  Results of rule evaluation depend on them literally.  Pass another list of :class:`Rule`
to the operators to use your own.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    base: float
    signals: tuple[str, ...]
    tags: tuple[str, ...]
    language: str | None = None

    @property
    def category(self) -> str:
        return "language_api" if self.rule_id.startswith("language-api") else self.rule_id.split("-", 1)[0]


@dataclass(frozen=True)
class Context:
    """A rule counts when every ``need`` pattern is found (or an alternative flag holds) and no ``forbid`` is."""

    need: tuple[str, ...] = ()
    forbid: tuple[str, ...] = ()
    need_or_input: str | None = None
    input_only: bool = False
    signals: tuple[str, ...] = field(default=())
    any_of: tuple[tuple[str, str | None], ...] = ()
    extra: str | None = None


def _r(rule_id, severity, base, signals, tags, language=None):
    return Rule(rule_id, severity, base, tuple(signals.split(" | ")), tuple(tags.split()), language)


JS, PY, GO, RS, JAVA, C = "JavaScript/TypeScript", "Python", "Go", "Rust", "Java", "C/C++"
RULES: tuple[Rule, ...] = (
    _r("math-reachability-closure", "warn", 0.78, "outdegree = 0 | return missing | sideeffects empty", "closure graph output"),
    _r("math-capacity-volume", "info", 0.74, "array | list | queue | cache | map | set", "capacity volume water-map"),
    _r("math-data-shape-set-conflict", "warn", 0.68, "same parameter name | multiple type annotations | unknown + typed", "set type conflict"),
    _r("math-confidence-weight", "info", 0.72, "parser fact | ast | runtime | heuristic", "confidence evidence score"),
    _r("algorithm-linear-scan-index", "info", 0.76, ".find( | .filter( | .includes( | for | while", "hash index lookup big-o"),
    _r("algorithm-bfs-entry-tree", "info", 0.82, "entry function | call edge | unreachable function", "bfs entry layout"),
    _r("algorithm-fsm-branch-fit", "info", 0.7, "switch | case | state | status | transition", "fsm state visualization"),
    _r("algorithm-cache-hit-model", "info", 0.73, "cache | memo | readfile | fetch | query | calculate", "cache memoization tradeoff"),
    _r("efficiency-await-in-loop", "warn", 0.78, "for await | for ... await | while ... await | await inside loop", "async loop concurrency"),
    _r("efficiency-repeated-io", "warn", 0.74, "readfile | fetch | query | select | open(", "io batch cache"),
    _r("efficiency-unbounded-growth", "risk", 0.7, ".push( | .append( | .set( | cache[", "memory capacity overflow"),
    _r("efficiency-nested-loop", "warn", 0.66, "for ... for | while ... while | .map(... .filter", "complexity loop big-o"),
    _r("security-unvalidated-input", "risk", 0.82, "request | req. | process.env | argv | input( | open(", "taint validation input"),
    _r("security-sql-injection", "critical", 0.84, "query( | execute( | select | ${ | + req", "sql injection sink"),
    _r("security-command-exec", "critical", 0.86, "exec( | eval( | function( | shell=true | spawn(", "command exec injection"),
    _r("security-path-traversal", "risk", 0.78, "readfile | writefile | open( | ../ | path.join", "path filesystem boundary"),
    _r("security-secret-leak", "risk", 0.72, "secret | token | password | apikey | console.log | throw", "secret leak logging"),
    _r("stability-missing-timeout", "warn", 0.73, "fetch( | axios | readfile | subprocess | serial", "timeout external blocked"),
    _r("stability-retry-no-backoff", "warn", 0.7, "retry | while | for | catch", "retry backoff loop"),
    _r("stability-null-boundary", "warn", 0.68, "find( | get( | optional | null | undefined | none", "null boundary guard"),
    _r("stability-infinite-loop", "risk", 0.76, "while (true) | for (;;) | recursive | calls itself", "loop recursion blocked"),
    _r("language-api-js-fetch", "warn", 0.82, "fetch(", "fetch timeout network", JS),
    _r("language-api-node-readfile", "warn", 0.78, "readfile( | fs.readfile", "node fs path", JS),
    _r("language-api-node-exec", "critical", 0.88, "child_process.exec | exec(", "node exec security", JS),
    _r("language-api-python-subprocess", "critical", 0.86, "subprocess.run | shell=true", "python subprocess security", PY),
    _r("language-api-python-open", "warn", 0.76, "open(", "python file path", PY),
    _r("math-cycle-backflow-score", "warn", 0.72, "cycle | recursive | calls itself | while", "cycle graph reflux"),
    _r("math-fanout-branch-pressure", "info", 0.7, "fanout | downstream | branch | switch | case", "fanout branch layout"),
    _r("math-range-boundary-overflow", "warn", 0.66, "number | int | float | calculate | score | ratio | percent", "numeric boundary overflow"),
    _r("math-sample-path-coverage", "info", 0.68, "if | switch | case | validation | branch", "simulation coverage scenario"),
    _r("algorithm-binary-search-precondition", "warn", 0.7, "binarysearch | bisect | mid | left | right", "search precondition sorted"),
    _r("algorithm-top-k-heap-fit", "info", 0.72, "sort | slice | top | rank | limit", "top-k heap sort"),
    _r("algorithm-streaming-large-data", "warn", 0.7, "readfile | json.parse | map | filter | all | load", "stream pagination memory"),
    _r("algorithm-graph-dijkstra-fit", "info", 0.67, "path | route | weight | distance | cost | graph", "graph path dijkstra"),
    _r("efficiency-unbounded-promise-all", "risk", 0.78, "promise.all | .map( | fetch( | query(", "concurrency promise backpressure"),
    _r("efficiency-n-plus-one-query", "warn", 0.74, "for | map | query( | findmany | select", "database n+1 batch"),
    _r("efficiency-sync-io-hot-path", "warn", 0.76, "readfilesync | writefilesync | execsync | spawnsync", "sync-io blocking hot-path"),
    _r("efficiency-large-json-parse", "warn", 0.7, "json.parse | response.json | json.loads", "json memory payload"),
    _r("security-xss-sink", "critical", 0.84, "innerhtml | dangerouslysetinnerhtml | document.write | v-html", "xss html security"),
    _r("security-ssrf-request", "critical", 0.82, "fetch( | requests.get | http.get | axios | url", "ssrf network url"),
    _r("security-insecure-deserialization", "critical", 0.84, "pickle.load | yaml.load | deserialize | unserialize", "deserialize pickle security"),
    _r("security-missing-auth-mutation", "risk", 0.76, "delete | update | create | insert | save", "auth mutation permission"),
    _r("security-weak-crypto", "risk", 0.74, "md5 | sha1 | createhash | crypto", "crypto hash security"),
    _r("stability-idempotency-missing", "warn", 0.7, "create | insert | charge | send | retry", "idempotency retry mutation"),
    _r("stability-partial-write-transaction", "risk", 0.72, "insert | update | delete | save | transaction", "transaction rollback consistency"),
    _r("stability-resource-cleanup", "warn", 0.7, "open( | connect | lock | subscribe | close | finally", "cleanup resource leak"),
    _r("stability-timezone-clock", "warn", 0.66, "date | datetime | timezone | now | cron | schedule", "time timezone schedule"),
    _r("language-api-js-json-parse", "warn", 0.76, "json.parse", "json validation javascript", JS),
    _r("language-api-dom-innerhtml", "critical", 0.86, "innerhtml | dangerouslysetinnerhtml", "dom xss javascript", JS),
    _r("language-api-python-requests-get", "warn", 0.8, "requests.get", "python network ssrf", PY),
    _r("language-api-python-pickle-load", "critical", 0.88, "pickle.load | pickle.loads", "python deserialize security", PY),
    _r("language-api-go-exec-command", "risk", 0.76, "exec.command", "go exec security", GO),
    _r("language-api-rust-unwrap", "warn", 0.72, ".unwrap(", "rust panic stability", RS),
    _r("security-csrf-mutation", "risk", 0.78, "post | put | patch | delete | cookie | session", "csrf auth web mutation"),
    _r("security-cors-wildcard-credentials", "risk", 0.76, "access-control-allow-origin | cors | credentials | *", "cors web auth security"),
    _r("security-jwt-weak-verify", "critical", 0.82, "jwt | decode | verify | alg | none", "jwt auth crypto security"),
    _r("security-dependency-vulnerability", "warn", 0.7, "package.json | requirements.txt | pom.xml | cargo.toml | go.mod", "dependency cve supply-chain security"),
    _r("security-orm-raw-query", "critical", 0.84, "queryraw | $queryrawunsafe | raw( | text( | createquery", "orm sql injection database"),
    _r("security-framework-template-injection", "risk", 0.76, "render( | template | jinja | ejs | handlebars", "framework template xss injection"),
    _r("stability-lock-contention", "risk", 0.76, "mutex | lock | synchronized | reentrantlock | rwlock", "lock deadlock concurrency cleanup"),
    _r("stability-lost-update-race", "risk", 0.74, "read | update | save | version | compareandset", "concurrency consistency transaction version"),
    _r("stability-message-idempotency", "warn", 0.72, "kafka | sqs | rabbit | mqtt | consumer | subscribe", "message idempotency queue device"),
    _r("stability-device-offline", "warn", 0.74, "sensor | serial | mqtt | gpio | i2c | spi | uart", "device hardware offline timeout"),
    _r("stability-hardware-watchdog-missing", "risk", 0.76, "pwm | relay | motor | actuator | servo | gpio", "hardware watchdog device safety"),
    _r("efficiency-orm-overfetch", "warn", 0.72, "findmany | include | select * | all( | limit", "orm database io pagination"),
    _r("efficiency-index-missing-query", "warn", 0.68, "where | orderby | join | filter | index", "database index query performance"),
    _r("language-api-java-runtime-exec", "critical", 0.86, "runtime.getruntime().exec | processbuilder", "java exec security timeout", JAVA),
    _r("language-api-java-sql-statement", "critical", 0.84, "statement | executequery | executeupdate", "java sql injection database", JAVA),
    _r("language-api-java-objectinputstream", "critical", 0.86, "objectinputstream | readobject", "java deserialize security", JAVA),
    _r("language-api-c-strcpy-gets", "critical", 0.9, "strcpy | strcat | gets( | sprintf", "c cpp memory security", C),
    _r("language-api-c-system", "critical", 0.88, "system(", "c cpp exec security", C),
    _r("language-api-cpp-raw-pointer-lifetime", "risk", 0.72, "new  | delete  | * | malloc | free", "cpp memory stability cleanup", C),
    _r("language-api-prisma-queryraw-unsafe", "critical", 0.86, "$queryrawunsafe | $executerawunsafe", "orm database sql javascript injection", JS),
    _r("language-api-sqlalchemy-text", "risk", 0.78, "sqlalchemy | text( | execute(", "orm database python sql", PY),
    _r("language-api-spring-request-mapping", "warn", 0.74, "@postmapping | @putmapping | @deletemapping | @requestmapping", "java framework csrf auth web", JAVA),
    _r("language-api-express-cors", "warn", 0.76, "cors( | credentials | origin", "javascript framework cors web", JS),
    _r("language-api-arduino-serial-read", "warn", 0.7, "serial.read | serial.available", "c cpp hardware device timeout", C),
)

# Signals that stand for a structural condition instead of a text search.
STRUCTURAL_SIGNALS = (
    "outdegree = 0", "return missing", "sideeffects empty", "same parameter name", "multiple type annotations",
    "unknown + typed", "parser fact", "ast", "runtime", "heuristic", "entry function", "call edge",
    "unreachable function", "for await", "for ... await", "while ... await", "await inside loop", "for ... for",
    "while ... while", ".map(... .filter", "while (true)", "for (;;)", "calls itself", "recursive", "shell=true",
)
# Structural signals that are plain text patterns.
PATTERN_SIGNALS = {
    "for await": r"\bfor\s+await\b",
    "for ... await": r"(?s)\bfor\b.{0,180}\bawait\b",
    "while ... await": r"(?s)\bwhile\b.{0,180}\bawait\b",
    "await inside loop": r"(?s)\b(for|while)\b.{0,180}\bawait\b",
    "for ... for": r"(?s)\bfor\b.{0,220}\bfor\b",
    "while ... while": r"(?s)\bwhile\b.{0,220}\bwhile\b",
    ".map(... .filter": r"(?s)\.map\(.{0,240}\.filter\(",
    "while (true)": r"while\s*\(\s*true\s*\)",
    "for (;;)": r"for\s*\(\s*;\s*;\s*\)",
    "shell=true": r"shell\s*=\s*true",
}
# Shared text conditions.
SQL_SINK = r"query\(|execute\(|select\s+|insert\s+|update\s+|delete\s+from"
INTERPOLATION = r"(?s)\$\{|`.*select|'\s*\+|\"\s*\+|\+\s*req|\+\s*input|\+\s*params"
EXTERNAL_SIGNAL = r"request|req\.|process\.env|argv|input\(|open\(|fetch\(|formdata|searchparams"
MUTATION = r"delete|update|create|insert|save|charge|send|write|post|put|patch"
MUTATION_WORDS = ("delete", "update", "create", "insert", "save", "write", "post", "put", "patch")
# Context conditions by rule.  ``extra`` names a condition that needs more than text.
CONTEXTS: dict[str, Context] = {
    "security-unvalidated-input": Context(need_or_input=EXTERNAL_SIGNAL, extra="no-validations"),
    "security-sql-injection": Context(need=(SQL_SINK,), need_or_input=INTERPOLATION),
    "security-command-exec": Context(need=(r"exec\(|eval\(|function\(|spawn\(|shell\s*=\s*true|subprocess",)),
    "security-path-traversal": Context(
        need=(r"readfile|writefile|open\(|path\.join|pathlib|fs\.",), need_or_input=r"\.\./"),
    "security-secret-leak": Context(
        need=(r"secret|token|password|apikey|api_key|privatekey|private_key",
              r"console\.log|logger|print\(|response|return|throw")),
    "efficiency-unbounded-growth": Context(
        forbid=(r"limit|max|capacity|length\s*[<>=]|size\s*[<>=]|slice\(|splice\(|shift\(|ttl|lru",)),
    "stability-missing-timeout": Context(
        need=(r"fetch\(|axios|readfile|subprocess|serial|request\(|http\.|https\.",),
        forbid=(r"timeout|abortcontroller|abortsignal|signal|settimeout|deadline",)),
    "stability-retry-no-backoff": Context(
        need=(r"retry|while|for|catch",), forbid=(r"backoff|exponential|maxattempt|max_attempt|limit|timeout",)),
    "stability-null-boundary": Context(
        need=(r"find\(|\.get\(|optional|null|undefined|none",),
        forbid=(r"if\s*\(|guard|assert|throw|default|fallback|\?\?",)),
    "stability-infinite-loop": Context(signals=("while (true)", "for (;;)", "recursive", "calls itself")),
    "math-reachability-closure": Context(extra="open-leaf"),
    "algorithm-bfs-entry-tree": Context(extra="graph-root"),
    "algorithm-binary-search-precondition": Context(
        need=(r"binarysearch|bisect|\bmid\b",), forbid=(r"sorted|sort\(|monotonic|ordered",)),
    "algorithm-top-k-heap-fit": Context(need=("sort", "slice|limit|top|rank")),
    "algorithm-streaming-large-data": Context(
        need=(r"readfile|json\.parse|response\.json|load",), forbid=("stream|cursor|chunk|page|pagination",)),
    "efficiency-unbounded-promise-all": Context(
        need=(r"promise\.all", r"\.map\(|fetch\(|query\("), forbid=("p-limit|plimit|concurr|batch|chunk|queue",)),
    "efficiency-n-plus-one-query": Context(need=(r"\b(for|while)\b|\.map\(", r"query\(|findmany|select")),
    "efficiency-large-json-parse": Context(
        need=(r"json\.parse|response\.json|json\.loads",),
        forbid=("limit|maxbytes|max_bytes|try|catch|except|schema",)),
    "security-xss-sink": Context(need=(r"innerhtml|dangerouslysetinnerhtml|document\.write|v-html",)),
    "security-ssrf-request": Context(
        need=(r"fetch\(|requests\.get|http\.get|axios",), need_or_input=r"url|request|req\.|input|params"),
    "security-insecure-deserialization": Context(
        need=(r"pickle\.load|pickle\.loads|yaml\.load|deserialize|unserialize",)),
    "security-missing-auth-mutation": Context(
        need=(MUTATION,), forbid=("auth|permission|authorize|owner|tenant|role|policy",)),
    "security-weak-crypto": Context(
        any_of=(("md5|sha1", None), ("createhash|crypto", "password|token|secret|signature"))),
    "security-csrf-mutation": Context(
        need=(MUTATION, "cookie|session|post|put|patch|delete"), forbid=("csrf|samesite|origin|referer",)),
    "security-cors-wildcard-credentials": Context(
        need=("cors|access-control-allow-origin|credentials", r"\*|origin\s*:\s*true|origin\s*=>|reflect")),
    "security-jwt-weak-verify": Context(need=("jwt|jsonwebtoken|decode|verify",), extra="weak-token-check"),
    "security-dependency-vulnerability": Context(
        need=(r"package\.json|requirements\.txt|pom\.xml|cargo\.toml|go\.mod",)),
    "security-orm-raw-query": Context(
        need=(r"queryrawunsafe|\$queryrawunsafe|\$executerawunsafe|raw\(|text\(|createquery",),
        need_or_input=INTERPOLATION),
    "security-framework-template-injection": Context(
        need=(r"render\(|template|jinja|ejs|handlebars",), need_or_input=r"request|req\.|params|input"),
    "stability-idempotency-missing": Context(
        need=(MUTATION, "retry|send|charge|create|insert"), forbid=("idempot|unique|dedupe|nonce",)),
    "stability-partial-write-transaction": Context(
        forbid=("transaction|rollback|atomic|compensat",), extra="two-mutations"),
    "stability-resource-cleanup": Context(
        need=(r"open\(|connect|lock|subscribe",), forbid=("close|finally|defer|using|unsubscribe|unlock",)),
    "stability-timezone-clock": Context(need=("date|datetime|now|cron|schedule",), forbid=("utc|timezone|tz|iso",)),
    "stability-lock-contention": Context(
        need=("mutex|lock|synchronized|reentrantlock|rwlock",), forbid=("trylock|timeout|finally|defer|unlock",)),
    "stability-lost-update-race": Context(
        need=("read", "update|save|write"), forbid=("transaction|version|compareandset|cas|atomic",)),
    "stability-message-idempotency": Context(
        need=("kafka|sqs|rabbit|mqtt|consumer|subscribe", MUTATION), forbid=("idempot|dedupe|messageid|unique",)),
    "stability-device-offline": Context(
        need=("sensor|serial|mqtt|gpio|i2c|spi|uart",), forbid=("heartbeat|reconnect|offline|timeout|retry",)),
    "stability-hardware-watchdog-missing": Context(
        need=("pwm|relay|motor|actuator|servo|gpio",), forbid=("watchdog|safestop|emergency|timeout|maxduration",)),
    "efficiency-orm-overfetch": Context(
        need=(r"findmany|include|select \*|all\(",), forbid=(r"limit|cursor|take|select\s*:\s*\{|projection",)),
    "efficiency-index-missing-query": Context(need=("where|orderby|join|filter",), forbid=("index|explain|queryplan",)),
}
WEAK_TOKEN_GOOD = "issuer|audience|algorithm|algorithms|expiresin|exp|nbf"
WEAK_TOKEN_BAD = r"alg\s*:\s*[\"']none|decode\("
