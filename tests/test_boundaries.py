"""Observed boundaries against a plain search, and recursion tags."""

import random

from pyspark.sql import functions as F

from codestrata.plans import reports as P
from codestrata.sources import traces


def test_observed_boundaries_equal_a_plain_search(spark):
    rng = random.Random(11)
    word = lambda low, high: "".join(rng.choices("abA( ", k=rng.randint(low, high)))
    found = [(i, rng.choice(("ffi", "eval", "load", "none")), None if i % 40 == 0 else word(0, 30)) for i in range(300)]
    found += [(i, "ffi", "dlopen(hot)") for i in range(300, 500)]
    events = [(i, "transfer", f"<{rng.choice(('ffi', 'eval', 'other'))}>", word(3, 9)) for i in range(150)]
    events += [(200, "transfer", "<load>", " Unknown "), (201, "enter", "<none>", None), (202, "transfer", "none", "a"), (203, "transfer", "<ffi>", " HOT ")]
    seen = {(f[1:-1], (t or "").strip(" ").lower()) for _, e, f, t in events if e == "transfer" and f.startswith("<")}
    want = {i: any(k == kind and (t in ("", "unknown") or t in (x or "").lower()) for k, t in seen) for i, kind, x in found}
    out = traces.observe_boundaries(
        spark.createDataFrame(found, "function_id int, kind string, expression string"),
        spark.createDataFrame(events, "run_id int, event string, from_name string, to_name string")).collect()
    assert len(out) == 500 and {r["function_id"]: r["status"] == "runtime-observed" for r in out} == want
    assert 200 < sum(want.values()) < 500


def test_boundaries_without_events_stay_candidates(spark):
    found = spark.createDataFrame([(1, "ffi", "x"), (1, "ffi", "x")], "function_id int, kind string, expression string")
    none = spark.createDataFrame([], "run_id int, event string, from_name string, to_name string")
    assert [r["status"] for r in traces.observe_boundaries(found, none).collect()] == ["static-candidate"] * 2


def test_recursion_needs_a_call_outside_the_header(spark):
    rows = [("f", "def f(x):\n  return f(x - 1)", True), ("f", "def f(x):\n  return g(x)", False), ("f", "function f(x) { return xf(x) }", False),
            ("a.b", "fn go() { a.b(1) }", True), ("a.b", "fn go() { axb(1) }", False), ("", "x()", False)]
    df = spark.createDataFrame(rows, "name string, body string, want boolean")
    assert df.where(P.is_recursive(F.col("name"), F.col("body")) != F.col("want")).count() == 0
