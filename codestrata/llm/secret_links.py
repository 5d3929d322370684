"""Secret scans: base patterns, and weak parts that count only when their complement stands nearby."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import packed, row_key

# The base patterns and least lengths of the scan's contract, in the order in which kinds are listed.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# Access keys and hex runs are maximal and cannot hold a longer match inside, so their least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
# Own patterns: weak parts, reported only in company.
# Identifier names count in either case and behind any prefix, as names of secrets do.
IDENTIFIER = (
    r"""(?:[Uu][Ss][Ee][Rr](?:[_-]?(?:[Nn][Aa][Mm][Ee]|[Ii][Dd]))?|[Ll][Oo][Gg][Ii][Nn]|(?:[Cc][Ll][Ii][Ee][Nn][Tt]|[Kk][Ee][Yy])[_-]?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt](?:[_-]?[Ii][Dd])?)"""
    r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
)
OPAQUE = r"[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:@-]+|\b\d{1,3}(?:\.\d{1,3}){3}:\d{2,5}\b"
BREAK = r"\n[ \t\r]*\n"

KINDS = ("assign", "access", "hex", "identifier", "opaque", "endpoint", "break")
_PATTERNS = (ASSIGN, ACCESS, HEX, IDENTIFIER, OPAQUE, ENDPOINT, BREAK)
#: Quick tests that a text must pass before its kind is searched; each holds wherever the pattern can succeed.
_QUICK = (r"[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12}", r"AKIA[A-Z0-9]{14}", r"[0-9a-f]{16}", r"[:=]", r"[A-Za-z0-9+/]{32}", r"://|\d:\d", r"\n[ \t\r]*\n")


def _found(text: Column, no: int) -> Column:
    """Matches of one kind as structs of the gap before each and its length; pieces and matches alternate in a split."""
    pattern = _PATTERNS[no]
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if no == 0 else whole
    zipped = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(whole)),
        F.arrays_zip(whole.alias("w"), value.alias("v")),
        lambda gap, hit: F.struct(
            F.lit(no).alias("kind"),
            F.length(gap).alias("gap"),
            F.length(hit["w"]).alias("len"),
            F.length(hit["v"]).alias("vlen"),
            (hit["v"].rlike("[A-Z]") & hit["v"].rlike("[a-z]") & hit["v"].rlike("[0-9]")).alias("mixed") if no == 4 else F.lit(True).alias("mixed"),
        ),
    )
    numbered = F.transform(zipped, lambda x, i: F.struct(x["kind"].alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), x["vlen"].alias("vlen"), x["mixed"].alias("mixed")))
    return F.when(text.rlike(_QUICK[no]), numbered).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,vlen:int,mixed:boolean>>"))


def parts(docs: DataFrame) -> DataFrame:
    """All parts of all texts: doc_id, key, kind (number in KINDS), start, end in code points.

    Places come from running sums over the pieces of each text, one text per window group.  Base matches below their
    least length are dropped after matching, as they still use up their characters.
    """
    text = F.col("text")
    # weak parts matter only beside an access key or an identifier with a secret, so the last four kinds wait for that
    secret = text.rlike(_QUICK[0]) | text.rlike(_QUICK[2]) | text.rlike(_QUICK[4])
    linkable = secret & (text.rlike(_QUICK[1]) | text.rlike(IDENTIFIER))
    empty = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,vlen:int,mixed:boolean>>")
    base = F.concat(*[_found(text, no) for no in range(3)])
    weak = F.when(linkable, F.concat(*[_found(text, no) for no in range(3, 7)])).otherwise(empty)
    rows = (
        docs.select("doc_id", row_key().alias("key"), F.concat(base, weak).alias("found"))
        .select("doc_id", "key", F.explode("found").alias("x"))
        .select("doc_id", "key", "x.*")
        .dropDuplicates(["doc_id", "key", "kind", "i"])
    )
    upto = Window.partitionBy("doc_id", "key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("len")).over(upto)
    least = F.when(F.col("kind") == 0, 12).when(F.col("kind") == 1, 18).when(F.col("kind") == 2, 16).otherwise(1)
    return (
        rows.withColumn("end", end)
        .withColumn("start", F.col("end") - F.col("len"))
        .where((F.col("vlen") >= least) & F.col("mixed"))
        .select("doc_id", "key", "kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    )


def linked_parts(found: DataFrame, reach: int = 200) -> DataFrame:
    """Weak parts whose complement lies within ``reach`` code points in the same block of text.

    An opaque string needs an access key or identifier, an identifier needs a secret, an endpoint needs both.  Parts that
    overlap a base match are that match already.  Intervals meet in an equi-join on (text, block, bin): an anchor
    covers the bins its widened interval touches, a weak part lies in those of its two ends, so a pair meets in few bins
    and a bin holds few parts (each is several characters long).
    """
    by_start = Window.partitionBy("doc_id", "key").orderBy("start", "kind")
    is_base = F.col("kind") <= 2
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    after = by_start.rowsBetween(1, Window.unboundedFollowing)
    placed = (
        found.withColumn("block", F.sum((F.col("kind") == 6).cast("int")).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_prev", F.max(F.when(is_base, F.col("end"))).over(before))
        .withColumn("_next", F.min(F.when(is_base, F.col("start"))).over(after))
        .where("kind <> 6")
        .where(is_base | ((F.coalesce(F.col("_prev"), F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("_next"), F.col("end")) >= F.col("end"))))
        .drop("_prev", "_next")
    )
    is_id, is_secret = F.col("kind").isin(1, 3), F.col("kind").isin(0, 2, 4)
    anchors = placed.where(is_id | is_secret).select(
        "doc_id",
        "key",
        "block",
        F.col("start").alias("a_start"),
        F.col("end").alias("a_end"),
        is_id.alias("a_id"),
        F.explode(F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach) / reach))).alias("bin"),
    )
    weak = placed.where("kind >= 3").select(
        "doc_id", "key", "block", "kind", "start", "end", F.explode(F.array_distinct(F.array(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach)))).alias("bin")
    )
    near = ((F.col("a_start") >= F.col("end")) & (F.col("a_start") - F.col("end") <= reach)) | ((F.col("start") >= F.col("a_end")) & (F.col("start") - F.col("a_end") <= reach))
    w, a = weak.alias("w"), anchors.alias("a")
    met = w.join(a, F.expr("w.doc_id <=> a.doc_id AND w.key = a.key AND w.block = a.block AND w.bin = a.bin") & near)
    needs = F.when(F.col("kind") == 3, F.col("with_secret")).when(F.col("kind") == 4, F.col("with_id")).otherwise(F.col("with_id") & F.col("with_secret"))
    return (
        met.groupBy(F.col("w.doc_id").alias("doc_id"), F.col("w.key").alias("key"), "kind", "start", "end")
        .agg(F.max("a_id").alias("with_id"), F.max(~F.col("a_id")).alias("with_secret"))
        .where(needs)
        .select("doc_id", "key", "kind", "start", "end")
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_spans(docs: DataFrame, reach: int = 200) -> DataFrame:
    """Spans per distinct text that has any: doc_id, key, spans (array of start, kind, end; base and linked weak ones)."""
    found = cut(parts(docs))
    everything = found.where("kind <= 2").unionByName(linked_parts(found, reach))
    return everything.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))


def secret_scan(docs: DataFrame, reach: int = 200) -> DataFrame:
    """One row per document: doc_id, counts of base kinds, digest of the base spans, all spans.

    Null text counts as empty; repeated rows get equal rows; only doc_id and text are read.
    """
    spans = secret_spans(docs, reach)
    rows = docs.select("doc_id", row_key().alias("key")).alias("d")
    joined = rows.join(spans.alias("s"), F.expr("d.doc_id <=> s.doc_id AND d.key = s.key"), "left")
    every = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    base = F.filter(every, lambda s: s["kind"] <= 2)
    count = lambda no: F.size(F.filter(every, lambda s: s["kind"] == no)).cast("long")
    return joined.select(
        F.col("d.doc_id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.size(F.filter(every, lambda s: s["kind"] > 2)).cast("long").alias("n_linked"),
    )


def redact_secrets(docs: DataFrame, reach: int = 200, mark: str = "[secret]") -> DataFrame:
    """The same rows with every reported span replaced by ``mark``; overlapping spans become one.

    Rows without spans keep their text as it is, null texts included; an empty table stays empty. Columns may have any name.
    """
    spans = secret_spans(docs, reach)
    joined = packed(docs).alias("d").join(spans.alias("s"), F.expr("d.row.doc_id <=> s.doc_id AND d.rk = s.key"), "left")
    # a span's piece of text ahead reaches from the furthest end before it; spans inside an earlier one add nothing
    ends = lambda upto: F.aggregate(F.slice(F.col("spans"), 1, upto), F.lit(0), lambda m, s: F.greatest(m, s["end"]))
    text = F.col("d.row.text")
    ahead = F.transform(
        F.col("spans"),
        lambda s, i: F.when(i == 0, F.concat(F.substring(text, F.lit(1), s["start"]), F.lit(mark)))
        .when(s["start"] >= ends(i), F.concat(F.substring(text, ends(i) + 1, s["start"] - ends(i)), F.lit(mark)))
        .otherwise(F.lit("")),
    )
    last = ends(F.size(F.col("spans")))
    new = F.concat(F.array_join(ahead, ""), F.substring(text, last + 1, F.length(text)))
    masked = F.when(F.col("spans").isNull(), text).otherwise(new)
    return joined.select(*[(masked if c == "text" else F.col("d.row").getField(c)).alias(c) for c in docs.columns])
