"""Advisory feeds: normalising, hashing, validating, pack lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import versions
from .tree import fingerprint

SOURCES = ("osv", "nvd", "cwe", "kev")
# Licences by advisory id prefix.
LICENSE_PREFIXES = {
    "CC-BY-4.0": ("GHSA-", "PYSEC-", "GO-", "PSF-"),
    "CC0-1.0": ("RUSTSEC-", "GSD-"),
}
# Payload keys each kind of supplemental record needs.
REQUIRED_KEYS = {
    "sdk": ("ecosystem", "package", "version"),
    "fault": ("language", "failureMode", "reproduction"),
    "benchmark": ("algorithm", "inputScale", "metrics"),
    "hardware": ("component", "datasheet", "safeBounds"),
    "repair": ("ruleId", "beforeHash", "afterHash", "validation"),
}
_EVENTS = "array<struct<introduced:string,fixed:string,last_affected:string>>"
OSV_SCHEMA = (
    "struct<id:string,summary:string,details:string,modified:string,withdrawn:string,aliases:array<string>,"
    "affected:array<struct<package:struct<ecosystem:string,name:string>,versions:array<string>,"
    f"ranges:array<struct<type:string,events:{_EVENTS}>>>>>")
_CPE = "cpeMatch:array<struct<vulnerable:boolean,criteria:string>>"
_NODE = f"struct<{_CPE},nodes:array<struct<{_CPE},nodes:array<struct<{_CPE}>>>>>"
_METRIC = "array<struct<baseSeverity:string,cvssData:struct<baseSeverity:string>>>"
_CVE = (
    "id:string,lastModified:string,vulnStatus:string,descriptions:array<struct<lang:string,value:string>>,"
    "weaknesses:array<struct<description:array<struct<value:string>>>>,"
    f"configurations:array<struct<{_CPE},nodes:array<{_NODE}>>>,"
    f"metrics:struct<cvssMetricV40:{_METRIC},cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>")
NVD_SCHEMA = f"struct<cve:struct<{_CVE}>>"
KEV_SCHEMA = (
    "struct<cveID:string,vendorProject:string,product:string,vulnerabilityName:string,shortDescription:string,"
    "dateAdded:string,dueDate:string,requiredAction:string,knownRansomwareCampaignUse:string>")
CWE_SCHEMA = "_ID string, _Name string, _Abstraction string"
_EMPTY = "array<string>"


def osv_license(external_id: Column, ecosystem: Column) -> Column:
    """Licence of an advisory by its id prefix or, for one distribution, its ecosystem."""
    chain = None
    for name, prefixes in LICENSE_PREFIXES.items():
        cond = F.lit(False)
        for p in prefixes:
            cond = cond | external_id.startswith(p)
        chain = F.when(cond, name) if chain is None else chain.when(cond, name)
    return chain.when(ecosystem.startswith("Ubuntu"), "CC-BY-SA-4.0").otherwise("UNKNOWN")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _finish(df: DataFrame) -> DataFrame:
    """SHA-256 over the identifying fields in fixed order."""
    canonical = F.to_json(F.struct(
        F.col("source_id").alias("source"), F.col("external_id").alias("externalId"), F.col("record_kind").alias("kind"),
        "ecosystem", F.col("package_name").alias("package"), F.col("affected_range").alias("range"),
        F.col("license_id").alias("license"), "normalized"))
    return df.withColumn("record_hash", F.sha2(canonical, 256))


def _fold_events(ranges: Column) -> Column:
    """One window per range: the last value given for each bound."""
    def last(events: Column, bound: str) -> Column:
        given = F.filter(F.transform(events, lambda e: e[bound]), lambda v: v.isNotNull())
        return F.try_element_at(given, F.lit(-1)).alias(bound)

    def one(r: Column) -> Column:
        events = F.coalesce(r["events"], F.array().cast(_EVENTS))
        return F.struct(last(events, "introduced"), last(events, "fixed"), last(events, "last_affected"))

    return F.transform(F.coalesce(ranges, F.array().cast(f"array<struct<type:string,events:{_EVENTS}>>")), one)


def normalize_osv(raw: DataFrame) -> DataFrame:
    """``payload`` JSON texts -> one record per affected package (one empty record when none is named)."""
    a = raw.select(F.from_json("payload", OSV_SCHEMA).alias("a")).where(_text(F.col("a.id")) != "")
    rows = a.select("a", F.posexplode_outer("a.affected").alias("pos", "item"))
    eco = _text(F.col("item.package.ecosystem"))
    lic = osv_license(F.col("a.id"), eco)
    df = rows.select(
        F.concat(F.lit("osv-"), F.col("a.id"), F.lit("-"), F.coalesce("pos", F.lit(0)).cast("string")).alias("record_id"),
        F.lit("osv").alias("source_id"), F.col("a.id").alias("external_id"), F.lit("vulnerability").alias("record_kind"),
        eco.alias("ecosystem"), _text(F.col("item.package.name")).alias("package_name"),
        F.coalesce(F.to_json("item.ranges"), F.lit("")).alias("affected_range"), F.lit("unknown").alias("severity"),
        F.array().cast(_EMPTY).alias("cwe_ids"), _text(F.col("a.summary")).alias("title"),
        _text(F.col("a.modified")).alias("modified_at"), lic.alias("license_id"), (lic != "UNKNOWN").alias("commercial_allowed"),
        F.when(lic == "UNKNOWN", "quarantined").otherwise("accepted").alias("status"),
        F.to_json(F.struct(F.col("a.id").alias("id"), F.col("a.aliases").alias("aliases"), F.col("item").alias("affected"),
                           F.col("a.withdrawn").alias("withdrawn"))).alias("normalized"),
        F.coalesce("item.versions", F.array().cast(_EMPTY)).alias("versions"), _fold_events(F.col("item.ranges")).alias("ranges"),
        F.array().cast(_EMPTY).alias("cpe_versions"))
    return _finish(df)


def _cpes(configurations: Column) -> Column:
    """Vulnerable CPE names through three levels of nested nodes, distinct and sorted."""
    names = lambda x: F.transform(
        F.filter(F.coalesce(x["cpeMatch"], F.array().cast("array<struct<vulnerable:boolean,criteria:string>>")),
                 lambda m: F.coalesce(m["vulnerable"], F.lit(False)) & m["criteria"].isNotNull()), lambda m: m["criteria"])
    empty = F.array().cast(_EMPTY)
    leaf = lambda n: names(n)
    mid = lambda n: F.concat(names(n), F.coalesce(F.flatten(F.transform(n["nodes"], leaf)), empty))
    node = lambda n: F.concat(names(n), F.coalesce(F.flatten(F.transform(n["nodes"], mid)), empty))
    conf = lambda c: F.concat(names(c), F.coalesce(F.flatten(F.transform(c["nodes"], node)), empty))
    return F.array_sort(F.array_distinct(F.coalesce(F.flatten(F.transform(configurations, conf)), empty)))


def normalize_nvd(raw: DataFrame) -> DataFrame:
    """A10: ``payload`` JSON texts (one CVE item each) -> records."""
    c = raw.select(F.from_json("payload", NVD_SCHEMA)["cve"].alias("c")).where(_text(F.col("c.id")) != "")
    english = F.filter("c.descriptions", lambda d: d["lang"] == "en")
    summary = F.coalesce(F.get(english, F.lit(0))["value"], F.get("c.descriptions", F.lit(0))["value"], F.lit(""))
    cwes = F.flatten(F.transform("c.weaknesses", lambda w: F.transform(w["description"], lambda d: d["value"])))
    cwes = F.array_sort(F.array_distinct(F.filter(F.coalesce(cwes, F.array().cast(_EMPTY)), lambda v: v.startswith("CWE-"))))
    severity = F.coalesce(*[
        F.coalesce(F.get(F.col(f"c.metrics.{m}"), F.lit(0))["cvssData"]["baseSeverity"],
                   F.get(F.col(f"c.metrics.{m}"), F.lit(0))["baseSeverity"])
        for m in ("cvssMetricV40", "cvssMetricV31", "cvssMetricV30", "cvssMetricV2")], F.lit("unknown"))
    rows = c.select("c", cwes.alias("cwe_ids"), _cpes(F.col("c.configurations")).alias("cpes"), F.lower(severity).alias("severity"),
                    summary.alias("summary"))
    df = rows.select(
        F.concat(F.lit("nvd-"), "c.id").alias("record_id"), F.lit("nvd").alias("source_id"),
        F.col("c.id").alias("external_id"), F.lit("vulnerability").alias("record_kind"), F.lit("CPE").alias("ecosystem"),
        F.coalesce(F.get(F.split(F.get("cpes", F.lit(0)), ":"), F.lit(4)), F.lit("")).alias("package_name"),
        F.array_join("cpes", " | ").alias("affected_range"), "severity", "cwe_ids", F.col("c.id").alias("title"),
        _text(F.col("c.lastModified")).alias("modified_at"), F.lit("NIST-PUBLIC-DOMAIN").alias("license_id"),
        F.lit(True).alias("commercial_allowed"), F.lit("accepted").alias("status"),
        F.to_json(F.struct(F.col("c.id").alias("id"), F.col("cwe_ids").alias("cweIds"), "cpes",
                           F.col("c.vulnStatus").alias("status"))).alias("normalized"),
        F.array().cast(_EMPTY).alias("versions"),
        F.array().cast("array<struct<introduced:string,fixed:string,last_affected:string>>").alias("ranges"),
        F.transform("cpes", versions.cpe_version).alias("cpe_versions"))
    return _finish(df)


def normalize_kev(raw: DataFrame) -> DataFrame:
    """Known-exploited entries -> priority records."""
    k = raw.select(F.from_json("payload", KEV_SCHEMA).alias("k")).where(_text(F.col("k.cveID")) != "")
    df = k.select(
        F.concat(F.lit("kev-"), "k.cveID").alias("record_id"), F.lit("kev").alias("source_id"),
        F.col("k.cveID").alias("external_id"), F.lit("exploitation-priority").alias("record_kind"),
        _text(F.col("k.vendorProject")).alias("ecosystem"), _text(F.col("k.product")).alias("package_name"),
        F.lit("").alias("affected_range"), F.lit("high-priority").alias("severity"), F.array().cast(_EMPTY).alias("cwe_ids"),
        _text(F.col("k.vulnerabilityName")).alias("title"), _text(F.col("k.dateAdded")).alias("modified_at"),
        F.lit("CISA-USE-NOTICE").alias("license_id"), F.lit(True).alias("commercial_allowed"),
        F.lit("accepted").alias("status"), F.to_json("k").alias("normalized"), F.array().cast(_EMPTY).alias("versions"),
        F.array().cast("array<struct<introduced:string,fixed:string,last_affected:string>>").alias("ranges"),
        F.array().cast(_EMPTY).alias("cpe_versions"))
    return _finish(df)


def read_cwe(spark, path: str) -> DataFrame:
    """``Weakness`` elements of (unzipped) XML files."""
    return spark.read.format("xml").option("rowTag", "Weakness").schema(CWE_SCHEMA).load(path)


def normalize_cwe(weaknesses: DataFrame) -> DataFrame:
    """Weaknesses (``_ID, _Name, _Abstraction``) -> taxonomy records."""
    w = weaknesses.where(_text(F.col("_ID")) != "")
    ext = F.concat(F.lit("CWE-"), F.col("_ID"))
    df = w.select(
        F.concat(F.lit("cwe-"), "_ID").alias("record_id"), F.lit("cwe").alias("source_id"), ext.alias("external_id"),
        F.lit("weakness").alias("record_kind"), F.lit("language-independent").alias("ecosystem"), F.lit("").alias("package_name"),
        F.lit("").alias("affected_range"), F.lit("taxonomy").alias("severity"), F.array(ext).alias("cwe_ids"),
        _text(F.col("_Name")).alias("title"), F.lit("").alias("modified_at"), F.lit("MITRE-CWE-TERMS").alias("license_id"),
        F.lit(True).alias("commercial_allowed"), F.lit("accepted").alias("status"),
        F.to_json(F.struct(ext.alias("id"), F.col("_Name").alias("name"), F.col("_Abstraction").alias("abstraction"))
                  ).alias("normalized"), F.array().cast(_EMPTY).alias("versions"),
        F.array().cast("array<struct<introduced:string,fixed:string,last_affected:string>>").alias("ranges"),
        F.array().cast(_EMPTY).alias("cpe_versions"))
    return _finish(df)


def validate_pack(records: DataFrame, keys: tuple[str, ...] = ("pack_id",)) -> DataFrame:
    """Counts, licence and replay checks, and the activation score of each pack.

    Duplicates are found on pre-aggregated record ids; every other figure is a partial aggregate.
    """
    keys = list(keys)
    id_ok = (
        F.when(F.col("source_id") == "cwe", versions.valid_cwe(F.col("external_id")))
        .when(F.col("source_id").isin("nvd", "kev"), versions.valid_cve(F.col("external_id")))
        .when(F.col("source_id") == "osv", F.trim("external_id") != "").otherwise(F.lit(False)))
    bad = ~id_ok | (F.trim("title") == "") | (F.length("record_hash") != 64)
    accepted = F.col("status") == "accepted"
    per_id = records.groupBy(*keys, "record_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(bad).alias("_bad"), F.count_if(accepted).alias("_acc"),
        F.bool_and(~accepted | (F.col("commercial_allowed") & (F.col("license_id") != "UNKNOWN"))).alias("_lic"),
        *[F.count_if(F.col("source_id") == s).alias(f"_{s}") for s in SOURCES])
    # of rows that share an id the first is no duplicate, but counts as invalid when it is malformed itself
    invalid = F.greatest(F.col("_bad"), F.col("_n") - 1)
    totals = per_id.groupBy(*keys).agg(
        F.sum("_n").alias("record_count"), F.sum("_acc").alias("accepted_count"),
        F.sum(F.col("_n") - F.col("_acc")).alias("quarantined_count"), F.sum(invalid).alias("invalid_count"),
        F.bool_and("_lic").alias("license_pass"), *[F.sum(f"_{s}").alias(f"{s}_count") for s in SOURCES])
    present = F.lit(True)
    for s in SOURCES:
        present = present & (F.col(f"{s}_count") > 0)
    schema_pass = (F.col("accepted_count") > 0) & (F.col("invalid_count") == 0)
    replay = (F.col("invalid_count") == 0) & present
    score = (
        F.when(present, 25).otherwise(0) + F.when(schema_pass, 25).otherwise(0) + F.when(F.col("license_pass"), 20).otherwise(0)
        + F.when(replay, 20).otherwise(0) + F.when(F.col("accepted_count") >= 20, 10).otherwise(5))
    out = totals.withColumn("score", score.cast("long"))
    return out.withColumn("pack_status", F.when(F.col("score") >= 90, "signed").otherwise("quarantined"))


def pack_hash(records: DataFrame) -> DataFrame:
    """Content hash of each pack over its record hashes."""
    return fingerprint(records, ["pack_id"], ["record_hash"], "pack_hash")


def pack_state(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """S05, batch form: state of every pack after a log of events.

    ``events``: ``pack_id, event`` (``signed``, ``quarantined``, ``activate``, ``rollback``), ``score, seq`` and the
    grouping columns ``keys``.  An activation needs a pack that has been signed (before or at that point) with a score
    of 90 or more; it supersedes the active pack.  Only the passing activations matter, so they are filtered before
    the last one per group is found by aggregation.
    """
    keys = keys or []
    lifecycle = events.groupBy(*keys, "pack_id").agg(
        F.min(F.when(F.col("event") == "signed", F.col("seq"))).alias("_signed"),
        F.max_by(F.col("event"), F.when(F.col("event").isin("signed", "quarantined"), F.col("seq"))).alias("_initial"),
        F.max(F.when(F.col("event").isin("signed", "quarantined"), F.col("score"))).alias("_score"))
    moves = events.where(F.col("event").isin("activate", "rollback")).select(*keys, "pack_id", "event", "seq")
    valid = moves.join(lifecycle, [*keys, "pack_id"]).where(
        (F.col("_signed").isNotNull()) & (F.col("seq") > F.col("_signed")) & (F.col("_score") >= 90))
    last_of_pack = valid.groupBy(*keys, "pack_id").agg(
        F.max("seq").alias("_seq"), F.max_by("event", "seq").alias("_event"))
    if keys:
        latest = last_of_pack.groupBy(*keys).agg(F.max("_seq").alias("_latest"))
        marked = last_of_pack.join(latest, keys)
    else:
        marked = last_of_pack.withColumn("_latest", last_of_pack.agg(F.max("_seq")).scalar())
    state = lifecycle.join(marked.select(*keys, "pack_id", "_seq", "_latest", "_event"), [*keys, "pack_id"], "left")
    status = (
        F.when(F.col("_seq").isNull(), F.when(F.col("_initial") == "signed", "signed").otherwise("quarantined"))
        .when(F.col("_seq") == F.col("_latest"), "active")
        .otherwise("superseded"))
    return state.select(*keys, "pack_id", status.alias("status"))


def validate_bundle(records: DataFrame, max_records: int = 5_000) -> DataFrame:
    """Problems of supplemental records; ``bundle_id, id, kind, title, evidence, observed_at, payload`` (JSON).

    Yields one row per bundle with the number of records and of faulty records.
    """
    keys = F.json_object_keys("payload")
    required = None
    for kind, names in REQUIRED_KEYS.items():
        need = F.array(*map(F.lit, names))
        required = F.when(F.col("kind") == kind, need) if required is None else required.when(F.col("kind") == kind, need)
    missing = F.size(F.array_except(required, F.coalesce(keys, F.array().cast(_EMPTY))))
    time_ok = F.col("observed_at").rlike(
        r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$") & F.try_to_timestamp(
        "observed_at").isNotNull()
    blank = (F.trim("id") == "") | (F.trim("title") == "") | (F.trim("evidence") == "") | keys.isNull()
    bad = blank | ~F.coalesce(time_ok, F.lit(False)) | required.isNull() | (missing > 0)
    per_id = records.groupBy("bundle_id", "id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(bad).alias("_bad"))
    out = per_id.groupBy("bundle_id").agg(
        F.sum("_n").alias("record_count"), F.sum(F.greatest("_bad", F.col("_n") - 1)).alias("faulty_count"))
    return out.withColumn(
        "valid", (F.col("faulty_count") == 0) & F.col("record_count").between(1, max_records))
