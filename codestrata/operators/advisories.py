"""Dependencies against vulnerability advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import versions
from .windows import first_per


def dedupe_dependencies(deps: DataFrame) -> DataFrame:
    """One row per (project, ecosystem, name).

    Rows come in file order (``ordinal``).  A later row replaces the kept one when it is exact and the kept one is not,
    or when it comes from a lockfile and the kept one from a manifest.  Lockfile rows are always exact, so the survivor
    is the first lockfile row, else the first exact row, else the first row.
    """
    rank = (
        F.when(F.col("resolution") == "lockfile", 0).when(F.col("exact"), 1).otherwise(2)
    )
    keyed = deps.withColumn("_e", F.lower("ecosystem")).withColumn("_n", F.lower("name")).withColumn("_rank", rank)
    return first_per(keyed, ["project_id", "_e", "_n"], ["_rank", "ordinal"]).drop("_e", "_n", "_rank")


def match_advisories(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Equi-join on the lower-case package name, ecosystem and version window as residual tests.

    ``advisories`` needs ``source_id, external_id, package_name, ecosystem, severity`` and the normalised windows
    ``versions array<string>``, ``ranges array<struct<introduced,fixed,last_affected>>``, ``cpe_versions array<string>``.
    Hot packages are left to the adaptive skew join: neither side is grouped before the match.
    """
    left = deps.select(
        "*", F.lower(F.trim("name")).alias("_key"), F.lower(versions.ecosystem(F.col("ecosystem"))).alias("_eco"))
    right = advisories.where((F.col("status") == "accepted") & (F.col("record_kind") == "vulnerability")).select(
        F.lower("package_name").alias("_key"), F.lower("ecosystem").alias("_adv_eco"), "source_id", "external_id",
        "severity", "versions", "ranges", "cpe_versions")
    hit = left.where(F.trim("name") != "").join(right, "_key").where(
        (F.col("source_id") == "nvd") | (F.col("_eco") == F.col("_adv_eco")))
    verdict = (
        F.when(~F.col("exact"), "unknown")
        .when(F.col("source_id") == "osv", versions.window_match(F.col("version"), F.col("versions"), F.col("ranges")))
        .when(F.col("source_id") == "nvd", versions.cpe_match(F.col("version"), F.col("cpe_versions")))
        .otherwise("unknown")
    )
    found = hit.withColumn("_verdict", verdict).where(F.col("_verdict") != "not-affected")
    confirmed = F.col("_verdict") == "affected"
    return found.select(
        *deps.columns, "source_id", "external_id", "severity",
        F.when(confirmed, "confirmed").otherwise("review").alias("match_status"),
        F.when(confirmed, 96).when(F.col("exact"), 68).otherwise(54).cast("long").alias("match_confidence"))


def flag_exploited(matches: DataFrame, kev: DataFrame) -> DataFrame:
    """Whether the advisory is in the known-exploited list (distinct ids, so rows are not multiplied)."""
    ids = kev.select("external_id").distinct().withColumn("_kev", F.lit(True))
    return matches.join(ids, "external_id", "left").withColumn(
        "kev_priority", F.coalesce("_kev", F.lit(False))).drop("_kev")


def match_report(matches: DataFrame, limit: int | None = 500) -> DataFrame:
    """most urgent matches first; ``limit`` is the size of the report."""
    ordered = matches.orderBy(
        F.desc("kev_priority"), F.desc("match_confidence"), "name", "external_id", "project_id", "version")
    return ordered.limit(limit) if limit else ordered
