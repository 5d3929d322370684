"""Package versions: ecosystem names, exactness, semantic-version order, affected windows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .common import matches

# Spellings of package ecosystems.
ECOSYSTEM_ALIASES = {
    "pypi": "PyPI", "python": "PyPI", "npm": "npm", "javascript": "npm", "typescript": "npm", "crates.io": "crates.io",
    "cargo": "crates.io", "rust": "crates.io", "go": "Go", "golang": "Go", "maven": "Maven", "java": "Maven",
}
SEMVER = (
    r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)"
    r"(?:-((?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*)(?:\.(?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*))*))?"
    r"(?:\+([0-9a-zA-Z-]+(?:\.[0-9a-zA-Z-]+)*))?$"
)
EXACT = r"^(?:v)?\d+(?:\.\d+){1,3}(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?$"


def ecosystem(name: Column) -> Column:
    """Canonical ecosystem; unknown names pass through trimmed."""
    trimmed = F.trim(name)
    chain = None
    for alias, canonical in ECOSYSTEM_ALIASES.items():
        cond = F.lower(trimmed) == alias
        chain = F.when(cond, canonical) if chain is None else chain.when(cond, canonical)
    return chain.otherwise(trimmed)


def is_exact(version: Column) -> Column:
    return matches(EXACT, F.trim(version))


def clean_version(version: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.trim(version), "^v", ""), r"[+\s]"), 1)


def sort_key(version: Column) -> Column:
    """Struct that orders like semantic versions; null when the text is no semantic version.

    A release sorts after its pre-releases.  Pre-release identifiers become fixed-form strings: numeric ones get the
    prefix ``0`` and their length so that they order by value and before alphanumeric ones, and a terminator keeps a
    shorter list before a longer one with the same head.
    """
    def part(i: int) -> Column:
        return F.try_to_number(F.regexp_extract(version, SEMVER, i), F.lit("9" * 20)).cast("decimal(20,0)")

    pre = F.regexp_extract(version, SEMVER, 4)

    def ident(p: Column) -> Column:
        numeric = F.concat(F.lit("0"), F.lpad(F.length(p).cast("string"), 4, "0"), p)
        return F.when(matches(r"^\d+$", p), numeric).otherwise(F.concat(F.lit("1"), p))

    key = F.transform(F.split(pre, r"\."), ident)
    return F.when(
        matches(SEMVER, version),
        F.struct(
            part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"),
            (pre == "").alias("release"),
            F.when(pre == "", F.array().cast("array<string>")).otherwise(key).alias("pre"),
        ),
    )


def current_key(version: Column) -> Column:
    """Key of an installed version; leading ``v`` and ``=`` are ignored."""
    return sort_key(F.regexp_replace(F.trim(version), "^[v=]+", ""))


def advisory_key(version: Column) -> Column:
    """Key of a bound in an advisory; ``0`` stands for the first version."""
    return sort_key(F.when(version == "0", F.lit("0.0.0")).otherwise(F.regexp_replace(version, "^v+", "")))


def window_match(version: Column, versions: Column, ranges: Column) -> Column:
    """``affected`` / ``not-affected`` / ``unknown`` against listed versions and windows.

    ``ranges`` is an array of structs with string fields ``introduced``, ``fixed``, ``last_affected``; a missing bound
    is open.
    """
    plain = F.regexp_replace(F.trim(version), "^[v=]+", "")
    cur = current_key(version)

    def keyed(r: Column) -> Column:
        return F.struct(
            advisory_key(r["introduced"]).alias("i"), advisory_key(r["fixed"]).alias("f"),
            advisory_key(r["last_affected"]).alias("l"),
        )

    windows = F.filter(
        F.transform(F.coalesce(ranges, F.array().cast(
            "array<struct<introduced:string,fixed:string,last_affected:string>>")), keyed),
        lambda r: r["i"].isNotNull() | r["f"].isNotNull() | r["l"].isNotNull(),
    )
    inside = F.exists(
        windows,
        lambda r: (r["i"].isNull() | (cur >= r["i"])) & (r["f"].isNull() | (cur < r["f"]))
        & (r["l"].isNull() | (cur <= r["l"])),
    )
    listed = F.exists(
        F.coalesce(versions, F.array().cast("array<string>")), lambda v: F.regexp_replace(v, "^v+", "") == plain)
    return (
        F.when(cur.isNull(), "unknown").when(listed | inside, "affected")
        .when(F.size(windows) > 0, "not-affected").otherwise("unknown")
    )


def cpe_version(cpe: Column) -> Column:
    return F.coalesce(F.get(F.split(cpe, ":"), F.lit(5)), F.lit("*"))


def cpe_match(version: Column, cpe_versions: Column) -> Column:
    """Equality with the versions named by CPEs; the first wildcard before a hit makes it unknown."""
    cur = current_key(version)
    wild = F.array_position(F.transform(cpe_versions, lambda v: v.isin("*", "-")), True)
    hits = F.array_position(F.transform(cpe_versions, lambda v: F.coalesce(advisory_key(v) == cur, F.lit(False))), True)
    parsed = F.exists(cpe_versions, lambda v: advisory_key(v).isNotNull())
    return (
        F.when(cur.isNull() | (F.size(cpe_versions) == 0), "unknown")
        .when((hits > 0) & ((wild == 0) | (hits < wild)), "affected")
        .when(wild > 0, "unknown")
        .when(parsed, "not-affected")
        .otherwise("unknown")
    )


def valid_cve(value: Column) -> Column:
    """B34."""
    return matches(r"^CVE-\d{4}-\d{4,}$", value)


def valid_cwe(value: Column) -> Column:
    return matches(r"^CWE-\d+$", value)
