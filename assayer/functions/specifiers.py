"""Whether a version specifier admits a release series, as array expressions.

A bound is eight release numbers and a flag, compared as an array: flag 0 stands
just before the release, 1 just behind it.  So every clause is a half-open
interval, and a specifier admits a series if the series' interval, cut by all
clauses, isn't empty or covered by exclusions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.text import once

SEGMENTS, CLAUSES = 8, 32


def _bound(release: Column, flag: int) -> Column:
    padded = F.concat(release, F.array_repeat(F.lit(0), F.lit(SEGMENTS) - F.size(release)))
    return F.concat(padded, F.array(F.lit(flag)))


def _next(release: Column) -> Column:
    n = F.size(release)
    return F.concat(F.slice(release, F.lit(1), n - 1), F.array(F.element_at(release, n) + 1))


def _parsed(clause: Column) -> Column:
    op = F.regexp_extract(clause, r"^(===|~=|==|!=|<=|>=|<|>)", 1)
    text = F.trim(F.regexp_replace(clause, r"^(===|~=|==|!=|<=|>=|<|>)", ""))
    wild = text.endswith(".*")
    plain = F.regexp_replace(text, r"\.\*$", "")

    def read(c: Column) -> Column:
        good = (c["op"] != "") & c["plain"].rlike(r"^[0-9]{1,9}(\.[0-9]{1,9}){0,7}$") & (~c["wild"] | c["op"].isin("==", "!=")) & ((c["op"] != "~=") | c["plain"].contains("."))
        release = lambda good: F.when(good, F.transform(F.split(c["plain"], r"\."), lambda x: x.cast("int"))).otherwise(F.array(F.lit(0), F.lit(0)))
        return once(good, lambda good: F.struct(c["op"].alias("op"), c["wild"].alias("wild"), release(good).alias("release"), good.alias("good")))

    return once(F.struct(op.alias("op"), wild.alias("wild"), plain.alias("plain")), read)


def _lower(c: Column) -> Column:
    """A clause's first admitted place; the least of all where it has none."""
    return F.when(c["op"].isin("==", "===", "~=", ">="), _bound(c["release"], 0)).when(c["op"] == ">", _bound(c["release"], 1)).otherwise(_bound(F.array(F.lit(0)), 0))


def _upper(c: Column) -> Column:
    most = _bound(F.array(F.lit((1 << 31) - 1)), 0)
    shorter = F.slice(c["release"], F.lit(1), F.greatest(F.size(c["release"]) - 1, F.lit(1)))
    return (
        F.when(c["op"] == "~=", _bound(_next(shorter), 0))
        .when((c["op"] == "==") & c["wild"], _bound(_next(c["release"]), 0))
        .when(c["op"].isin("==", "===", "<="), _bound(c["release"], 1))
        .when(c["op"] == "<", _bound(c["release"], 0))
        .otherwise(most)
    )


def admits(specifier: Column, series: tuple[int, ...] = (3, 14)) -> Column:
    """admitted, excluded, unreadable, or unstated for a blank specifier."""
    clauses = F.transform(F.filter(F.transform(F.split(specifier, ","), lambda x: F.trim(x)), lambda x: x != ""), _parsed)
    return F.when(F.trim(F.coalesce(specifier, F.lit(""))) == "", "unstated").otherwise(once(clauses, lambda read: _admitted(read, series)))


def _admitted(clauses: Column, series: tuple[int, ...]) -> Column:
    own = F.array(*[F.lit(x) for x in series])
    low = F.greatest(F.array_max(F.transform(clauses, _lower)), _bound(own, 0))
    high = F.least(F.array_min(F.transform(clauses, _upper)), _bound(_next(own), 0))
    gaps = F.transform(
        F.filter(clauses, lambda c: c["op"] == "!="),
        lambda c: F.struct(_bound(c["release"], 0).alias("low"), F.when(c["wild"], _bound(_next(c["release"]), 0)).otherwise(_bound(c["release"], 1)).alias("high")),
    )
    reached = F.aggregate(F.array_sort(gaps), low, lambda at, gap: F.when((gap["low"] <= at) & (gap["high"] > at), gap["high"]).otherwise(at))
    return (
        F.when((F.size(clauses) == 0) | (F.size(clauses) > CLAUSES) | F.exists(clauses, lambda c: ~c["good"]), "unreadable")
        .when(reached < high, "admitted")
        .otherwise("excluded")
    )


def declares_versions(classifiers: Column) -> Column:
    """Whether one of a project's classifiers names a Python version."""
    return F.coalesce(F.exists(classifiers, lambda c: c.rlike(r"^Programming Language :: Python :: [0-9]+\.[0-9]+$")), F.lit(False))
