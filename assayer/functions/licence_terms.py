"""Licence expressions in their standard spelling, and the rules that judge them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Recognised licences, each with the spellings that mean it.
RECOGNISED = (
    ("MIT", ("mit license", "the mit license", "mit-license", "expat")),
    ("Apache-2.0", ("apache 2.0", "apache-2", "apache license 2.0", "apache license, version 2.0")),
    ("BSD-2-Clause", ("bsd-2", "bsd 2-clause", "simplified bsd")),
    ("BSD-3-Clause", ("bsd-3", "bsd 3-clause", "new bsd", "modified bsd")),
    ("GPL-2.0-only", ()),
    ("GPL-2.0-or-later", ()),
    ("GPL-3.0-only", ()),
    ("GPL-3.0-or-later", ()),
    ("LGPL-2.1-only", ()),
    ("LGPL-2.1-or-later", ()),
    ("LGPL-3.0-only", ()),
    ("LGPL-3.0-or-later", ()),
    ("AGPL-3.0-only", ()),
    ("AGPL-3.0-or-later", ()),
    ("MPL-2.0", ("mpl 2.0", "mozilla public license 2.0")),
    ("EPL-2.0", ("eclipse public license 2.0",)),
    ("BSL-1.0", ("boost software license 1.0", "boost-1.0")),
    ("PSF-2.0", ()),
    ("Python-2.0", ()),
    ("ISC", ("isc license",)),
    ("Zlib", ("zlib license",)),
    ("Unlicense", ("the unlicense",)),
    ("CC0-1.0", ("cc0", "cc0 1.0")),
)


def _spellings() -> Column:
    pairs = {s: name for name, others in RECOGNISED for s in (name.lower(), *others)}
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def normalised(raw: Column) -> Column:
    """A struct of the normal expression and how it was read; both null if it isn't recognised.

    A text is a recognised spelling as a whole, or operands of one token each with
    one kind of operator between them.
    """
    known = _spellings()
    stated = F.trim(F.regexp_replace(raw, r"\s+", " "))
    tokens = F.split(stated, " ")
    operator = F.get(tokens, F.lit(1))
    named = F.transform(F.filter(tokens, lambda x, i: i % 2 == 0), lambda p: known[F.lower(p)])
    whole = known[F.lower(stated)]
    one_kind = operator.isin("AND", "OR") & F.forall(F.filter(tokens, lambda x, i: i % 2 == 1), lambda x: x == operator)
    compound = (F.size(tokens) % 2 == 1) & (F.size(tokens) > 1) & one_kind & F.forall(named, lambda x: x.isNotNull()) & ~stated.rlike("[()]")
    joined = F.when(operator == "AND", F.array_join(named, " AND ")).otherwise(F.array_join(named, " OR "))
    method = F.when(whole == stated, "spdx-identifier").when(whole.isNotNull(), "recognised-spelling").when(compound, "spdx-expression")
    return F.struct(F.coalesce(whole, F.when(compound, joined)).alias("expression"), method.alias("method"))


def conjoined(expression: Column) -> Column:
    """The operands that all hold at once: those of a compound joined by AND only, in any case, with single spaces."""
    tokens = F.split(expression, " ")
    joined = F.forall(F.filter(tokens, lambda x, i: i % 2 == 1), lambda x: F.lower(x) == "and")
    return F.when((F.size(tokens) > 2) & (F.size(tokens) % 2 == 1) & joined, F.filter(tokens, lambda x, i: i % 2 == 0)).otherwise(F.array().cast("array<string>"))


def disposition(expression: Column, rules: list[tuple[str, str]]) -> Column:
    """A struct of disposition and rule for a normal expression: its own rule, else the most restrictive of an operand; null where none speaks."""
    if not rules:
        return F.struct(F.lit(None).cast("string").alias("disposition"), F.lit(None).cast("string").alias("rule"))
    table = F.create_map(*[x for e, d in rules for x in (F.lit(e.lower()), F.struct(F.lit(d).alias("disposition"), F.lit(e).alias("rule")))])
    own = table[F.lower(expression)]
    said = F.transform(conjoined(expression), lambda p: table[F.lower(p)])
    first = lambda d: F.get(F.filter(said, lambda x: x["disposition"] == d), F.lit(0))
    return F.coalesce(own, first("forbidden"), first("restricted"))
