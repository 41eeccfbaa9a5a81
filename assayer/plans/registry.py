"""Passes and after-run steps that a policy run takes: declared, checked, and put in the order of what they read."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators.joined import beside

#: Columns of the rollup that a pass may fill.
ROLLUP_COLUMNS = ("currency_status", "feedstock_presence_status", "work_type_status", "priority_status")


@dataclass(frozen=True)
class Context:
    """What a pass is given: evidence tables, the cut-off, the version's parameters, and the rows of the passes that it needs."""

    tables: Mapping[str, DataFrame]
    cutoff: object
    parameters: Mapping
    rows: Mapping[str, DataFrame]
    verdict_columns: Mapping[str, tuple[str, str]] = field(default_factory=dict)

    @property
    def packages(self) -> DataFrame:
        return self.tables["packages"]

    def verdicts(self) -> DataFrame:
        """package_id and the verdict of each pass that this one needs, under the name that it goes by."""
        return beside(self.packages.select("package_id"), *[self.rows[name].select("package_id", F.col(verdict).alias(domain)) for name, (verdict, domain) in self.verdict_columns.items()])


@dataclass(frozen=True)
class Pass:
    """A declared pass: its derived table is named like it.

    verdict: the derived table's verdict column.  derive: what makes its rows.
    reads: evidence tables.  needs: passes whose rows it reads.  column: the column of
    the rollup that it alone fills.  domain: what its verdict is called where later
    passes read it.
    """

    name: str
    verdict: str
    derive: Callable[[Context], DataFrame]
    reads: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()
    column: str | None = None
    domain: str | None = None


class Registry:
    """Passes by name, and steps that follow a run in the order in which they were taken up."""

    def __init__(self, passes: Iterable[Pass] = (), steps: Iterable[tuple[str, Callable]] = (), columns: tuple[str, ...] = ROLLUP_COLUMNS):
        self.columns, self.passes, self.steps = columns, {}, {}
        for p in passes:
            self.register(p)
        for name, step in steps:
            self.after_run(name, step)

    def register(self, p: Pass) -> Pass:
        """Takes up a pass; an error for a name or a column that is taken, or a column that the rollup doesn't have."""
        if not p.name or p.name in self.passes or p.name in ("health", "rollup", "verdicts"):
            raise ValueError(f"no name for a pass, or one that is taken: {p.name!r}")
        if not p.verdict:
            raise ValueError(f"{p.name} has no verdict")
        if p.column is not None and p.column not in self.columns:
            raise ValueError(f"{p.name}: the rollup has no column {p.column}")
        if p.column is not None and (owner := self.owners().get(p.column)):
            raise ValueError(f"{p.column} has two owners: {owner} and {p.name}")
        self.passes[p.name] = p
        return p

    def after_run(self, name: str, step: Callable) -> None:
        """Takes up a step; two under one name are an error, as one of them would stop without notice."""
        if not name or name in self.steps:
            raise ValueError(f"no name for a step, or one that is taken: {name!r}")
        self.steps[name] = step

    def copy(self) -> Registry:
        return Registry(self.passes.values(), self.steps.items(), self.columns)

    def owners(self) -> dict[str, str]:
        """Rollup columns with the one pass that fills each."""
        return {p.column: p.name for p in self.passes.values() if p.column is not None}

    def domains(self) -> dict[str, tuple[str, str]]:
        """Passes that later ones read, with verdict column and the name that it goes by."""
        return {p.name: (p.verdict, p.domain) for p in self.passes.values() if p.domain is not None}

    def ordered(self) -> list[Pass]:
        """Passes after all that they need; else in the order in which they were taken up."""
        done: dict[str, Pass] = {}
        left = dict(self.passes)
        while left:
            ready = [p for p in left.values() if all(n in done for n in p.needs)]
            if not ready:
                odd = sorted({n for p in left.values() for n in p.needs if n not in self.passes})
                raise ValueError(f"passes that nobody declares: {', '.join(odd)}" if odd else f"passes that need each other: {', '.join(sorted(left))}")
            for p in ready:
                done[p.name] = left.pop(p.name)
        return list(done.values())
