"""Every registered query against its SQL on DuckDB."""

from __future__ import annotations

import os
import re

import duckdb
import pytest

from assayer import adapters
from assayer.queries import evidence, identity, reading, records, runs, stored, surface, upkeep  # noqa: F401


#: Operators that run Python on executors.
PYTHON = re.compile(r"EvalPython|PythonUDF|InPandas|InArrow|InPandasWithState|PythonMapInArrow|MapPartitions")


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf_dir}/{t}'")
    return c


def shown(value):
    return "" if value is None else f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(adapters.QUERIES))
def test_query_equals_its_sql(name, spark, duck, sf_dir):
    df = adapters.QUERIES[name](spark, sf_dir)
    assert not PYTHON.search(df._jdf.queryExecution().executedPlan().toString())
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name not in adapters.ORACLE_SQL:
        assert got
        return
    answer = duck.execute(adapters.ORACLE_SQL[name])
    named = [x[0] for x in answer.description]
    assert sorted(named) == columns
    assert got == sorted(tuple(shown(row[named.index(c)]) for c in columns) for row in answer.fetchall())


@pytest.mark.parametrize("name", ["currency_pass", "vulnerability_pass", "retention_floor", "presence_fold", "specifier_admits"])
def test_plans_stay_in_the_jvm_and_have_no_cartesian_product(name, spark, sf_dir):
    plan = adapters.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = adapters.QUERIES["asof_latest"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "LessThanOrEqual(ts" in scan and "props" not in scan


def test_the_whole_queue_is_listed(spark, sf_dir):
    unfinished = adapters.Tables(spark, sf_dir).items().where("state NOT IN ('resolved', 'accepted')").count()
    assert adapters.QUERIES["queue_listing_all"](spark, sf_dir).count() == unfinished > 200
