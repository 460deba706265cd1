"""Every catalogue query against its DuckDB counterpart."""

import datetime
import decimal
import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tracelode.plans import catalogue  # noqa: E402
from tracelode.plans.dialect import TABLES  # noqa: E402


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, decimal.Decimal | float):
        x = round(float(x), 6)
        return int(x) if x == int(x) else x
    if isinstance(x, datetime.datetime | datetime.date):
        return x.isoformat()
    return [plain(y) for y in x] if isinstance(x, list | tuple) else x


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    got = [tuple(plain(x) for x in r) for r in df.collect()]
    ran = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = [tuple(plain(r[i]) for i in order) for r in ran.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stand_ins_claim_no_operator():
    missing = {"G20", "M18"}
    assert not missing & {name.split("_")[0] for name in catalogue.queries()}
