"""Every query that has SQL gives what DuckDB gives on the smallest tables."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from folioscope.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    def show(x):
        if isinstance(x, (list, np.ndarray)):
            return str(list(x))
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return "-"
        if isinstance(x, (float, np.floating)):
            return f"{x:.9g}"
        return str(int(x)) if isinstance(x, (np.integer,)) else str(x)

    df = df[sorted(df.columns)]
    return sorted("|".join(show(float(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else v) for v in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    ours = registry.queries()[name](spark, str(DATA)).toPandas()
    theirs = duck.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, str(DATA)).count() > 0
