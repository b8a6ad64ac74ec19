"""Text queries that SQL can be held against, and what must hold of the others, over the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.llm import oracles, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    ours, theirs = queries.queries()[name](spark, str(DATA)).toPandas(), c.execute(oracles.oracle_sql()[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) > 0
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].values.tolist()))
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name, columns", [
    ("p1_found", ["src", "row_id", "seg_start", "lang"]), ("p2_found", ["run_uid", "noise"]), ("p3_found", ["src", "row_id"]), ("p5_found", ["src", "row_id", "sent_start", "sent_end"]),
    ("p6_found", ["src", "id_a", "id_b"]), ("p7_ids", ["doc_id", "ids"]), ("p9_found", ["doc_id", "pii_kind", "start_char", "end_char"]),
])
def test_columns_and_no_repeats(spark, name, columns):
    df = queries.queries()[name](spark, str(DATA))
    assert df.columns == columns
    n = df.count()
    assert n and n == df.distinct().count()


def test_pairs_lie_in_classes(spark):
    pairs = queries.p6_found(spark, str(DATA)).select("src", F.explode(F.array("id_a", "id_b")).alias("row_id")).distinct()
    classes = queries.p6_classes(spark, str(DATA)).select("src", "row_id").distinct()
    assert pairs.exceptAll(classes).count() == 0 and classes.exceptAll(pairs).count() == 0
