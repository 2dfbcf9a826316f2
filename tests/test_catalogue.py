"""Every registered query of the library against its SQL on the smallest tables."""

import glob

import duckdb
import pytest

from millrace.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {p.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([list(v[i]) if isinstance(v[i], (list, tuple)) else v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_nyt_countbased_of_tied_rows_goes_by_the_rows(spark, tmp_path):
    rows = [(i // 300, 1, float(6 + 7 * i % 45), "R") for i in range(3000)]
    want, totals = sorted((k, n, int(q)) for k, n, q, _ in rows), []
    for name, order, parts in (("up", rows, 1), ("down", rows[::-1], 1), ("many", rows[::2] + rows[1::2], 7)):
        df = spark.createDataFrame(order, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string")
        df.repartition(parts).write.parquet(str(tmp_path / name / "lineitem.parquet"))
        totals.append({r.win_id: r.total for r in QUERIES["nyt_countbased"](spark, str(tmp_path / name)).collect()})
    assert totals == [{w: sum(d for _, _, d in want[1000 * w : 1000 * w + 1000]) for w in range(3)}] * 3
