"""Every registered journal query against its DuckDB equivalent on the smallest tables."""

import duckdb
import pytest

from ledgerloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(repr([dict(zip(columns, r))[c] for c in df.columns]) for r in found.fetchall())
    assert sorted(repr(list(r)) for r in df.collect()) == expected
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", ["graph_levels", "graph_layout", "plan_table", "contra_solutions"])
def test_procedural_queries_give_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
    spark.catalog.clearCache()


def test_report_keeps_every_amount(spark):
    """Settled lines add up to what the cleaned vouchers hold on either side."""
    from pyspark.sql import functions as F

    from ledgerloom.operators import contra

    out = catalog.queries()["contra_mvn"](spark, SF)
    lines = catalog.lines(spark, SF)
    clean = contra.cleaned(lines)
    due = contra.settled(clean, contra.routes(clean), "MvN").agg(F.sum("debit").cast("double"), F.sum("credit").cast("double")).first()
    got = out.agg(F.sum("debit"), F.sum("credit")).first()
    assert got[0] == pytest.approx(due[0]) and got[1] == pytest.approx(due[1])
    spark.catalog.clearCache()


def test_helpers_run_over_whole_tables(spark):
    """Every line, solution and plan goes through its function; scores and choices are computed here too."""
    queries = catalog.queries()
    n = catalog.lines(spark, SF).count()
    assert queries["line_subjects"](spark, SF).count() == n == queries["line_first_level_subjects"](spark, SF).count()

    def score(links):
        keys = [[(l[f"{p}_subject"], l[f"{p}_sign"]) for l in links] for p in "dc"]
        extra = [sum((k.count(x) - 1) * (2 if "应交税费" in x[0] else 1) for x in set(k)) for k in keys]
        d, c = (5, 1) if len(set(keys[0])) >= len(set(keys[1])) else (1, 5)
        return 100 - len(links) - d * extra[0] - c * extra[1]

    solved = queries["contra_solutions"](spark, SF).where("n is not null").count()
    rows = queries["solution_scores"](spark, SF).collect()
    assert len(rows) == solved > 0 and all(r.score == pytest.approx(score(r.links)) for r in rows)
    marked = {}
    for r in queries["plan_table"](spark, SF).where("mark = 'x'").collect():
        marked[r.pattern] = int(r.option.split("-")[1])
    assert {r.pattern: r.choice for r in queries["plan_choices"](spark, SF).collect()} == marked != {}
    spark.catalog.clearCache()
