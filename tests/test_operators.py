"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from lodestar.plans import registry
from lodestar.session import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(str)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got).equals(rows(want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rank_in_reals(spark):
    """A share that ends in half a millionth: the statement's reals fall below it, decimals would not."""
    from lodestar.operators import dialect

    rows = [(1, 1)] + [(2, p) for p in range(2, 200)]
    df = spark.createDataFrame(rows, "l_suppkey long, l_partkey long")
    want = duckdb.connect().execute(SQL["agg_7"].replace("FROM lineitem", f"FROM (SELECT * FROM (VALUES {', '.join(map(str, rows))}) v(l_suppkey, l_partkey)) lineitem")).df()
    got = dialect.run(spark, SF, "agg_7", {"lineitem": df})
    assert {(x["p"], x["rank"]) for x in got.collect()} == {tuple(x) for x in want.itertuples(index=False)} and set(want["rank"]) == {100_000_000, 505_050}
    assert "windowspecdefinition" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_mean_in_order(spark):
    """The sum takes rows in the order asked for, however they are dealt out."""
    import random

    from lodestar.operators import measure

    r = random.Random(1)
    rows = [(k, i, None if i == 4 and k % 5 == 0 else round(r.uniform(900, 499_000), 2)) for k in range(200) for i in range(5)] + [(999, 0, None)]
    want = {}
    for k, _, v in sorted(rows, key=lambda x: (x[0], -x[1])):
        want.setdefault(k, []).extend([v] * (v is not None))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, i long, v double").repartition(7)
    got = {x["k"]: x["m"] for x in df.groupBy("k").agg(measure.mean_in_order("v", ["i"]).alias("m")).collect()}

    def mean(values):
        total = 0.0
        for v in values:
            total += v
        return total / len(values) if values else None

    assert got == {k: mean(v) for k, v in want.items()}


def test_phrases_sifted(spark, duck):
    """Texts that no phrase fits reach no expression; those that one fits, in any case, all do."""
    from lodestar.operators import dialect

    texts = ["As an AI, let me explain. I CANNOT BROWSE. Good question!", "it's important to note; it's worth noting that; when it comes to; the bottom line is; in today's modern", "plain words " * 9, "", "to recap", "to recapture", None]
    tables = {"documents": spark.createDataFrame([(i, t, "en", "src1", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")}
    tables["labels"] = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = dialect.run(spark, SF, "ir_14a", tables)
    assert {x["id"]: (x["strong"], x["weak"]) for x in got.collect()} == {0: (4, 0), 1: (0, 5), 2: (0, 0), 3: (0, 0), 4: (1, 0), 5: (0, 0), 6: (0, 0)}
    assert "ArrowEvalPython" in got._jdf.queryExecution().optimizedPlan().toString()


def test_index_counts_in_tasks(spark):
    """Terms of all fields against a plain count, with an item without text; no row a posting leaves a task."""
    from collections import defaultdict

    from lodestar.operators import dialect

    texts = ["One one\ntwo", "two two 3 É", None, "", "one\n" * 3]
    tables = {"documents": spark.createDataFrame([(i, t, "en", "src1", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")}
    tables["labels"] = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    want = defaultdict(lambda: [0, set(), 0])
    for i, t in enumerate(texts):
        for field, text in (("content", t), ("title", t and t.split("\n")[0]), ("source_name", "src1")):
            for k, w in enumerate((text or "").lower().split()):
                got = want[field, w]
                got[0], got[2] = got[0] + 1, got[2] + k
                got[1].add(i)
    out = dialect.run(spark, SF, "ir_1", tables)
    assert {(x["field"], x["term"]): (x["postings"], x["docs"], x["positions"]) for x in out.collect()} == {k: (n, len(d), p) for k, (n, d, p) in want.items()}
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()
    tables["labels"] = spark.createDataFrame([(0, 1, 0), (0, 0, 0)], "doc_id long, quality int, toxic int")
    assert {x["docs"] for x in dialect.run(spark, SF, "ir_1", tables).where("term = 'two' and field = 'content'").collect()} == {2}
