"""Every query of the engine gives the rows of its SQL."""

import duckdb
import pytest

from turnlake import catalogue, catalogue_ingest  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_rows_are_those_of_the_sql(spark, data, duck, name):
    want, got = duck.sql(catalogue.ORACLE[name]).df(), catalogue.QUERIES[name](spark, data).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy()))
    assert rows(want) == rows(got)


def spans_of(spark, texts, needle, word_only=False):
    from pyspark.sql import functions as F
    from turnlake.functions import text as X

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = rows.select("i", F.explode(X.spans(F.col("text"), X.fold(F.col("text")), needle, word_only)).alias("s"))
    out = {}
    for r in found.collect():
        out.setdefault(r["i"], []).append(tuple(r["s"]))
    return [sorted(out.get(i, [])) for i in range(len(texts))]


def test_spans_and_kinds_of_hits(spark):
    want = {"rateLimiter": [(4, 7, "word")], "limiter": [(0, 7, "word")], "HTTPLimiter x": [(4, 7, "word")], "limiters": [(0, 7, "prefix")], "unlimiter": [(2, 7, "inside")], "limiter2": [(0, 7, "word")], "2limiter": [(1, 7, "word")], "élimiter": [(2, 7, "inside")], "my_limiter_x": [(3, 7, "word")], "limiterlimiter": [(0, 7, "prefix"), (7, 7, "inside")], "none": []}
    assert spans_of(spark, list(want), "limiter") == list(want.values())
    assert spans_of(spark, list(want), "limiter", True) == [[x for x in v if x[2] == "word"] for v in want.values()]


def test_many_occurrences_take_time_by_their_number(spark):
    import time

    began = time.time()
    (found,) = spans_of(spark, ["é the other " * 50_000], "the")
    assert time.time() - began < 40 and len(found) == 100_000
    assert found[:2] == [(3, 3, "word"), (8, 3, "inside")] and found[-2:] == [(13 * 49_999 + 3, 3, "word"), (13 * 49_999 + 8, 3, "inside")]


def test_folding_keeps_bytes(spark):
    from pyspark.sql import functions as F
    from turnlake.functions import text as X

    kelvin = chr(0x212A)
    want = {"ΟΔΟΣ": "οδοσ", "İstanbul": "İstanbul", "ẞ Straße": "ẞ straße", f"{kelvin} KELVIN": f"{kelvin} kelvin", "ÀÉÎ": "àéî", "ABC": "abc"}
    rows = spark.createDataFrame([(t,) for t in want], "text string").select("text", X.fold(F.col("text")).alias("folded"))
    assert {r["text"]: r["folded"] for r in rows.collect()} == want


def test_remotes(spark):
    from pyspark.sql import functions as F
    from turnlake.functions import text as X

    want = {"https://github.com/Acme/Pay.git": "github.com/acme/pay", "git@github.com:Acme/Pay.git": "github.com/acme/pay", "/srv/git/repo.git": "srv/git/repo", "  ": "", "file:///srv/x": "srv/x"}
    assert {r["r"]: r["id"] for r in spark.createDataFrame([(r,) for r in want], "r string").select("r", X.remote_id(F.col("r")).alias("id")).collect()} == want


def test_all_queries_are_callable():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(callable(q) for q in e.queries().values())


def test_conversation_search_reads_one_table(spark, data):
    from turnlake.operators import matching
    from turnlake.plans.compile import compile_query
    from turnlake.sources.tables import turns3

    plan = matching.matched(turns3(spark, data, ("conversation",)), compile_query("thing"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "conversations.parquet" in plan


def test_partition_count_does_not_change_hits(spark, data):
    from turnlake.operators import matching
    from turnlake.plans.compile import compile_query
    from turnlake.sources.tables import turns3

    q = compile_query("thing ershe zzqq")
    turns = turns3(spark, data, ("conversation",))
    rows = [sorted(map(str, matching.hits(matching.Relaxed(turns.repartition(n), q).turns, q).collect())) for n in (1, 7)]
    assert rows[0] == rows[1] and rows[0]
