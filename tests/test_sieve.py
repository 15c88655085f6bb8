"""The sieve keeps every row whose key is there, few others, and keeps them out of shuffles; files of a stream follow the rows."""

from pyspark.sql import functions as F

from citetrace.operators import graph
from citetrace.operators.sieve import among, sieved
from citetrace.plans.log_store import LogStore, Table


def test_rows_whose_key_is_there_stay(spark):
    rows = spark.range(20_000).selectExpr("case when id % 100 = 0 then null else concat('k', id) end k", "id")
    keys = spark.range(0, 40_000, 7).selectExpr("concat('k', id) key")
    left, exact = sieved(rows, "k", keys), among(rows, "k", keys.unionAll(keys))
    wanted = {r.id for r in rows.collect() if r.k is not None and r.id % 7 == 0}
    assert wanted <= {r.id for r in left.collect()} and left.count() < len(wanted) + 20
    assert sorted(r.id for r in exact.collect()) == sorted(wanted) and exact.columns == rows.columns
    assert among(rows, "k", keys.where("false")).count() == 0


def test_a_row_costs_an_array_access(spark, monkeypatch):
    """The bitmap is turned into numbers once a bucket, below the broadcast, not byte by byte for each row; every bit of a word is found."""
    from citetrace.operators import sieve

    plan = sieved(spark.range(10).selectExpr("concat('k', id) k"), "k", spark.range(3).selectExpr("concat('k', id) key"))._jdf.queryExecution().optimizedPlan().toString()
    join = next(i for i, line in enumerate(plan.splitlines()) if "Join" in line)
    assert "conv(" not in "".join(plan.splitlines()[: join + 1]) and "conv(" in "".join(plan.splitlines()[join + 1 :])
    monkeypatch.setattr(sieve, "BITS", 12)  # each bit of some words is asked for
    rows, keys = spark.range(9_000).selectExpr("concat('k', id) k", "id"), spark.range(0, 9_000, 5).selectExpr("concat('k', id) key")
    place = lambda df, c: {r.p for r in df.select(F.shiftrightunsigned(F.xxhash64(c), 52).alias("p")).collect()}
    left = sieved(rows, "k", keys)
    assert place(left, "k") == place(keys, "key") & place(rows, "k") and left.count() < 4_500


def test_a_level_does_not_shuffle_all_citations(spark):
    """Without broadcast of the level, what is shuffled is near what meets it."""
    cites = spark.range(50_000).selectExpr("concat('s', id) source_id", "concat('t', id % 5000) target_id", "id seq")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        level = spark.range(10).selectExpr("concat('t', id) key")
        plan = among(cites, "target_id", level)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("_key") < plan.index("_bitmap") and plan.splitlines()[0].strip().startswith("Project")
        upper, lower = [line for line in plan.splitlines() if "Join" in line]
        assert "_key" in upper and "_bucket" in lower
        assert graph.bfs(cites, spark.createDataFrame([("t1",), (None,)], "node_id string"), 1).count() == 11
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_store_reads_only_what_is_asked(spark, tmp_path):
    table = Table("a string, b string, n long", ("a", "b"), ("n",))
    store = LogStore(spark, str(tmp_path), {"t": table}, bucket_rows=50)
    for k in range(3):
        store.commit({"t": spark.range(200).selectExpr("concat('a', id % 20) a", "concat('b', id) b", f"(id * {k + 3}) % 7 n")})
    whole, asked = store.read("t"), spark.createDataFrame([("a3",), ("a5",)], "a string")
    some = store.read("t", having=asked)
    assert whole.count() == 200 and sorted(some.collect()) == sorted(whole.where(F.col("a").isin("a3", "a5")).collect())


def test_the_files_of_a_stream_follow_the_rows(spark, tmp_path):
    """No fixed number of tasks reads all observations."""
    from citetrace import catalog
    from citetrace.plans.fixture import Fixture

    spark.range(40_000).selectExpr("concat('W', id % 900) source_id", "concat('W', id % 1000) target_id", "'openalex' source_api", "date'2020-01-01' citation_date", "id seq").repartition(12).write.parquet(f"{tmp_path}/c")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        x = Fixture(spark, str(tmp_path))
        vars(x)["raw_citations"] = spark.read.parquet(f"{tmp_path}/c")
        base = x.streamed(catalog.observed, catalog.failed_observations)
        assert len(spark.read.parquet(f"{base}/inbox").inputFiles()) > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
