"""What a stream and its store leave on disk and shuffle."""

import random
from collections import Counter

from citetrace import catalog
from citetrace.plans.fixture import Fixture
from citetrace.plans.log_store import LogStore, Table
from citetrace.plans.storage import put
from citetrace.streaming import merge

TABLE = {"t": Table("k long, v long, seq long", ("k",), ("v", "-seq"))}


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = manager.getAllFiles().iterator()
    names = set()
    while found.hasNext():
        names.add(found.next().getName())
    return {n for n in names if n.startswith("shuffle")}


def test_a_read_of_streamed_edges_shuffles_nothing(spark, tmp_path):
    schema = "source_id string, target_id string, depth int, seq long"
    base = f"file://{tmp_path}/s"
    for n in range(2):
        spark.range(1_000).selectExpr("concat('s', id % 300) source_id", "concat('t', id % 7) target_id", f"cast((id + {n}) % 3 as int) depth", f"id + {n * 1000} seq").coalesce(1).write.mode("append").parquet(f"{base}/inbox")
    got = merge.ingest(spark, f"{base}/inbox", base, schema, 1)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    every = spark.read.schema(schema).parquet(f"{base}/inbox").collect()
    best = {}
    for r in every:
        best[r.source_id, r.target_id] = min(best.get((r.source_id, r.target_id), (9, 0)), (r.depth, r.seq))
    assert rows(got) == Counter((*k, *v) for k, v in best.items())
    store = merge.store(spark, base, schema)
    few = spark.createDataFrame([("s1", "t1", 0, -5)], schema)
    before = store.state().written
    assert store.commit({"edges": few}).written < before / 2 and len(store.state().runs["edges"]) > 1  # a small batch writes its own rows alone


def test_writes_by_slices_give_the_same_rows(spark, tmp_path):
    rnd = random.Random(2)
    stores = [LogStore(spark, f"file://{tmp_path}/{n}", TABLE, bucket_rows=40, slice_rows=n, absorb=2) for n in (30, 10_000)]
    best = {}
    for n, size in enumerate((120, 200, 20)):
        batch = [(rnd.randrange(90), rnd.randrange(4), n * 1000 + i) for i in range(size)]
        for k, v, s in batch:
            best[k] = min(best.get(k, (9, 0)), (v, -s))
        for store in stores:
            store.commit({"t": spark.createDataFrame(batch, TABLE["t"].schema)}, number=n)
    for store in stores:
        assert rows(store.read("t")) == Counter((k, v, -s) for k, (v, s) in best.items())
    sliced, whole = ({(r["bits"], r["bucket"], r["rows"]) for r in s.state().runs["t"]} for s in stores)
    assert sliced == whole and len(whole) > 4


def test_of_equal_order_the_first_by_the_other_columns(spark):
    table = Table("k long, n long, a string", ("k",), ("n",))
    some = [(1, 5, "c"), (1, 5, "b"), (1, 6, "a"), (2, None, "z"), (2, 1, "a")]
    for order in (some, some[::-1]):
        assert rows(table.least(spark.createDataFrame(order, table.schema).coalesce(1))) == Counter([(1, 5, "b"), (2, None, "z")])


def test_no_shuffle_file_stays(spark, tmp_path):
    before = shuffle_files(spark)
    put(spark.range(1_000).repartition(5, "id"), f"file://{tmp_path}/p")
    store = LogStore(spark, f"file://{tmp_path}/s", TABLE, bucket_rows=300)
    store.commit({"t": spark.range(1_000).selectExpr("id k", "id v", "id seq")}, sizes={"t": 1_000})
    left = {n for n in shuffle_files(spark) - before if n.endswith(".data")}
    assert len(left) <= 5  # of a count by bucket, not of the rows
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_what_a_stream_has_taken_goes(spark, tmp_path):
    spark.range(3_000).selectExpr("concat('W', id % 900) source_id", "concat('W', id % 1000) target_id", "'openalex' source_api", "date'2020-01-01' citation_date", "id seq").repartition(3).write.parquet(f"{tmp_path}/c")
    x = Fixture(spark, str(tmp_path))
    vars(x)["raw_citations"] = spark.read.parquet(f"{tmp_path}/c")
    base = x.streamed(catalog.observed, catalog.failed_observations)
    observed = catalog.observed(x)
    assert 0 < spark.read.parquet(f"{base}/inbox").where("source_id is not null").count() < 0.7 * observed.count()
    store = merge.store(spark, base, catalog.STREAMED)
    assert store.read("edges").select("source_id", "target_id").distinct().count() == observed.select("source_id", "target_id").distinct().count()
    assert store.state().number == 2
