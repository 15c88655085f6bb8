"""Zipped CSV archives: equal to the plain files, read by members and blocks, with pruned columns, pushed filters and a filter of wanted ids."""

import random
import zipfile
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citetrace.sources import dumps

HEAD = "id,citing,cited,creation\n"


def rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def archives(tmp_path_factory):
    """Three archives of several members each, with quoted line ends, empty cells, another file and an empty member; and the rows."""
    folder, rnd, want, n = tmp_path_factory.mktemp("dump"), random.Random(1), [], 0
    for a in range(3):
        with zipfile.ZipFile(folder / f"a{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.txt", "id,not,a,table\n1,2,3,4\n")
            z.writestr("empty.csv", "")
            z.writestr("heads.csv", HEAD)
            for m in range(4):
                own = [(f"i{n + k}", f"c{rnd.randrange(500)}", f"d{rnd.randrange(300)}", rnd.choice(("2020-01", None, 'a "b"\nc, d', "é"))) for k in range(rnd.randrange(1, 400))]
                n += len(own)
                cell = lambda v: "" if v is None else '"' + v.replace('"', '""') + '"'
                z.writestr(f"m{m}.csv", HEAD + "".join(",".join(map(cell, r)) + "\n" for r in own))
                want += own
    return folder, want


def test_archives_equal_plain_rows(spark, archives, monkeypatch):
    folder, want = archives
    got = dumps.read(spark, str(folder))
    assert got.columns == ["id", "citing", "cited", "creation"] and rows(got) == Counter(want)
    assert got.rdd.getNumPartitions() == 3 * 6  # a partition for each member
    assert rows(dumps.read(spark, f"file://{folder}/a1.zip", "cited string, id string")) <= Counter((r[2], r[0]) for r in want)
    assert rows(dumps.read(spark, str(folder), "cited string, other long")) == Counter((r[2], None) for r in want)
    assert dumps.read(spark, str(folder), "cited string").count() == len(want)


def test_filters_reach_the_source(spark, archives):
    folder, want = archives
    df = dumps.read(spark, str(folder), "cited string, citing string")
    got = df.where("cited = 'd7' and citing is not null and length(citing) > 2")
    assert rows(got) == Counter((r[2], r[1]) for r in want if r[2] == "d7" and len(r[1]) > 2)
    assert "length" in got._jdf.queryExecution().executedPlan().toString()
    reader = dumps.ZippedCsvReader(df.schema, {"path": str(folder)})
    kept = list(reader.pushFilters([dumps.datasource.EqualTo(("cited",), "d7"), dumps.datasource.GreaterThan(("cited",), "d")]))
    assert [type(f).__name__ for f in kept] == ["GreaterThan"]
    seen = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in seen) == sum(r[2] == "d7" for r in want) and {v for b in seen for v in b.column("cited").to_pylist()} == {"d7"}


def test_wanted_ids_are_filtered_before_the_join(spark, archives):
    folder, want = archives
    ids = spark.createDataFrame([(f"d{i}",) for i in range(0, 300, 11)] + [("unknown",), (None,)], "cited string")
    keep = {f"d{i}" for i in range(0, 300, 11)}
    got = dumps.read(spark, str(folder), "cited string, id string", ids, "cited")
    assert rows(got) == Counter((r[2], r[0]) for r in want if r[2] in keep)
    f = dumps._Filter(dumps.wanted_filter(ids, "cited"))
    held = f.may_hold(pa.array([*sorted(keep), None])).to_pylist()
    assert all(held[:-1]) and not held[-1]
    assert sum(f.may_hold(pa.array([f"x{i}" for i in range(5000)])).to_pylist()) < 20
    odd = ["", "é😀", "x" * 100]
    assert all(dumps._Filter(dumps.wanted_filter(spark.createDataFrame([(v,) for v in odd], "cited string"), "cited", 1 << 15)).may_hold(pa.array(odd)).to_pylist())


def test_a_member_is_read_in_blocks(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("m.csv", "w") as out:
        out.write(HEAD.encode())
        for k in range(200):
            out.write("".join(f"i{k},{'c' * 100},d{i},2020\n" for i in range(500)).encode())
    monkeypatch.setattr(dumps, "BLOCK_BYTES", 1 << 16)
    reader = dumps.ZippedCsvReader(dumps.T.StructType.fromDDL("cited string"), {"path": str(tmp_path)})
    sizes = [b.num_rows for p in reader.partitions() for b in reader.read(p)]
    assert sum(sizes) == 100_000 and max(sizes) < 2_000


def test_written_archives_are_read_back(spark, tmp_path):
    df = spark.range(5000).select(F.concat(F.lit("i"), "id").alias("id"), F.when(F.col("id") % 3 > 0, F.lit('x, "y"\nz')).alias("note"), (F.col("id") % 7).alias("n")).repartition(3)
    dumps.write(df, f"file://{tmp_path}/out", member_rows=600)
    assert len(list((tmp_path / "out").glob("*.zip"))) == 3 and not list((tmp_path / "out").glob("*.draft"))
    assert rows(dumps.read(spark, str(tmp_path / "out"), "id string, note string, n long")) == rows(df)
