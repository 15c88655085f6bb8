"""Quoted CSV read by byte ranges: the same rows as a reader of whole files, wherever the ranges are cut."""

import csv
import random
from collections import Counter

import pytest

from citetrace.sources import readers


def written(path, rows, end="\n", bom=False):
    with open(path, "w", newline="", encoding="utf-8-sig" if bom else "utf-8") as f:
        csv.writer(f, lineterminator=end, quoting=csv.QUOTE_MINIMAL).writerows(rows)


@pytest.mark.parametrize(("end", "size"), [("\n", 257), ("\r\n", 64), ("\n", 1 << 20)])
def test_ranges_anywhere(spark, tmp_path, end, size):
    rnd = random.Random(size)
    cell = lambda: rnd.choice(("a", "b c", 'say "x"', "two\nlines", "\n\n", '"\n"', "é😀, ü", 'x\r\ny"', "plain", "1,2,3", '""'))
    for n in range(2):
        written(tmp_path / f"f{n}.csv", [["Record ID", "Title", "Note"], *([f"R{n}-{i}", cell(), cell() + cell()] for i in range(150))], end, bom=n == 0)
    want = Counter()
    for n in range(2):
        with open(tmp_path / f"f{n}.csv", newline="", encoding="utf-8-sig") as f:
            want += Counter(tuple(c.strip(" \t\n\r") or None for c in r) for r in list(csv.reader(f))[1:])
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        got = readers.notice_csv(spark, f"file://{tmp_path}/*.csv")
        assert got.columns == ["Record ID", "Title", "Note"]
        assert Counter(tuple(c and c.strip(" \t\n\r") or None for c in r) for r in got.collect()) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfid,"a ""b""",\nx,1\n\n  \ny,"\xff\xfe",3,4\n"z\n')
    got = readers.notice_csv(spark, f"file://{tmp_path}/a.csv")
    assert got.columns == ["id", 'a "b"', "_c2"]
    rows = {r[0]: (r[1], r[2]) for r in got.collect()}
    assert rows["x"] == ("1", None) and rows["y"] == ("��", "3") and len(rows) == 3
    (tmp_path / "none.csv").write_bytes(b"")
    assert readers.notice_csv(spark, f"file://{tmp_path}/none.csv").count() == 0
