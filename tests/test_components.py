"""Components that follow new edges against a full run."""

import random

from pyspark.sql import functions as F

from citetrace.operators import components
from citetrace.operators.components import Components, connected_components


def test_batches_equal_a_full_run(spark, tmp_path):
    rnd = random.Random(3)
    edges = [(f"n{rnd.randrange(120):03d}", f"n{rnd.randrange(120):03d}") for _ in range(110)] + [(None, "n000"), ("n001", None), ("m", "m")]
    stored = Components(spark, f"file://{tmp_path}/labels", tier_rows=20)
    taken = []
    for n in range(3):
        batch = edges[n::3]
        stored.add(spark.createDataFrame(batch, "source_id string, target_id string"), number=n)
        taken += batch
        if n > 0:
            full = dict(connected_components(spark.createDataFrame(taken, "a string, b string"), "a", "b").collect())
            loops = {a: a for a, b in taken if a is not None and a == b and a not in full}
            assert dict(stored.labels().collect()) == full | loops
    assert stored.add(spark.createDataFrame(edges[:9], "source_id string, target_id string"), number=2) == 0


def test_a_batch_changes_only_what_it_joins(spark, tmp_path):
    rows = [(f"c{k:02d}-{i}", f"c{k:02d}-{i + 1}") for k in range(20) for i in range(10)]
    stored = Components(spark, f"file://{tmp_path}/labels")
    assert stored.add(spark.createDataFrame(rows, "source_id string, target_id string")) == 220
    one = [("c05-3", "c09-4"), ("c05-1", "c05-7"), ("c02-1", "new")]  # joins two, one is known, one node is new
    assert stored.add(spark.createDataFrame(one, "source_id string, target_id string")) == 11 + 1
    labels = dict(stored.labels().collect())
    assert labels["c09-9"] == "c05-0" and labels["new"] == "c02-0" and len(set(labels.values())) == 19
    assert stored.add(spark.createDataFrame(one, "source_id string, target_id string")) == 0


def test_long_paths_shrink_by_a_share_each_round(spark, monkeypatch):
    """What all rounds write together is a multiple of the edges, also on a path and a star."""
    rows = []

    def watched(df, name):
        out = write(df, name)
        if name == "cc":
            rows.append(out.count())
        return out

    write = components.materialise
    monkeypatch.setattr(components, "materialise", watched)
    path = spark.range(400).select(F.format_string("p%05d", "id").alias("a"), F.format_string("p%05d", F.col("id") + 1).alias("b"))
    star = spark.range(200).select(F.lit("hub").alias("a"), F.format_string("s%04d", "id").alias("b"))
    found = connected_components(path.unionAll(star).unionAll(path), "a", "b")
    assert {tuple(r) for r in found.groupBy("component").count().collect()} == {("p00000", 401), ("hub", 201)}
    assert sum(rows[1:]) < 5 * 600 and rows[-1] == 0


def test_nodes_whose_numbers_meet_are_told_apart(spark, monkeypatch):
    """A salt under which two nodes have one number is not used."""
    real = components._number
    monkeypatch.setattr(components, "_number", lambda c, salt: F.length(c).cast("long") if salt == 0 else real(c, salt))
    edges = spark.createDataFrame([("a", "bb"), ("c", "dd"), ("x", "x"), (None, "y")], "a string, b string")
    assert dict(connected_components(edges, "a", "b").collect()) == {"a": "a", "bb": "a", "c": "c", "dd": "c"}
    assert connected_components(edges.where("a = 'x'"), "a", "b").count() == 0
