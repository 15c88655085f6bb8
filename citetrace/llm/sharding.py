"""Sharding by a histogram sort: count exact bytes below candidate boundaries, refine, exchange once.

The key of a row is (hash of its text, half of its id): equal texts are neighbours, and a group of copies of
any size can still be cut between two ids. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citetrace.plans.storage import materialise

SHARDS = 8
#: Rows of a stretch of a shard, each put in order by a task of its own: there are as many as the rows need.
ROWS_A_PART = 200_000
PROBES = 256
#: A boundary of a shard may miss its share of the bytes by this part of a shard, and by EDGE of it to stand at the edge of a group of equal texts.
TOLERANCE = 0.0002
EDGE = 0.01


def _bounds(rows: DataFrame, shards: int, tolerance: float, edge: float) -> list[tuple[int, int]]:
    """The ``shards - 1`` keys below which lie equal shares of the bytes."""
    total, h0, h1 = rows.agg(F.sum("size"), F.min("h"), F.max("h")).first()
    if not total:
        return []
    want = {i: total * i // shards for i in range(1, shards)}
    found: dict[int, tuple[int, int]] = {}
    # an open interval of keys: (on hash, low, high) or (on id, hash, low, high), with the bytes below it
    at = {i: (("h", 0, h0, h1), 0) for i in want}
    near = tolerance * total / shards
    at_group = max(near, edge * total / shards)
    probes = PROBES
    while at:  # each round cuts an interval of keys by the number of probes, so it ends
        spans = sorted({s for s, _ in at.values()})
        bucket = None
        for n, (kind, h, lo, hi) in enumerate(spans):
            step = max(1, -(-(hi - lo + 1) // probes))
            col = F.col("h") if kind == "h" else F.col("half")
            inside = col.between(lo, hi) if kind == "h" else (F.col("h") == h) & col.between(lo, hi)
            probe = F.expr(f"{n * probes} + cast(({'h' if kind == 'h' else 'half'} - {lo}L) div {step}L as int)")
            bucket = F.when(inside, probe) if bucket is None else bucket.when(inside, probe)
        seen = (
            rows.select("h", "half", "size", bucket.alias("b"))
            .where("b is not null")
            .groupBy("b")
            .agg(F.sum("size"), F.min("h"), F.max("h"), F.min("half"), F.max("half"))
            .orderBy("b")
            .collect()
        )  # at most ``probes`` rows for each span
        nxt = {}
        for i, (span, below) in at.items():
            n, sum_ = spans.index(span), below
            for b, size, ha, hb, da, db in seen:
                if b // probes != n:
                    continue
                slack = at_group if ha == hb and da != db and span[0] == "h" else near  # a bucket of one text's copies
                if sum_ + size <= want[i] and abs(sum_ + size - want[i]) > slack:
                    sum_ += size
                    continue
                if abs(sum_ - want[i]) <= slack or (ha == hb and da == db):
                    found[i] = (ha, da)  # this bucket's first key starts the next stretch
                elif sum_ + size <= want[i] + slack:
                    found[i] = (hb, db + 1)  # it ends the stretch
                else:
                    nxt[i] = (("h", 0, ha, hb) if ha != hb else ("d", ha, da, db), sum_)
                break
            else:
                found[i] = (h1 + 1, 0)
        at = nxt
    return [found[i] for i in sorted(found)]


def shard(docs: DataFrame, shards: int = SHARDS, rows_a_part: int = ROWS_A_PART, tolerance: float = TOLERANCE, edge: float = EDGE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; law ``bytes``.

    size is the UTF-8 length of the text plus 1; a null text counts as an empty one, a null id as 0.
    slot runs without gaps from 0 in each shard, in key order. Repeated rows have slots of their own; an empty table gives no rows; very long texts count
    whole and other columns are not read. Equal texts share a shard, but for a group that a boundary falls into further from both its ends than
    ``edge`` of a shard: such a group is cut between two ids, by at most each of the ``shards - 1`` boundaries.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftright(F.xxhash64(text), 2).alias("h"),
        F.shiftright(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), 2).alias("half"),
    )
    slim = materialise(slim, "shard-keys")
    bounds = _bounds(slim, shards, tolerance, edge)
    limits = F.array(*[F.struct(F.lit(h).cast("long").alias("h"), F.lit(d).cast("long").alias("d")) for h, d in bounds]) if bounds else None
    key = F.struct(F.col("h").alias("h"), F.col("half").alias("d"))
    placed = slim.withColumn("shard", F.size(F.filter(limits, lambda x: x <= key)) if bounds else F.lit(0))
    # the one exchange of the rows: stretches in the order of shards and keys, written with their number, so that all that follows sees the same ones
    order = ["shard", "h", "half", "doc_id", "size"]
    parts = max(1, -(-slim.count() // rows_a_part))
    dealt = materialise(placed.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "shard-parts")
    sums = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*order[1:]))
    return dealt.join(before, ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + place - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
