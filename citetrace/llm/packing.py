"""Best-fit packing by a grouping genetic algorithm, as islands with elite migration.

Pieces of documents are dealt to blocks by a hash, a few thousand each, so a block is small at any input size.
Each block is evolved on several islands (Spark rows of their own); between two epochs every island gets the
best packing of its neighbour. Crossover injects whole well-filled bins of one parent into the other, removes
the bins that hold the same pieces, swaps displaced pieces for smaller ones of bins that they fill better, and best-fits the rest. Badly filled bins of all blocks are
opened again and packed together in the next level, until too few are left to matter.
"""

from __future__ import annotations

import bisect
import os
import random
import re
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citetrace.plans.storage import materialise

CAPACITY = 4096
END = 1
BLOCK = 3000
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 4
POPULATION = 3
LEVELS = 4
#: Bins filled less than this are opened for the next level.
WELL = 0.97
#: Words whose ids a task remembers at once.
REMEMBERED = 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A word of Latin-1 letters with ASCII marks after it: the tokenizer takes the letters and the marks as one unit each.
PLAIN = re.compile(r"([a-z\xb5\xdf-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)\Z")


class WordIds:
    """UTF-8 text to little-endian 32-bit ids.

    The tokenizer never joins across white space, so the ids of words are remembered, and those of their letters and
    marks. Only a plain word goes to the merges alone; any other one goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.units: dict[str, bytes] = {}
        # the model writes a byte as a character of its own; its vocabulary tells which
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.characters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def unit(self, text: str) -> bytes:
        ids = self.units.get(text)
        if ids is None:
            if len(self.units) >= REMEMBERED:
                self.units = {}
            spelled = text if text.isascii() else text.encode().decode("latin-1").translate(self.characters)
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(spelled)])
            self.units[text] = ids
        return ids

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        m = PLAIN.match(text.lower()) if len(text) < 200 else None
        if m and max(text) < "\u0100":
            return self.unit(m[1]) + self.unit(m[2]) if m[2] else self.unit(m[1])
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join([x.to_bytes(4, "little") for x in ids])

    def __call__(self, text: str | None) -> bytes:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) >= REMEMBERED:
                known = self.known = {}
            for w in words:
                if w not in known:
                    known[w] = self.word(w)
            return b"".join([known[w] for w in words])


_ids_of: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each Python process, so that tasks share what it remembers."""
    if path not in _ids_of:
        _ids_of[path] = WordIds(path)
    return _ids_of[path]


PIECE = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
)


def _pieces(path: str, capacity: int, with_ids: bool):
    schema = PIECE if with_ids else pa.schema(list(PIECE)[:-1])
    end = END.to_bytes(4, "little")

    def of(batches):
        ids_of = word_ids(path)
        for batch in batches:
            rows: list[list] = [[] for _ in PIECE]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = ids_of(text.as_py()) + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for col, x in zip(rows, (doc_id, n, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                        col.append(x)
            yield pa.record_batch([pa.array(col, f.type) for col, f in zip(rows, schema, strict=False)], schema=schema)

    return of


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the ids of each text and a closing one, cut at ``capacity``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return own.mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity, with_ids), out)


def best_fit(items: list[int], size: list[int], bins: list[list[int]], left: list[int], capacity: int) -> None:
    """Put each item, in order, into the bin of ``bins`` that it fills best, else into a new one. left: free places."""
    order = sorted((g, b) for b, g in enumerate(left) if g)
    for i in items:
        s = size[i]
        k = bisect.bisect_left(order, (s, -1))
        if k == len(order):
            bins.append([i])
            left.append(capacity - s)
            if capacity > s:
                bisect.insort(order, (capacity - s, len(bins) - 1))
        else:
            g, b = order.pop(k)
            bins[b].append(i)
            left[b] = g - s
            if g > s:
                bisect.insort(order, (g - s, b))


def exchange(size: list[int], bins: list[list[int]], left: list[int], displaced: list[int]) -> list[int]:
    """Swap items of ``bins`` for larger displaced ones that still fit; what is displaced then, smaller and so easier to place."""
    pool = sorted((size[i], i) for i in displaced)
    for k in sorted(range(len(bins)), key=lambda k: left[k]):
        while left[k] and pool:
            best = None  # the swap that leaves the least free
            for at, x in enumerate(bins[k]):
                j = bisect.bisect_right(pool, (size[x] + left[k], 1 << 60)) - 1
                if j >= 0 and pool[j][0] > size[x] and (best is None or pool[j][0] - size[x] > best[0]):
                    best = pool[j][0] - size[x], at, j
            if best is None:
                break
            gain, at, j = best
            (_, i), x = pool.pop(j), bins[k][at]
            bins[k][at] = i
            left[k] -= gain
            bisect.insort(pool, (size[x], x))
    return [i for _, i in pool]


def _score(bins: list[list[int]], left: list[int], capacity: int) -> tuple[int, float]:
    return -len(bins), sum(((capacity - g) / capacity) ** 2 for g in left)


def evolve(size: list[int], capacity: int, seed: int, elites: list[list[int]], generations: int, population: int) -> list[int]:
    """The bin of each item, after some generations from ``elites`` and best-fit starts of noisy order."""
    rng, n = random.Random(seed), len(size)
    fewest = -(-sum(size) // capacity)
    people = []

    def add(bins, left):
        people.append((_score(bins, left, capacity), bins, left))

    for bin_of in elites:
        bins: list[list[int]] = [[] for _ in range(max(bin_of, default=-1) + 1)]
        for i, b in enumerate(bin_of):
            bins[b].append(i)
        add(bins, [capacity - sum(size[i] for i in b) for b in bins])
    while len(people) < population:
        noise = 0.0 if not people else 0.1 * len(people)
        key = [s * (1 + noise * rng.random()) for s in size]
        bins, left = [], []
        best_fit(sorted(range(n), key=lambda i: (-key[i], i)), size, bins, left, capacity)
        add(bins, left)
        if len(bins) <= fewest:
            break
    for _ in range(generations):
        people.sort(key=lambda p: p[0], reverse=True)
        if len(people[0][1]) <= fewest or len(people) < 2:
            break
        (_, a, a_left), (_, b, b_left) = people[0], people[rng.randrange(1, len(people))]
        full = sorted(range(len(b)), key=lambda k: b_left[k])[: max(1, len(b) // 2)]
        inject = rng.sample(full, max(1, len(full) // 2))
        placed = {i for k in inject for i in b[k]}
        bins, left = [list(b[k]) for k in inject], [b_left[k] for k in inject]
        displaced = []
        for items, gap in zip(a, a_left, strict=True):
            if placed.isdisjoint(items):
                bins.append(list(items))
                left.append(gap)
            else:
                displaced += [i for i in items if i not in placed]
        # open the worst bins as well, so that a change is possible
        for k in sorted(sorted(range(len(bins)), key=lambda k: -left[k])[: max(1, len(bins) // 10)], reverse=True):
            displaced += bins.pop(k)
            left.pop(k)
        displaced = exchange(size, bins, left, displaced)
        best_fit(sorted(displaced, key=lambda i: -size[i]), size, bins, left, capacity)
        add(bins, left)
        people.sort(key=lambda p: p[0], reverse=True)
        people = people[:population]
    _, bins, _ = max(people, key=lambda p: p[0])
    out = [0] * n
    for k, items in enumerate(bins):
        for i in items:
            out[i] = k
    return out


def _epoch(capacity: int, generations: int, population: int):
    def of(batches):
        for pdf in batches:
            out = []
            for block, island, size, elites in zip(pdf["block"], pdf["island"], pdf["size"], pdf["elites"], strict=True):
                size = [int(x) for x in size]
                starts = [[int(x) for x in e] for e in elites]
                bin_of = evolve(size, capacity, (int(block) * 1009 + int(island)) * 31 + len(starts), starts, generations, population)
                fill: dict[int, int] = {}
                for s, b in zip(size, bin_of, strict=True):
                    fill[b] = fill.get(b, 0) + s
                out.append((block, island, bin_of, -len(fill) + sum((f / capacity) ** 2 for f in fill.values()) / (len(fill) + 1)))
            yield pd.DataFrame(out, columns=["block", "island", "bin_of", "score"])

    return of


def _level(items: DataFrame, blocks: int, level: int, capacity: int, islands: int, epochs: int) -> DataFrame:
    """``items`` with block and bin, as this level packs them."""
    item = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    dealt = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(blocks)))
    held = materialise(dealt.groupBy("block").agg(F.sort_array(F.collect_list(item)).alias("items")), "pack-blocks")
    size = held.select("block", F.expr("transform(items, x -> x.length)").alias("size"))
    every = size.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = every.withColumn("elites", F.array().cast("array<array<int>>"))
    schema = "block long, island int, bin_of array<int>, score double"
    for epoch in range(epochs):
        done = materialise(
            state.repartition(max(1, min(blocks * islands, 4096)), "block", "island").mapInPandas(_epoch(capacity, GENERATIONS, POPULATION), schema), "pack-epoch"
        )
        if epoch + 1 < epochs:  # an island keeps its own best and gets its neighbour's
            moved = done.select("block", F.explode(F.array("island", ((F.col("island") + 1) % islands).cast("int"))).alias("island"), "bin_of")
            elites = moved.groupBy("block", "island").agg(F.sort_array(F.collect_set("bin_of")).alias("elites"))
            state = every.join(elites, ["block", "island"])
    best = done.groupBy("block").agg(F.max_by("bin_of", F.struct("score", -F.col("island"))).alias("bin_of"))
    return held.join(best, "block").select("block", F.explode(F.arrays_zip("items", "bin_of")).alias("z")).select("block", F.col("z.bin_of").alias("bin"), "z.items.*")


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row of ``docs``.

    A null or empty text is one piece of the closing id; rows of a null id are packed too. Rows that repeat an
    id give pieces of their own, in an unsettled order of places.
    """
    all_pieces = materialise(pieces(docs, tokenizer, capacity), "pack-pieces")
    whole = all_pieces.where(F.col("length") == capacity)
    done = [whole.select("*", F.lit(0).alias("lvl"), F.xxhash64("doc_id", "piece").alias("block"), F.monotonically_increasing_id().alias("bin"))]
    rest = all_pieces.where(F.col("length") < capacity)
    for level in range(1, LEVELS + 1):
        n = rest.count()
        if not n:
            break
        blocks = -(-n // block)
        placed = materialise(_level(rest, blocks, level, capacity, islands, epochs), "pack-level")
        last = blocks == 1 or level == LEVELS
        if not last:
            fill = placed.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
            placed = placed.join(fill, ["block", "bin"])
            rest = placed.where(F.col("fill") < WELL * capacity).drop("fill", "block", "bin")
            placed = placed.where(F.col("fill") >= WELL * capacity)
        done.append(placed.select(*all_pieces.columns, F.lit(level).alias("lvl"), "block", F.col("bin").cast("long").alias("bin")))
        if last:
            break
    from functools import reduce

    from pyspark.sql import Window

    rows = reduce(DataFrame.unionByName, done)
    number = F.when(F.col("lvl") == 0, F.col("bin")).otherwise(
        F.shiftleft(F.col("lvl").cast("long"), 60) + F.shiftleft(F.col("block").cast("long"), 20) + F.col("bin")
    )
    rows = rows.withColumn("sequence_id", number)
    order = Window.partitionBy("sequence_id").orderBy("doc_id", "piece")
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", offset.cast("long").alias("offset"))
