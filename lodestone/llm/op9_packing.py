"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are cut into pieces no longer than the longest permitted length. Pieces are dealt at random into shards of a
bounded number of pieces, and each shard is packed best-fit decreasing: a piece goes into the open bin that it leaves
least room in. If none has room, a bin is opened: of the permitted lengths that one whose cost is least for each unit of
contents, as the pieces that still wait would fill it, and downsized to that. A bin costs its capacity, a part that grows
with the square of it (attention) and a fixed overhead. The shard is also packed with each length in turn as the least to
open, and the cheapest of all these plans is kept. At last each bin is downsized to the smallest permitted length that
holds its contents. A shard wastes a few part-filled bins at most, so the shards cost next to nothing against one global
packing.

Sizes are words between ASCII white space; whole texts are counted and cut, however long. A document without words (null,
empty) gives one row of 0 tokens without a bin. A row is told by id, text (``text_key``, a hash) and ``copy``, which counts
rows that repeat; null ids are kept. Ties: of equal pieces the first by id, text, copy and piece goes first, of open bins
with equal room the last one filled takes it, of equal costs the smallest length and the first plan win. Empty table: no
rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise
from .op7_mixing import words

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 32
#: The capacity at which the square part of the cost equals the linear one.
SQUARE = 65_536
SHARD_ROWS = 20_000
OUT = "doc_id long, text_key long, copy long, piece long, start long, n_tokens long, shard long, bin_id long, capacity long, bin_offset long"


def cost(capacity: int, overhead: float = OVERHEAD, square: float = SQUARE) -> float:
    return overhead + capacity + capacity * capacity / square


class Waiting:
    """Pieces that are not placed yet, by length, longest first."""

    def __init__(self, lengths: list[int]):
        self.sizes, self.left = sorted(set(lengths)), Counter(lengths)

    def drop(self, n: int) -> None:
        self.left[n] -= 1
        if not self.left[n]:
            del self.sizes[bisect_left(self.sizes, n)]

    def filled(self, room: int) -> int:
        """How much of ``room`` is filled if the longest piece that fits goes in, again and again."""
        at, start = len(self.sizes), room
        while room > 0:
            at = bisect_right(self.sizes, room, 0, at) - 1
            if at < 0:
                break
            n = self.sizes[at]
            room -= n * min(self.left[n], room // n)
        return start - room


def cheapest(n: int, waiting: Waiting, capacities: tuple[int, ...], price: dict[int, float]) -> int:
    """The capacity to open for a piece of ``n``: least cost of the bin, downsized to what the pieces that wait would fill
    it with, for each unit of contents; of equals the smallest."""

    def rate(c: int) -> tuple[float, int]:
        inside = n + waiting.filled(c - n)
        return price[next(x for x in capacities if x >= inside)] / inside, c

    return min(rate(c) for c in capacities if c >= n)[1]


def best_fit(lengths: list[int], capacities: tuple[int, ...], choose) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: (bin of each piece, its offset there, contents of each bin). ``choose``: the capacity to open
    for (length, what waits), or the least of them to open whatever waits."""
    if isinstance(choose, int):
        choose = lambda n, _, least=choose: next(c for c in capacities if c >= max(n, least))
    bins, offsets, filled, room = [0] * len(lengths), [0] * len(lengths), [], []
    open_at: dict[int, list[int]] = {}
    rooms = 0  # bit r: there is an open bin with r left
    waiting = Waiting(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        waiting.drop(n)
        fit = rooms >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = open_at[r].pop()
            if not open_at[r]:
                rooms &= ~(1 << r)
        else:
            b = len(filled)
            filled.append(0)
            r = choose(n, waiting)
            room.append(r)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += n
        room[b] = r - n
        if room[b]:
            open_at.setdefault(room[b], []).append(b)
            rooms |= 1 << room[b]
    return bins, offsets, filled


def plan(lengths: list[int], capacities: tuple[int, ...], overhead: float = OVERHEAD, square: float = SQUARE) -> tuple[list[int], list[int], list[int]]:
    """The cheaper of the packings: the least-cost size at each opening, and each fixed least size (bin of each piece, its
    offset, downsized capacity of each bin)."""
    price, best = {c: cost(c, overhead, square) for c in capacities}, None
    for choose in (lambda n, waiting: cheapest(n, waiting, capacities, price), *capacities):
        bins, offsets, filled = best_fit(lengths, capacities, choose)
        sizes = [next(c for c in capacities if c >= f) for f in filled]
        total = sum(price[c] for c in sizes)
        if best is None or total < best[0]:
            best = total, bins, offsets, sizes
    return best[1:]


def pack(spark: SparkSession, docs: DataFrame, *, doc_id="doc_id", text="text", capacities=CAPACITIES, overhead=OVERHEAD, square=SQUARE, shard_rows=SHARD_ROWS) -> DataFrame:
    """One row for each piece: where it starts in its document, its bin, the bin's capacity, its offset in the bin."""
    caps, most = tuple(sorted(capacities)), max(capacities)
    key = F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key")
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key, words(F.col(text)).alias("size")).groupBy("doc_id", "text_key", "size").count()
    sized = sized.select("doc_id", "text_key", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("copy"))
    last = F.greatest(F.ceil(F.col("size") / most).cast("long") - 1, F.lit(0).cast("long"))
    pieces = sized.select("doc_id", "text_key", "copy", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select("doc_id", "text_key", "copy", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("size") - F.col("piece") * most).cast("long").alias("n_tokens"))
    pieces = materialise(spark, pieces, "pieces")
    shards = max(1, -(-pieces.where("n_tokens > 0").count() // shard_rows))
    full = pieces.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_key", "copy", "piece"), F.lit(shards)))

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("doc_id", "text_key", "copy", "piece")])
        bins, offsets, sizes = plan(t["n_tokens"].to_pylist(), caps, overhead, square)
        shard = t["shard"][0].as_py()
        return t.append_column("bin_id", pa.array([(shard << 32) + b for b in bins], pa.int64())).append_column("capacity", pa.array([sizes[b] for b in bins], pa.int64())).append_column("bin_offset", pa.array(offsets, pa.int64()))

    packed = full.groupBy("shard").applyInArrow(one, OUT)
    none = [F.lit(None).cast("long").alias(c) for c in ("shard", "bin_id", "capacity", "bin_offset")]
    return packed.unionByName(pieces.where("n_tokens = 0").select("*", *none)).drop("shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
