"""Exact top-k search by inner product: a Voronoi join.

Vectors are dealt to the nearest of some pivots (about the root of the number of vectors, MAX_PIVOTS at most). A group's
summary is its pivot, size and radius: no member can score above ``q . pivot + |q| * radius``. A query is first solved in
the groups where it scores best, which gives a floor for its k-th score; then it goes to just those further groups whose
bound reaches the floor. Groups are cut into blocks of bounded size and queries into chunks, and each (block, chunk) is
solved by one task, a tile at a time. Results are exact at any number of pivots; those only decide how much can be
skipped. Where the bounds skip nothing, a row is sent once for each chunk of queries, and a query once for each block.

Scores are whole numbers: products run in doubles as long as no sum can pass 2^53, else in 64-bit integers, else in
Python's. A score beyond the range of a long is returned as the nearest long, after ranking.

Vectors that are null, or hold a null or a component that isn't finite (or not 256 times), take no part, nor do rows without an id. Rows of
the same id count once (the least vector). Vectors of different lengths don't meet. Ties go to the smaller id; fewer
than k candidates give fewer rows. Empty table: no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

K = 5
MAX_PIVOTS = 4096
BLOCK_BYTES = 4 << 20
TILE = 1024
#: ``over`` orders scores beyond the range of a long; else it is empty.
HIT = "query_id long, vec_id long, score long, over string"
LONG = 1 << 63


def quantised(v: Column) -> Column:
    """floor(256 * x) of every component, as double; null if the vector takes no part."""
    y = F.transform(v, lambda x: x.cast("double") * 256)
    good = v.isNotNull() & F.forall(y, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(y, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)))  # larger ones are whole


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _by_length(vectors: pa.Array):
    """(length, positions) for each length of vector."""
    n = np.array([len(v) for v in vectors], int)
    for d in np.unique(n):
        yield int(d), np.flatnonzero(n == d)


def over(v: int) -> str:
    """Empty for scores that a long holds; else text that sorts like the scores do."""
    if -LONG < v < LONG - 1:
        return ""
    d = str(abs(v))
    return f"{len(d):06d}{d}" if v > 0 else f"{999_999 - len(d):06d}{''.join(str(9 - int(c)) for c in d)}"


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles."""
    most = (np.abs(q).max(initial=0) or 1.0) * (np.abs(x).max(initial=0) or 1.0) * max(1, q.shape[1])
    if most < 2**53:
        return q @ x.T
    if most < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = lambda m: np.array([[int(c) for c in row] for row in m.tolist()], object).reshape(m.shape)
    return whole(q) @ whole(x).T


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k best (query, candidate, score) of each query in one tile, ties to the smaller id, never itself."""
    order = np.argsort(ids, kind="stable")
    ids, s = ids[order], products(q, x[order])
    own = q_ids[:, None] == ids[None, :]
    if s.dtype == object:
        rows = [sorted(((-s[r, c], c) for c in np.flatnonzero(~own[r])))[:k] for r in range(len(q_ids))]
        got = [(r, c) for r, row in enumerate(rows) for _, c in row]
        row, col = np.array([g[0] for g in got], int), np.array([g[1] for g in got], int)
    else:
        s = np.where(own, -np.inf if s.dtype == float else np.iinfo(np.int64).min, s)
        floor = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] if s.shape[1] > k and s.dtype == float else np.sort(s, axis=1)[:, -min(k, s.shape[1]) :][:, :1]
        above, equal = s > floor, (s == floor) & ~own
        take = (above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1)[:, None]))) & ~own
        row, col = np.nonzero(take)
    return q_ids[row].tolist(), ids[col].tolist(), [int(v) for v in s[row, col].tolist()]


def best_of_tiles(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The same over tiles of bounded size."""
    out = []
    for a in range(0, len(q_ids), TILE):
        held: dict[int, list] = {}
        for b in range(0, len(ids), TILE):
            for i, j, v in zip(*best(q_ids[a : a + TILE], q[a : a + TILE], ids[b : b + TILE], x[b : b + TILE], k), strict=True):
                held.setdefault(i, []).append((-v, j))
        out += [(i, j, -v) for i, found in held.items() for v, j in sorted(found)[:k]]
    return out


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, *, vec_id="vec_id", embedding="embedding", k=K, max_pivots=MAX_PIVOTS, block_bytes=BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row for which ``is_query`` (over ``vec_id``)."""
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(embedding)).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    v = materialise(spark, v.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    n, longest = v.agg(F.count("*"), F.max(F.size("v"))).first()
    block = chunk = max(16, block_bytes // (8 * max(1, longest or 1)))
    pivots: dict[int, np.ndarray] = {}
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(max_pivots, int(n**0.5)))).collect()
    for d in {len(r["v"]) for r in sample}:
        pivots[d] = np.array([r["v"] for r in sample if len(r["v"]) == d], float).reshape(-1, d)
    shared = spark.sparkContext.broadcast(pivots)  # max_pivots vectors

    def assign(batches):
        for b in batches:
            if not b.num_rows:
                continue
            group, far = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for n, at in _by_length(b["v"]):
                x = _matrix(b["v"].take(pa.array(at)))
                p = shared.value.get(n, np.zeros((1, n)))
                with np.errstate(over="ignore", invalid="ignore"):
                    d2 = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None, :]
                    near = np.nan_to_num(d2, nan=np.inf).argmin(1)
                    group[at], far[at] = n * max_pivots + near, np.nan_to_num(np.sqrt(((x - p[near]) ** 2).sum(1)), nan=np.inf)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.array(group), pa.array(far)], ["vec_id", "v", "grp", "far"])

    dealt = materialise(spark, v.mapInArrow(assign, "vec_id long, v array<double>, grp long, far double"), "voronoi")
    summary = {r["grp"]: (r["n"], r["radius"]) for r in dealt.groupBy("grp").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}  # a row a group
    blocks = {g: -(-n // block) for g, (n, _) in summary.items()}
    info = spark.sparkContext.broadcast(summary)

    def bounds(n: int, q: np.ndarray):
        """(groups of this length, their sizes, score with each pivot, most that a member can score), rounding allowed for."""
        gs = [g for g in sorted(info.value) if g // max_pivots == n]
        p = shared.value.get(n, np.zeros((1, n)))[[g % max_pivots for g in gs]]
        radius, norm = np.array([info.value[g][1] for g in gs])[None, :], np.sqrt((q * q).sum(1))[:, None]
        with np.errstate(over="ignore", invalid="ignore"):
            at = q @ p.T
            up = at + norm * radius + 1 + 1e-9 * norm * (np.sqrt((p * p).sum(1))[None, :] + radius)
        return np.array(gs), np.array([info.value[g][0] for g in gs]), np.nan_to_num(at), np.nan_to_num(up, nan=np.inf, posinf=np.inf)

    def route(first: bool):
        """Queries to groups: at first the best-scoring ones with over k members together, later all others in reach."""

        def run(batches):
            for b in batches:
                rows, to = [], []
                for n, at in _by_length(b["v"]) if b.num_rows else ():
                    gs, size, near, up = bounds(n, _matrix(b["v"].take(pa.array(at))))
                    order = np.argsort(-near, axis=1, kind="stable")
                    need = np.cumsum(size[order], axis=1) - size[order] <= k
                    home = np.zeros_like(need)
                    np.put_along_axis(home, order, need, axis=1)
                    go = home if first else ~home & (up >= b["floor"].to_numpy(zero_copy_only=False)[at][:, None])
                    i, j = go.nonzero()
                    rows.append(at[i])
                    to.append(gs[j])
                if rows and sum(map(len, rows)):
                    take = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([b["vec_id"].take(take), b["v"].take(take), pa.array(np.concatenate(to))], ["query_id", "q", "grp"])

        return run

    def table(hits: list[tuple[int, int, int]]) -> pa.Table:
        a, b, c = zip(*hits, strict=True) if hits else ((), (), ())
        score = [max(-LONG, min(LONG - 1, v)) for v in c]
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(score, pa.int64()), "over": pa.array([over(v) for v in c], pa.string())})

    def solve(sent: DataFrame) -> DataFrame:
        sent = materialise(spark, sent, "sent")
        asked = {r["grp"]: -(-r["n"] // chunk) for r in sent.groupBy("grp").agg(F.count("*").alias("n")).collect()}  # a row a group
        if not asked:
            return spark.createDataFrame([], HIT)
        parts = spark.createDataFrame([(g, blocks[g], c) for g, c in asked.items()], "grp long, blocks int, chunks int")
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        data = dealt.join(F.broadcast(parts), "grp").withColumn("blk", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        data = data.select("grp", "blk", upto("chunks").alias("chk"), "vec_id", "v")
        qs = sent.join(F.broadcast(parts), "grp").withColumn("chk", F.pmod(F.xxhash64("query_id"), F.col("chunks")))
        qs = qs.select("grp", upto("blocks").alias("blk"), F.col("chk").cast("int").alias("chk"), "query_id", "q")

        def one(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return table([])
            got = best_of_tiles(right["query_id"].to_numpy(), _matrix(right["q"]), left["vec_id"].to_numpy(), _matrix(left["v"]), k)
            return table(got)

        key = ["grp", "blk", "chk"]
        return data.groupBy(*key).cogroup(qs.groupBy(*key)).applyInArrow(one, HIT)

    ranked = lambda hits: hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("over"), "vec_id"))).where(F.col("rank") <= k)
    queries = v.where(is_query)
    near = materialise(spark, ranked(solve(queries.mapInArrow(route(True), "query_id long, q array<double>, grp long"))), "near")
    floor = near.groupBy("query_id").agg(F.when((F.count("*") >= k) & (F.min("score") > -LONG), F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("floor"))
    rest = queries.join(floor, queries["vec_id"] == floor["query_id"], "left").select("vec_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    far = solve(rest.mapInArrow(route(False), "query_id long, q array<double>, grp long"))
    return ranked(near.drop("rank").unionByName(far)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
