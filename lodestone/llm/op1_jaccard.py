"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are lower-case words; equal word sequences are one node. Every node has the set of its five-word shingles and a
MinHash signature. Nodes that share a band of the signature are compared a part of the signature at a time: a pair is
dropped as soon as the posterior probability (uniform prior) that its similarity reaches the threshold falls below the
tolerance. What survives links nodes into groups. Within a group every pair goes through the same pruning, and those
that survive are compared exactly by their shingles. Bands and tolerance lose a pair at the threshold with a
probability of about 1e-6.

No rows are made for pairs. Buckets and groups beyond a block's size are cut into blocks, and each task compares two
blocks; it returns, for each node, how many documents it is linked to and one edge that keeps its class together. So
the result is one row a document: its class (the least id in it) and its number of links, copies included. A group of
n different texts costs n * n / BLOCK rows of blocks: counting the links of n texts that are all alike takes n * n
comparisons, and this spreads them evenly. Exact copies are one node and cost nothing here.

Texts are shuffled only if they may be in a group; nothing that grows with the table is broadcast or collected.

Whole texts are read, however long. Fewer than five words are one shingle. Null texts and texts without words are
linked to nothing and are classes of their own (by id). Null ids: such rows are compared like any other, and a class of
theirs alone has a null id. Repeated rows are copies. Ties (equal similarity) need no order: every pair at the threshold
or above is a link. Empty table: no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, keyed_runs, materialise, row_key, sieve, sifted, sliced, used_up, with_fields
from .components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
STEP = 32
TOLERANCE = 1e-6
SIGNATURE_BLOCK = 2048
BLOCK = 1024
KEPT_WORDS = 300_000


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def node_of(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words))


def shingles(words: list[str], n: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct n-grams of words, sorted; of all words together if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    count, out = max(1, len(h) - n + 1), np.uint64(0x9E3779B97F4A7C15)
    for j in range(min(n, len(h))):
        out = (out ^ h[j : j + count]) * np.uint64(0xBF58476D1CE4E5B9)
        out = out ^ (out >> np.uint64(29))
    return np.unique(out)


def _turns(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1234)
    return rng.integers(1, 1 << 63, k, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, k, np.uint64)


def signature(x: np.ndarray, turns) -> np.ndarray:
    """MinHash values (32 bits each) of a set of hashes."""
    a, b = turns
    low = np.full(len(a), np.iinfo(np.uint64).max)
    for k in range(0, len(x), 256):
        np.minimum(low, (x[k : k + 256, None] * a[None, :] + b[None, :]).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, tolerance: float, steps) -> dict[int, int]:
    """After n values: the fewest matches with a posterior probability of ``tolerance`` or more for the threshold."""
    out = {}
    for n in steps:
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def surviving(a: np.ndarray, b: np.ndarray, least: dict[int, int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of two signature blocks (of one block, i < j, if ``same``) that no part of them rules out."""
    found_i, found_j = [], []
    steps = sorted(least)
    rows = max(1, 4_000_000 // max(1, len(b) * steps[0]))
    for top in range(0, len(a), rows):
        part = a[top : top + rows]
        hits = (part[:, None, : steps[0]] == b[None, :, : steps[0]]).sum(2)
        i, j = np.nonzero(hits >= least[steps[0]])
        hits, i = hits[i, j], i + top
        if same:
            keep = i < j
            i, j, hits = i[keep], j[keep], hits[keep]
        for before, n in zip(steps, steps[1:], strict=False):
            if not len(i):
                break
            keep = np.zeros(len(i), bool)
            for k in range(0, len(i), 100_000):
                s = slice(k, k + 100_000)
                hits[s] += (a[i[s], before:n] == b[j[s], before:n]).sum(1)
            keep = hits >= least[n]
            i, j, hits = i[keep], j[keep], hits[keep]
        found_i.append(i)
        found_j.append(j)
    return np.concatenate(found_i or [np.empty(0, int)]), np.concatenate(found_j or [np.empty(0, int)])


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    lab = np.arange(n)
    while True:
        m = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        np.minimum.at(new, lab[i], m)
        np.minimum.at(new, lab[j], m)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share: products of slices of the membership matrix of what several sets hold."""
    n = len(sets)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    common = counts[inverse] > 1
    col, row = (np.cumsum(counts > 1) - 1)[inverse[common]], row[common]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    out, width = np.zeros((n, n), np.float32), int((counts > 1).sum())
    for left in range(0, width, 4096):
        lo, hi = np.searchsorted(col, [left, left + 4096])
        m = np.zeros((n, min(4096, width - left)), np.float32)
        m[row[lo:hi], col[lo:hi] - left] = 1
        out += m @ m.T
    return out


def _blocks(df: DataFrame, group: list[str], size: str, block: int) -> DataFrame:
    """Each row goes to all pairs of blocks that hold its block (blk); ``key`` tells the pairs of blocks apart."""
    nb = F.ceil(F.col(size) / block).cast("int")
    df = df.withColumn("nb", nb).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    df = df.select("*", other.alias("other"))
    return df.withColumn("key", F.xxhash64(*group, F.least("blk", "other"), F.greatest("blk", "other"))).withColumn("own", F.col("blk") == F.col("other"))


def sketch(spark: SparkSession, docs: DataFrame, *, doc_id="doc_id", text="text", bands=BANDS, rows=ROWS) -> DataFrame:
    """(doc_id, dk, node, sig) of every row, written out; dk tells rows apart, node and sig are null without words."""
    turns = _turns(bands * rows)

    def run(batches):
        for b in sliced(batches):
            nodes, sigs = [], []
            for t in b["text"].to_pylist():
                w = words_of(t)
                nodes.append(node_of(w) if w else None)
                sigs.append(signature(shingles(w), turns).tobytes() if w else None)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["dk"], pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "dk", "node", "sig"])

    d = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("dk"), F.col(text).alias("text"))
    return materialise(spark, d.mapInArrow(run, with_fields(d.select("doc_id", "dk").schema, node="binary", sig="binary")), "sketch")


def met_in_blocks(t: pa.Table, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one pair of blocks (or of one block) that their signatures don't rule out."""
    own, blk = t["own"].to_numpy(), t["blk"].to_numpy()
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(t.num_rows, -1)
    if own.all():
        return surviving(sig, sig, least, True)
    left, right = np.flatnonzero(blk == blk.min()), np.flatnonzero(blk != blk.min())
    i, j = surviving(sig[left], sig[right], least, False)
    return left[i], right[j]


def candidates(spark: SparkSession, nodes: DataFrame, *, threshold=THRESHOLD, bands=BANDS, rows=ROWS, tolerance=TOLERANCE, block=SIGNATURE_BLOCK) -> DataFrame:
    """Edges (a, b) that keep together all nodes (node, sig) which may be similar."""
    least = least_matches(threshold, tolerance, range(STEP, bands * rows + 1, STEP))
    width = 4 * rows
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substr("sig", i * width + 1, F.lit(width)))))
    at = nodes.select("node", band.alias("bucket"))
    one, two = F.xxhash64("node"), F.xxhash64("node", F.lit(1))
    # buckets are summed up, then joined back: a bucket that many share is split by the join, no task holds it whole
    company = at.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(one).alias("f1"), F.bit_xor(two).alias("f2")).where("n > 1")
    company = materialise(spark, company, "companies")
    # pairs that meet in several bands mostly meet in like company: one bucket of each company is enough
    met = materialise(spark, at.join(company, "bucket").select("node", "n", "f1", "f2").dropDuplicates(["node", "n", "f1", "f2"]), "buckets")
    used_up(spark, company)
    met = _blocks(met.join(nodes.select("node", "sig"), "node"), ["f1", "f2", "n"], "n", block)

    def run(batches):
        out_a, out_b = [], []
        for _, t in keyed_runs(batches, "key"):
            node = t["node"].to_pylist()
            i, j = met_in_blocks(t, least)
            if len(i):
                lab = roots(len(node), i, j)
                for k in np.flatnonzero(lab != np.arange(len(lab))):
                    out_a.append(node[k])
                    out_b.append(node[lab[k]])
            if len(out_a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])
                out_a, out_b = [], []
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])

    met = met.select("key", "own", "blk", "node", "sig").repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(run, "a binary, b binary")


def verified(spark: SparkSession, docs: DataFrame, members: DataFrame, *, doc_id="doc_id", text="text", threshold=THRESHOLD, bands=BANDS, rows=ROWS, tolerance=TOLERANCE, block=BLOCK) -> DataFrame:
    """(node, links, root): links of ``members`` (node, dk, copies, root, size, sig) within each group ``root``. Pairs of
    a group go through the pruning once more, as most of them never met; the exact comparison is for those that survive.

    Texts reach it by the row key ``dk`` of one row of each node. A sieve of these keys keeps all other texts in place.
    """
    least = least_matches(threshold, tolerance, range(STEP, bands * rows + 1, STEP))
    wanted = sieve(spark, members.select("dk"), "members")
    d = docs.select(row_key(doc_id, text).alias("dk"), F.col(text).alias("text"))
    d = sifted(d, "dk", wanted).where("__may").select("dk", "text").dropDuplicates(["dk"])
    d = d.join(members, "dk").select("node", "root", "size", "copies", "sig", "text")

    def cut(batches):
        for b in sliced(batches, 256):
            sets = [shingles(words_of(t)).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sets, pa.binary())], [*b.schema.names[:-1], "grams"])

    sets = d.mapInArrow(cut, with_fields(d.drop("text").schema, grams="binary"))
    met = _blocks(sets, ["root"], "size", block).select("key", "own", "blk", "node", "copies", "sig", "grams").repartition("key").sortWithinPartitions("key")

    def run(batches):
        for _, t in keyed_runs(batches, "key"):
            i, j = met_in_blocks(t, least)
            if not len(i):
                continue
            some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            i, j = at[: len(i)], at[len(i) :]
            t = t.take(pa.array(some))
            sets = [np.frombuffer(x, np.uint64) for x in t["grams"].to_pylist()]
            size, both = np.array([len(s) for s in sets], np.float64), shared_counts(sets)[i, j].astype(np.float64)
            alike = both >= threshold * (size[i] + size[j] - both) - 1e-9
            i, j = i[alike], j[alike]
            if len(i):
                node, copies = t["node"].to_pylist(), t["copies"].to_numpy()
                links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
                lab, linked = roots(len(node), i, j), np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array([node[k] for k in linked], pa.binary()), pa.array(links[linked].astype(np.int64)), pa.array([node[k] for k in lab[linked]], pa.binary())], ["node", "links", "root"])

    out = materialise(spark, met.mapInArrow(run, "node binary, links long, root binary"), "links")
    used_up(spark, wanted)
    return out


def jaccard_join(spark: SparkSession, docs: DataFrame, *, doc_id="doc_id", text="text", threshold=THRESHOLD, bands=BANDS, rows=ROWS, tolerance=TOLERANCE, block=BLOCK, signature_block=SIGNATURE_BLOCK) -> DataFrame:
    """(doc_id, dk, class_key, class_id, n_links) for every row; class_key is null for texts without words."""
    bands_and = {"threshold": threshold, "bands": bands, "rows": rows, "tolerance": tolerance}
    drawn = sketch(spark, docs, doc_id=doc_id, text=text, bands=bands, rows=rows)
    nodes = drawn.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("dk").alias("dk"), F.count("*").alias("copies"), F.min("sig").alias("sig"))
    nodes = materialise(spark, nodes, "nodes")
    edges = materialise(spark, candidates(spark, nodes, **bands_and, block=signature_block), "candidates")
    groups = materialise(spark, connected_components(spark, edges), "groups")
    sizes = materialise(spark, groups.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    members = materialise(spark, groups.join(sizes, "root").join(nodes.drop("doc_id"), "node"), "members")
    links = verified(spark, docs, members, doc_id=doc_id, text=text, **bands_and, block=block)
    used_up(spark, edges, groups, sizes, members)
    classes = connected_components(spark, links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = materialise(spark, classes.withColumnRenamed("root", "class_key"), "classes")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.drop("sig", "dk").join(classes, "node", "left").join(counted, "node", "left")
    known = known.select("node", "doc_id", F.coalesce("class_key", "node").alias("class_key"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = materialise(spark, known, "known")
    least = materialise(spark, known.groupBy("class_key").agg(F.min("doc_id").alias("class_id")), "least-ids")
    told = materialise(spark, known.drop("doc_id").join(least, "class_key"), "told")
    used_up(spark, nodes, links, classes, known, least)
    drawn = drawn.select("doc_id", "dk", "node")
    out = drawn.where("node IS NOT NULL").join(told, "node").select("doc_id", "dk", "class_key", "class_id", F.col("n_links").cast("long").alias("n_links"))
    none = drawn.where("node IS NULL").select("doc_id", "dk", F.lit(None).cast("binary").alias("class_key"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(none)


def keep_one(spark: SparkSession, docs: DataFrame, *, doc_id="doc_id", text="text", **options) -> DataFrame:
    """``docs`` with one row of each class: that of the least id (then text); rows without words all stay. Only texts
    that may go, or repeat, by a sieve of their keys, are shuffled."""
    joined = materialise(spark, jaccard_join(spark, docs, doc_id=doc_id, text=text, **options).where("class_key IS NOT NULL"), "joined")
    best = joined.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "dk"))["dk"].alias("kept"))
    best = materialise(spark, best, "best")
    lost = materialise(spark, joined.join(best, "class_key").where(F.col("dk") != F.col("kept")).select("dk").distinct(), "lost")
    twice = joined.groupBy("dk").count().where("count > 1").select("dk")
    twice = materialise(spark, twice.join(lost, "dk", "left_anti"), "twice")
    used_up(spark, joined, best)
    either = lost.unionByName(twice)
    d = sifted(docs.withColumn("__dk", row_key(doc_id, text)), "__dk", sieve(spark, either, "lost"))
    asked = d.where("__may").join(either.withColumnRenamed("dk", "__dk"), "__dk", "left_anti")
    out = d.where("NOT __may").unionByName(asked)
    if twice.count():  # repeated rows of what is kept
        out = out.unionByName(d.where("__may").join(twice.withColumnRenamed("dk", "__dk"), "__dk", "left_semi").dropDuplicates(["__dk"]))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")
