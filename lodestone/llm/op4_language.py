"""Language identification by error-correcting output codes.

Each learned language gets a codeword. For every bit a binary classifier over hashed character trigrams is made: its
weights are the log ratios of the mean profiles of the languages with that bit set and of those without. A text's mean
weight, centred and scaled by how the languages themselves fall on that bit, goes into an exponential loss; bits that
separate the languages better weigh more. The language with the least loss is chosen; if the second is nearer than
``tie`` the row is flagged ambiguous. A row is rejected if it has no letter, or if it is ambiguous and even its least loss
is beyond all that the learned rows of their own language had: such a text is near no codeword.

Learned from at most ``max_train_rows`` labelled rows (in expectation; a hash of the id chooses them), an equal number for
each language, so that rare ones stay. Null text, or a text without letters: ``und``, score 0. No labelled rows at all:
``und`` for all, and only texts without letters are rejected. Up to 5 languages get the exhaustive code, more get the best
of some random ones. Ties go to the first language by name. Repeated rows and null ids are scored like any other (null ids
are held out). Whole texts are used, however long. Empty table: no rows. Columns of the caller that have the names of new
ones are replaced.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_share, held_out, sliced, with_fields

BUCKETS = 1 << 14
MAX_TRAIN_ROWS = 20_000
TIE = 0.02


@functools.cache
def _letters() -> np.ndarray:
    """Code point, or a space for what isn't a letter, for the first plane."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(1 << 16)), np.uint32, 1 << 16)


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the letter trigrams (spaces at the edges) of a text; those of spaces alone are left out."""
    cps = np.frombuffer(f"  {(text or '').lower()}  ".encode("utf-32-le", "replace"), np.uint32)
    high = cps >= 1 << 16
    cps = _letters()[np.where(high, 32, cps)] if not high.any() else np.where(high, [c if chr(c).isalpha() else 32 for c in cps.tolist()], _letters()[np.where(high, 32, cps)]).astype(np.uint32)
    a, b, c = cps[:-2], cps[1:-1], cps[2:]
    h = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) + c * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(18))[b != 32].astype(np.int32)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all splits of up to 5 languages, else the random code of the largest least distance."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[::-1, None]) & 1, 1.0, -1.0)
    rng, best, found = np.random.default_rng(7), -1, None
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        d = ((m[:, None, :] != m[None, :, :]).sum(2) + 1000 * np.eye(n)).min()
        if d > best and (abs(m.sum(0)) < n).all():
            best, found = d, m
    return found


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: langs x BUCKETS."""
        self.langs, self.code = langs, codewords(len(langs))
        p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1])
        self.weights = np.zeros((counts.shape[1], self.code.shape[1]), np.float32)
        self.centre, self.scale, self.worth = (np.ones(self.code.shape[1]) for _ in range(3))
        for b, bits in enumerate(self.code.T):
            if len(langs) < 2:
                continue
            w = np.log(p[bits > 0].mean(0) / p[bits < 0].mean(0))
            means = p @ w
            low, high = means[bits > 0].min(), means[bits < 0].max()
            self.weights[:, b], self.centre[b], self.scale[b] = w, (low + high) / 2, max((low - high) / 2, 1e-3)
            self.worth[b] = max(low - high, 1e-3)
        self.worth /= self.worth.sum()
        self.limit = float("inf")

    def loss(self, grams: np.ndarray) -> np.ndarray:
        z = (self.weights[grams].mean(0) - self.centre) / self.scale
        return (self.worth * np.exp(-self.code * np.clip(z, -4, 4))).sum(1)

    def decode(self, text: str | None, tie: float = TIE) -> tuple[str, float, bool, bool]:
        """(language, score, ambiguous, rejected)"""
        grams = trigrams(text)
        if not len(grams) or not self.langs:
            return "und", 0.0, True, not len(grams)
        loss = self.loss(grams)
        sure = np.exp(-3 * min(1.0, len(grams) / 40) * (loss - loss.min()))
        k = int(loss.argmin())
        rest = np.delete(loss, k)
        ambiguous = bool(len(rest) and rest.min() - loss[k] < tie)
        return self.langs[k], float(sure[k] / sure.sum()), ambiguous, ambiguous and bool(loss[k] > self.limit)


def fit(spark: SparkSession, docs: DataFrame, *, max_train_rows=MAX_TRAIN_ROWS) -> Model:
    """Learn from (text, lang) of rows of the training folds; the sums that reach the driver are langs x BUCKETS."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)))
    shares = spark.createDataFrame([(k, max_train_rows / len(sizes) / n) for k, n in sizes.items()], "lang string, __share double")
    rows = rows.join(F.broadcast(shares), "lang").where(hash_share(F.col("doc_id").cast("string"), F.col("__share"))).select("text", "lang").persist()

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in sliced(batches):
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                s = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                s += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, s in sums.items():
            at = s.nonzero()[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(s[at])], ["lang", "bucket", "n"])

    sums = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("at")).orderBy("lang").collect()  # BUCKETS entries a language at most
    counts = np.zeros((len(found), BUCKETS))
    for k, r in enumerate(found):
        counts[k, [x["bucket"] for x in r["at"]]] = [x["n"] for x in r["at"]]
    model = Model([r["lang"] for r in found], counts)

    def losses(batches):
        most = 0.0
        for batch in sliced(batches):
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                if len(grams := trigrams(text)):
                    loss = model.loss(grams)
                    if model.langs[int(loss.argmin())] == lang:
                        most = max(most, float(loss.min()))
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["most"])

    model.limit = rows.mapInArrow(losses, "most double").agg(F.max("most")).first()[0] or float("inf")
    rows.unpersist()
    return model


def identify(spark: SparkSession, docs: DataFrame, model: Model, text="text") -> DataFrame:
    """``docs`` with lang_pred, lang_score, lang_ambiguous and lang_rejected; existing columns of these names are replaced."""
    new = {"lang_pred": pa.string(), "lang_score": pa.float64(), "lang_ambiguous": pa.bool_(), "lang_rejected": pa.bool_()}
    kept = [c for c in docs.columns if c not in new]
    shared = spark.sparkContext.broadcast(model)  # langs x bits x BUCKETS floats: a fixed size

    def run(batches):
        m = shared.value
        for batch in sliced(batches):
            got = [m.decode(t) for t in batch[text].to_pylist()] or [("", 0.0, False, False)]
            cols = [pa.array(c, kind).slice(0, batch.num_rows) for c, kind in zip(zip(*got, strict=True), new.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *new])

    d = docs.select(*kept)
    return d.mapInArrow(run, with_fields(d.schema, lang_pred="string", lang_score="double", lang_ambiguous="boolean", lang_rejected="boolean"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(spark, docs.select("doc_id", "text"), fit(spark, docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"), F.col("lang_rejected").alias("rejected"))
