"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Statistics of each whole text (lengths, repetition, shares of kinds of characters, entropy) are standardised and put
through random Fourier features, which approximate a Gaussian kernel. Normal equations are summed over partitions and
solved as a ridge regression on the driver; isotonic regression turns its scores into probabilities of label 1.

Learned from at most ``max_train_rows`` labelled rows (in expectation, chosen by a hash of the id) of the training
folds; labels, language, source and id are never inputs. Null and empty texts have the statistics of an empty text and
get a score like any other. Rows of labels with a null label are not learned from; repeated ones count repeatedly.
Without labels of both kinds every score is 0.5. Repeated rows get equal scores. Whole texts are read, however long. Equal
raw scores share a step of the calibration. Empty tables: no rows to score, scores of 0.5. Further columns of documents are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_share, held_out, materialise, sliced, with_fields

MAX_TRAIN_ROWS = 50_000
FEATURES = 384
RIDGE = 1e-3
TRAIN_PARTS = 16
CUT = 0.3
#: Bytes whose shares are statistics, in groups.
GROUPS = (b".", b",", b"!?", b"|", b"#", b"$", b"%", b"&", b"*", b"-_=+~", b"\"'`", b"()[]{}<>", b"/\\@^", b":;", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n", b" \t")


def statistics(text: str | None) -> list[float]:
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n = max(1, int(raw.sum()))
    share = raw[raw > 0] / n
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    w = max(1, len(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    seen = set(words)
    long = [x for x in words if len(x) > 6]
    return [
        np.log1p(len(words)), np.log1p(len(lines)), np.log1p(n / w), np.log1p(len(seen)) / np.log1p(w), pairs / max(1, w - 1), len(set(lines)) / max(1, len(lines)),
        len(long) / w, len(set(long)) / max(1, len(long)), float(-(share * np.log(share)).sum()), raw[128:].sum() / n,
        np.log1p(w / max(1, len(lines))), *(np.sqrt(raw[list(g)].sum() / n) for g in GROUPS),
    ]


class Model:
    """Standardisation, random features, ridge weights and the steps of the calibration."""

    def __init__(self, mean, spread, features=FEATURES, seed=11):
        rng, k = np.random.default_rng(seed), len(mean)
        self.mean, self.spread = mean, spread
        self.turn, self.shift = rng.normal(0, 1 / np.sqrt(k), (k, features)), rng.uniform(0, 2 * np.pi, features)
        self.weights, self.at, self.level = None, None, None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turn + self.shift), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x), self.at, self.level)


def isotonic(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (mean score, mean label) of each pool, both rising."""
    pools: list[list[float]] = []
    for s, v in sorted(zip(scores.tolist(), y.tolist(), strict=True)):
        pools.append([s, v, 1.0])
        while len(pools) > 1 and (pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2] or pools[-2][0] * pools[-1][2] >= pools[-1][0] * pools[-2][2]):
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    a = np.array(pools)
    return a[:, 0] / a[:, 2], a[:, 1] / a[:, 2]


def document_statistics(spark: SparkSession, docs: DataFrame, *, text="text", doc_id="doc_id") -> DataFrame:
    """(doc_id, x): the statistics of every text, written out."""

    def run(batches):
        for batch in sliced(batches):
            got = [statistics(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(got, pa.list_(pa.float32()))], ["doc_id", "x"])

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return materialise(spark, d.mapInArrow(run, with_fields(d.select("doc_id").schema, x="array<float>")), "statistics")


def fit(stats: DataFrame, labels: DataFrame, label: str, *, max_train_rows=MAX_TRAIN_ROWS) -> Model:
    """``stats`` (doc_id, x) and ``labels`` (doc_id, label 0 or 1); only rows of the training folds are learned from."""
    train = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(label).cast("double").alias("y"))
    n = train.count()
    if n:
        train = train.where(hash_share(F.col("doc_id"), max_train_rows / n))
    train = train.join(stats, "doc_id").select("y", "x").repartition(TRAIN_PARTS).persist()
    k = len(statistics(""))
    moments = train.agg(F.count("*"), F.sum("y"), *(f(F.col("x")[i].cast("double")) for i in range(k) for f in (F.avg, F.stddev_pop))).first()
    if not moments[0] or moments[1] in (0, moments[0]):
        train.unpersist()
        return Model(np.zeros(k), np.ones(k))
    m = np.array(moments[2:], float).reshape(k, 2)
    model = Model(m[:, 0], np.maximum(m[:, 1], 1e-6))

    def sums(batches):
        total = 0
        for batch in sliced(batches):
            if batch.num_rows:
                z = model.features(np.array(batch["x"].to_pylist(), float))
                total = total + z.T @ np.hstack([z, batch["y"].to_numpy()[:, None]])
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["m"])

    total = sum(np.frombuffer(r["m"]).reshape(len(model.shift) + 1, -1) for r in train.mapInArrow(sums, "m binary").collect())  # TRAIN_PARTS matrices at most
    model.weights = np.linalg.solve(total[:, :-1] + RIDGE * total[:, :-1].trace() / len(total) * np.eye(len(total)), total[:, -1])

    def scores(batches):
        for batch in sliced(batches):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(np.array(batch["x"].to_pylist(), float))), batch["y"]], ["s", "y"])

    got = train.mapInArrow(scores, "s double, y double").toArrow()  # max_train_rows at most
    train.unpersist()
    model.at, model.level = isotonic(got["s"].to_numpy(), got["y"].to_numpy())
    return model


def score(spark: SparkSession, stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``stats``."""
    shared = spark.sparkContext.broadcast(model)  # a fixed size

    def run(batches):
        for batch in sliced(batches):
            x = np.array(batch["x"].to_pylist(), float).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(shared.value.score(x) if len(x) else [], pa.float64())], ["doc_id", "score"])

    return stats.mapInArrow(run, with_fields(stats.select("doc_id").schema, score="double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = document_statistics(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model = fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    return score(spark, stats, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
