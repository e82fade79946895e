"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded texts, with exception phrases.

Folding: compatibility forms, lower case, zero-width characters dropped, homoglyphs of Latin letters replaced, digits
and signs inside words read as the letters they stand for; words then stand between single spaces. The lexicon starts
from common insults. From a bounded sample of labelled rows it learns further words and word beginnings, weighted by
their log odds, and corrects the weights of the given ones. A match inside an exception phrase does not count. The
summed weights, normalised by the length of the text, go through a logistic curve fitted on the same sample.

Learned from at most ``max_train_rows`` labelled rows (in expectation, by a hash of the id) of the training folds;
labels, language, source and id are never inputs. Null, empty and wordless texts match nothing and get the score of no
match. Repeated rows get equal scores. Without labels of both kinds the given lexicon and a fixed curve are used. Whole
texts are matched, however long. Ties: of terms with equal counts the first by name is learned, of matches at one place
the longest counts, of near copies in the sample the least text. Empty tables: no rows to score, the given lexicon. A
column ``toxicity`` of the caller is replaced, others are kept.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, hash_share, held_out, sliced, with_fields

MAX_TRAIN_ROWS = 20_000
MAX_TERMS = 4_000
LEAST_DOCS = 5
PREFIXES = (4, 5, 6)
CUT = 0.5
LEXICON = {"idiot": 3.0, "moron": 3.0, "stupid": 2.5, "loser": 2.0, "scum": 3.0, "trash": 1.5, "clown": 1.5, "pathetic": 2.0, "worthless": 2.0, "disgusting": 2.0, "imbecile": 3.0, "dumb": 2.0, "jerk": 2.0, "bastard": 3.0, "filth": 2.0, "vermin": 2.5}
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "sore loser", "idiot proof", "clown fish", "pond scum")
#: Letters that look like a Latin one.
HOMOGLYPHS = str.maketrans("аеорсухіјѕһԁԛԝɡαοιυνκτρεϲʏ", "aeopcyxijshdqwgaoiuvktpecy")
ODD = re.compile("[а-ԯɡα-ϿʏІЈЅ\u00ad\u200b-\u200f\u2060\ufeff]")
DROPPED = dict.fromkeys([0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF])
DIGITS = str.maketrans("0134578@$", "oieastbas")
MIXED = re.compile(r"(?<![^\W_])(?=[\w@$]*[^\W\d_])[^\W_]*[013-578@$][\w@$]*[^\W\d_](?![^\W_])")


def folded(text: str | None) -> str:
    """' word word ... ' in folded form."""
    t = text or ""
    if not t.isascii() and not unicodedata.is_normalized("NFKC", t):
        t = unicodedata.normalize("NFKC", t)
    t = t.lower()
    if not t.isascii() and ODD.search(t):
        t = t.translate(DROPPED).translate(HOMOGLYPHS)
    t = MIXED.sub(lambda m: m[0].translate(DIGITS), t)
    return f" {' '.join(WORD.findall(t))} "


class Model:
    """Terms: ' word ' or ' beginning', with weights; exceptions: ' phrase '. Curve: (a, b) of a + b * density."""

    def __init__(self, terms: dict[str, float], exceptions=EXCEPTIONS, curve=(-2.0, 4.0)):
        self.terms, self.exceptions, self.curve, self.automaton = terms, [f" {' '.join(WORD.findall(x))} " for x in exceptions], curve, None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def matches(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, term) in a folded text: of matches at one place the longest, none inside an exception."""
        import ahocorasick

        if self.automaton is None:
            a = ahocorasick.Automaton()
            for x in [*self.terms, *self.exceptions]:
                a.add_word(x, x)
            a.make_automaton()
            self.automaton = a
        found, out, hidden = [(e + 1 - len(x), e + 1, x) for e, x in self.automaton.iter(text)], {}, []
        for s, e, x in found:
            if x not in self.terms:
                hidden.append((s, e))
            elif s not in out or e > out[s][1]:
                out[s] = s, e, x
        return [m for m in out.values() if not any(s <= m[0] and m[1] <= e for s, e in hidden)]

    def density(self, text: str | None) -> float:
        t = folded(text)
        w = sum(self.terms[x] for _, _, x in self.matches(t)) if len(t) > 2 else 0.0
        return float(np.log1p(100 * w / np.sqrt(20 + t.count(" ") - 1))) if w else 0.0

    def score(self, text: str | None) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a + b * self.density(text)))))


def _sketch(text: str) -> int:
    """The least hash of five words in a row; near copies mostly share it."""
    w = text.split()
    return min(zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4)))


def _terms(text: str) -> set[str]:
    words = set(text.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) >= n}


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, *, max_train_rows=MAX_TRAIN_ROWS, lexicon=LEXICON, exceptions=EXCEPTIONS) -> Model:
    """Lexicon and curve from (doc_id, text) and (doc_id, label)."""
    train = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(label).cast("int").alias("y"))
    n = train.count()
    if n:
        train = train.where(hash_share(F.col("doc_id"), max_train_rows / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").select("text", "y")  # two numbers for each of max_train_rows rows

    def fold_rows(batches):
        for batch in sliced(batches):
            texts = [folded(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch["y"], pa.array([_sketch(t) for t in texts], pa.int64())], ["text", "y", "sketch"])

    # copies of one text would make all its words look telling
    rows = rows.mapInArrow(fold_rows, "text string, y int, sketch long").groupBy("sketch", "y").agg(F.min("text").alias("text")).select("text", "y").persist()

    def count(batches):
        sums = Counter(), Counter()
        for batch in sliced(batches):
            for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), strict=True):
                sums[y > 0].update(_terms(text))
                sums[y > 0].update([""])
        terms = list(sums[0].keys() | sums[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([sums[0][t] for t in terms], pa.int64()), pa.array([sums[1][t] for t in terms], pa.int64())], ["term", "clean", "toxic"])

    sums = rows.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).persist()
    whole = sums.where("term = ''").first()
    base = Model({f" {w} ": v for w, v in lexicon.items()}, exceptions)
    if not whole or not whole["clean"] or not whole["toxic"]:
        sums.unpersist()
        rows.unpersist()
        return base
    odds = F.log((F.col("toxic") + 0.5) / (whole["toxic"] + 1.0)) - F.log((F.col("clean") + 0.5) / (whole["clean"] + 1.0))
    given = sums.where(F.col("term").isin([f" {w} " for w in lexicon]))
    telling = sums.where((F.col("term") != "") & (F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") >= 9 * F.col("clean")))
    best = telling.orderBy(F.desc("toxic"), "term").limit(MAX_TERMS)
    terms = dict(base.terms)
    terms |= {r["term"]: max(0.0, r["w"]) for r in given.select("term", odds.alias("w")).collect()}
    starts: set[str] = set()
    for r in sorted(best.select("term", odds.alias("w")).collect(), key=lambda r: len(r["term"])):
        if not any(r["term"].startswith(s) for s in starts):  # else a learned beginning matches it
            terms[r["term"]] = r["w"]
            if r["term"][-1] != " ":
                starts.add(r["term"])
    sums.unpersist()
    model = Model(terms, exceptions)
    shared = spark.sparkContext.broadcast(model)  # MAX_TERMS terms and the given ones

    def densities(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array([shared.value.density(t) for t in batch["text"].to_pylist()], pa.float64()), batch["y"]], ["d", "y"])

    got = rows.mapInArrow(densities, "d double, y int").toArrow()  # max_train_rows at most
    rows.unpersist()
    model.curve = _curve(got["d"].to_numpy(), (got["y"].to_numpy() > 0).astype(float))
    return model


def _curve(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one input, by Newton steps with a small ridge."""
    x, w = np.stack([np.ones_like(d), d], 1), np.array([-2.0, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.5 * np.eye(2), x.T @ (p - y) + 0.5 * np.array([0, w[1]]))
    return float(w[0]), float(w[1])


def score(spark: SparkSession, docs: DataFrame, model: Model, text="text") -> DataFrame:
    """``docs`` with ``toxicity``; an existing column of that name is replaced."""
    d = docs.drop("toxicity")
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([shared.value.score(t) for t in batch[text].to_pylist()], pa.float64())], [*batch.schema.names, "toxicity"])

    return d.mapInArrow(run, with_fields(d.schema, toxicity="double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic")
    out = score(spark, docs, model)
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= CUT).cast("int").alias("predicted"))
