"""Which texts of an entity count as one: near copies do, texts with a sentence in common don't."""

import random

from pyspark.sql import functions as F

from lodestone.llm import op3_pii as P


def words(rng, n):
    return ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(4, 9))) for _ in range(n)]


def test_a_sentence_in_common_is_no_copy(spark):
    rng = random.Random(5)
    shared = "Quagga sends all of the old letters on to jo@ex.org before noon"
    rows = [(k, " ".join([*words(rng, 40), shared, *words(rng, 40)])) for k in range(4)]
    rows += [(100 + k, " ".join(["all of the old letters on before noon", *words(rng, 5)])) for k in range(600)] + [(900, "alone stands Quagga")]
    out = {r["doc_id"]: r["text"] for r in P.sanitise(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any("Quagga" in out[k] for k in (0, 1, 2, 3, 900))  # four different texts tell, everywhere
    assert all(out[k] == t for k, t in rows[4:-1])


def test_much_changed_copies_are_one(spark):
    rng = random.Random(6)
    base = words(rng, 300)
    rows = []
    for k in range(6):  # every tenth word or so is another one: few runs of five stay, most words do
        w = [x if rng.random() > 0.1 else words(rng, 1)[0] for x in base]
        rows.append((k, " ".join([*w[:150], "jo@ex.org", *w[150:]])))
    rows += [(100 + k, " ".join([*words(rng, 5), base[k % 300]])) for k in range(600)]
    out = {r["doc_id"]: r["text"] for r in P.sanitise(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(out[k] != t for k, t in rows[6:]) == 0


def test_near(spark):
    rows = [(list(range(10)), list(range(10)), True), (list(range(10)), list(range(3, 13)), True), (list(range(10)), list(range(4, 14)), False), ([1, 2, 3, 4], [1, 2, 3, 4], False), ([], [], False)]
    rows += [(list(range(256)), list(range(256)), True), (list(range(0, 768, 3)), list(range(256)), False)]
    got = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, want boolean").select("want", P.near(F.col("a"), F.col("b")).alias("near")).collect()
    assert [r["near"] for r in got] == [r["want"] for r in got]
