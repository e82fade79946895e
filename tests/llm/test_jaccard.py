"""The join against all pairs compared by brute force, blocks of every size, awkward rows."""

import random

import numpy as np
import pytest

from lodestone.llm import op1_jaccard as J


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            w = (rng.choice(texts) or "x").split()
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(word() for _ in range(rng.choice((1, 3, 30, 80, 200)))))
    return texts


def brute(rows):
    """(doc_id, class_id, n_links) of every row."""
    sets = [set(J.shingles(J.words_of(t)).tolist()) for _, t in rows]
    link = [[i != j and bool(a) and len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                k = todo.pop()
                for j in range(len(rows)):
                    if link[k][j] and j not in group:
                        group.add(j)
                        todo.append(j)
            seen |= group
            least = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
            for k in group:
                out[k] = (rows[k][0], least, sum(link[k]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "signature_block"), [(1024, 2048), (5, 7)])
def test_against_brute_force(spark, block, signature_block):
    texts = [*corpus(), None, "", " .. ", "one", "One!", "x " * 3000, None]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[5]), (None, "alone here")]
    docs = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, node string")
    got = J.jaccard_join(spark, docs, block=block, signature_block=signature_block).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_keep_one(spark):
    rows = [(2, "a b c d e f"), (1, "A b c, d e f"), (3, None), (4, ""), (1, "A b c, d e f"), (9, "other words stand here now"), (9, "other words stand here now"), (None, "a b c d e f")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, dk int")
    got = sorted(((r["doc_id"], r["text"]) for r in J.keep_one(spark, docs).collect()), key=repr)
    assert got == sorted([(1, "A b c, d e f"), (3, None), (4, ""), (9, "other words stand here now")], key=repr)


def test_very_long_texts(spark):
    words = [f"w{k}" for k in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:50_000])), (3, " ".join(words[:30_000])), (4, "short one of five words")]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_join(spark, docs).collect() == []
    assert J.keep_one(spark, docs).collect() == []


def test_pruning_keeps_pairs_at_the_threshold():
    turns, least = J._turns(128), J.least_matches(0.8, J.TOLERANCE, range(32, 129, 32))
    rng = np.random.default_rng(3)
    lost = 0
    for _ in range(300):
        x = rng.integers(0, 1 << 60, 180, np.uint64)
        a, b = J.signature(np.unique(x[:160]), turns), J.signature(np.unique(np.concatenate([x[:140], x[165:180]])), turns)  # 140 of 175
        lost += not len(J.surviving(a[None], b[None], least, False)[0])
    assert lost == 0
    far = J.surviving(J.signature(x[:90], turns)[None], J.signature(x[60:], turns)[None], least, False)
    assert not len(far[0])


def test_components(spark):
    from lodestone.llm.components import connected_components

    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(500, 500), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
