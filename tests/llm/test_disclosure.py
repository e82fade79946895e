"""Disclosing terms against a brute-force reckoning of every pair; long runs in linear time."""

import math
import random
import re
import time
from collections import defaultdict

import xxhash

from lodestone.llm import op3_pii as P

MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def sketches(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [xxhash.xxh64(" ".join(w[k : k + 5]).encode(), seed=42).intdigest() for k in range(max(1, len(w) - 4))]
    return [min(signed(xxhash.xxh64(r.to_bytes(4, "little"), seed=xxhash.xxh64(x.to_bytes(8, "little"), seed=42).intdigest()).intdigest()) for x in h) for r in range(P.SKETCHES)]


def brute(rows):
    """{row: [(start, end)]} of disclosing terms; entities are e-mail addresses alone."""
    texts = [t or "" for _, t in rows]
    blank = [MAIL.sub(lambda m: " " * len(m[0]), t) for t in texts]
    forms = [set(re.findall(r"[^\W\d_]{3,}", b)) for b in blank]
    terms = [{f.lower() for f in x} for x in forms]
    entities = [{m.lower() for m in MAIL.findall(t)} for t in texts]
    sk = {t: sketches(t) for t in texts}

    def tk(e, text):
        """Which of the entity's texts this one counts as."""
        own = [sk[t] for t, x in zip(texts, entities, strict=True) if e in x]
        return min(s[0] for s in own if any(a == b for a, b in zip(s, sk[text], strict=True)))

    n, df, de, dp = len(rows), defaultdict(int), defaultdict(int), defaultdict(int)
    te, tp = defaultdict(set), defaultdict(set)
    for k in range(n):
        for t in terms[k]:
            df[t] += 1
        for e in entities[k]:
            de[e] += 1
            te[e].add(tk(e, texts[k]))
            for t in terms[k]:
                dp[e, t] += 1
                tp[e, t].add(tk(e, texts[k]))
    kept, wide = {}, set()
    # pairs with terms that no entity could reach the share with are not tried
    most = max(de.values(), default=0) ** P.GENERALISE * n ** (1 - P.GENERALISE) * 1.001
    places = sum(df.values())
    tried = sum(not (df[t] >= places / P.COMMON and df[t] > most) for _, t in dp)
    for (e, t), both in dp.items():
        ic = math.log(n / de[e])
        if ic <= 0:
            continue
        share = 1 + math.log(both / df[t]) / ic
        k = len(tp[e, t])
        m = len(te[e]) * (df[t] - both + k) / (n - de[e] + len(te[e]))
        if share < P.GENERALISE or k <= m:
            continue
        gain = k * math.log(k / m) - k + m
        if gain >= P.SURPRISE:
            kept[e, t] = "remove" if share >= P.REMOVE else "generalise"
            if gain >= P.SURPRISE + math.log(tried):
                wide.add(t)
    out = []
    for k in range(n):
        hot = wide | {t for e, t in kept if e in entities[k]}
        out.append([(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", blank[k]) if m[0].lower() in hot])
    return out


def test_terms_like_brute_force(spark, tmp_path):
    rng = random.Random(8)
    common = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6))) for _ in range(60)]
    rows = []
    for k in range(700):
        w = [rng.choice(common) for _ in range(rng.randint(3, 25))]
        if k % 9 == 0:
            p = rng.randrange(12)
            w += [f"jo{p}@ex.org", f"Surname{chr(97 + p)}"] + ([f"Town{chr(97 + p)}"] if rng.random() < 0.7 else [])
            rng.shuffle(w)
        elif k % 50 == 1:
            w.append(f"surname{chr(97 + rng.randrange(12))}")
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, rows[9][1]) for k in range(5)] + [(2000, None), (2001, ""), (9, rows[9][1]), (None, "x jo1@ex.org y"), (None, "Surnameb alone")]
    spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_term string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r["doc_id"]), tuple(x for x in r["spans"].split(",") if x.startswith("term:")), r["n_term"]) for r in P.query(spark, str(tmp_path)).collect())
    spans = brute(rows)
    want = sorted((str(d), tuple(f"term:{a}:{b}" for a, b in s), len(s)) for (d, _), s in zip(rows, spans, strict=True))
    assert got == want
    assert sum(map(len, spans)) > 50


def test_sketches(spark):
    from pyspark.sql import functions as F

    texts = ["one Two three four five six, seven", "a b", "été 12 — no_1 x y z"]
    got = [r["s"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.sketch(F.col("t")).alias("s")).collect()]
    assert got == [sketches(t) for t in texts]


def test_near_copies_are_no_evidence_elsewhere(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(300)] + ["jo@ex.org"]
    rows = []
    for k in range(9):
        w = list(base)
        w[rng.randrange(300)] = word()
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join([word() for _ in range(5)] + [base[k % 300]])) for k in range(900)]
    out = {r["doc_id"]: r["text"] for r in P.sanitise(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(out[d] != t for d, t in rows[9:]) == 0


def test_long_runs_take_linear_time(spark):
    texts = ["9" * 1_000_000 + " a@b.co", "1." * 200_000, "a@b.co " * 20_000, "+1 " * 200_000, "1 " * 300_000, "@" * 300_000, "a." * 300_000 + "@"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").cache()
    docs.count()
    began = time.perf_counter()
    n = {r["dk"]: len(r["spans"]) for r in P.find(spark, docs).collect()}
    assert time.perf_counter() - began < 40
    assert sorted(n.values())[-2:] == [20_000, 50_000]
