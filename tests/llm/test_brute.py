"""The classifiers, the packing and the index against plain versions on one machine."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import op2_quality, op4_language, op5_media, op6_records, op9_packing, op10_toxicity

D = "/root/testdata/sf0.001"


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    return docs, [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{D}/labels.parquet").collect()]


def test_quality_like_one_machine(spark, rows):
    docs, labels = rows
    stats = {d: np.array(op2_quality.statistics(t), np.float32).astype(float) for d, t, _ in docs}
    train = [(stats[d], q) for d, q, _ in labels if q is not None and d in stats and not held(d)]
    x, y = np.array([s for s, _ in train]), np.array([q for _, q in train], float)
    m = op2_quality.Model(x.mean(0), np.maximum(x.std(0), 1e-6))
    z = m.features(x)
    a = z.T @ z
    m.weights = np.linalg.inv(a + op2_quality.RIDGE * a.trace() / len(a) * np.eye(len(a))) @ z.T @ y
    s = np.array(sorted(zip((z @ m.weights).tolist(), y.tolist(), strict=True)))
    n, total = len(s), np.concatenate([[0], np.cumsum(s[:, 1])])
    mean = lambda a, b: (total[b + 1] - total[a]) / (b + 1 - a)
    level = [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
    pools = [[k for k in range(n) if abs(level[k] - v) < 1e-12] for v in sorted(set(np.round(level, 12)))]
    m.at, m.level = [s[p, 0].mean() for p in pools], [level[p[0]] for p in pools]
    got = {r["doc_id"]: r for r in op2_quality.query(spark, D).collect()}
    assert len(got) == len(docs)
    for d, _, _ in docs:
        assert got[d]["score"] == pytest.approx(float(m.score(stats[d][None])[0]), abs=1e-3)
        assert got[d]["held_out"] == held(d)


def plain_trigrams(text):
    t = "  " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + "  "
    out = []
    for a, b, c in zip(map(ord, t), map(ord, t[1:]), map(ord, t[2:]), strict=False):
        if b != 32:
            h = (a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) & 0xFFFFFFFF
            h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
            out.append(h >> 18)
    return out


def test_language_like_one_machine(spark, rows):
    docs, _ = rows
    langs = sorted({g for d, t, g in docs if g is not None and t is not None and not held(d)})
    counts = {g: Counter() for g in langs}
    for d, t, g in docs:
        if g is not None and t is not None and not held(d):
            counts[g].update(plain_trigrams(t))
    p = {g: [(c[b] + 0.5) / (sum(c.values()) + 0.5 * op4_language.BUCKETS) for b in range(op4_language.BUCKETS)] for g, c in counts.items()}
    code = op4_language.codewords(len(langs))
    bits = []
    for column in code.T:
        plus, minus = [g for g, v in zip(langs, column, strict=True) if v > 0], [g for g, v in zip(langs, column, strict=True) if v < 0]
        w = [math.log((sum(p[g][b] for g in plus) / len(plus)) / (sum(p[g][b] for g in minus) / len(minus))) for b in range(op4_language.BUCKETS)]
        mean = {g: sum(map(lambda a, b: a * b, p[g], w)) for g in langs}
        low, high = min(mean[g] for g in plus), max(mean[g] for g in minus)
        bits.append((w, (low + high) / 2, max((low - high) / 2, 1e-3), max(low - high, 1e-3)))
    worth = sum(b[3] for b in bits)
    want = {}
    for d, t, _ in docs:
        grams = plain_trigrams(t)
        if not grams:
            want[d] = ("und",)
            continue
        z = [max(-4, min(4, (sum(w[g] for g in grams) / len(grams) - c) / s)) for w, c, s, _ in bits]
        loss = sorted((sum(b[3] / worth * math.exp(-v * x) for b, v, x in zip(bits, word, z, strict=True)), g) for word, g in zip(code, langs, strict=True))
        want[d] = tuple(g for v, g in loss if v - loss[0][0] < 1e-4)
    got = op4_language.query(spark, D).collect()
    assert len(got) == len(docs)
    assert all(r["lang_pred"] in want[r["doc_id"]] for r in got)


def test_language_ties_and_rejection(spark):
    model = op4_language.Model(["aa", "bb"], np.ones((2, op4_language.BUCKETS)))
    assert model.decode("some words")[0] == "aa"
    assert model.decode("some words")[2]
    model.limit = 0.0
    assert model.decode("some words")[3]
    assert model.decode("12")[3]
    docs = spark.createDataFrame([(1, "words", None, 1), (2, "12", "en", 2)], "doc_id long, text string, lang string, lang_pred int")
    out = op4_language.identify(spark, docs, op4_language.fit(spark, docs.limit(0))).orderBy("doc_id").collect()
    assert [(r["lang_pred"], r["lang_rejected"]) for r in out] == [("und", False), ("und", True)]


def test_rare_languages_stay(spark):
    rows = [(k, "the words of this text are english", "en") for k in range(400)] + [(1000 + k, "les mots de ce texte sont bien choisis", "fr") for k in range(6)]
    model = op4_language.fit(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_train_rows=40)
    assert model.langs == ["en", "fr"]


def test_toxicity_like_one_machine(spark, rows):
    docs, labels = rows
    T = op10_toxicity
    texts = {d: T.folded(t) for d, t, _ in docs}
    least = {}
    for d, _, tox in labels:
        if tox is not None and d in texts and not held(d):
            w = texts[d].split()
            sketch = min(zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4)))
            key = sketch, int(tox)
            least[key] = min(least.get(key, texts[d]), texts[d])
    clean, toxic, n = Counter(), Counter(), Counter()
    for (_, y), t in least.items():
        n[y > 0] += 1
        (toxic if y else clean).update({f" {w} " for w in t.split()} | {f" {w[:k]}" for w in t.split() for k in T.PREFIXES if len(w) >= k})
    odds = lambda x: math.log((toxic[x] + 0.5) / (n[True] + 1)) - math.log((clean[x] + 0.5) / (n[False] + 1))
    terms = {f" {w} ": v for w, v in T.LEXICON.items()}
    terms |= {x: max(0.0, odds(x)) for x in terms if toxic[x] + clean[x]}
    best = sorted((x for x in toxic if toxic[x] >= T.LEAST_DOCS and toxic[x] >= 9 * clean[x]), key=lambda x: (-toxic[x], x))[: T.MAX_TERMS]
    starts = []
    for x in sorted(best, key=len):
        if not any(x.startswith(s) for s in starts):
            terms[x] = odds(x)
            if not x.endswith(" "):
                starts.append(x)

    def density(t):
        hidden = [(i, i + len(e) + 2) for e in T.EXCEPTIONS for i in range(len(t)) if t.startswith(f" {e} ", i)]
        w = 0.0
        for i in range(len(t)):
            here = [x for x in terms if t.startswith(x, i)]
            if here and t[i] == " ":
                x = max(here, key=len)
                w += 0 if any(a <= i and i + len(x) <= b for a, b in hidden) else terms[x]
        return math.log1p(100 * w / math.sqrt(20 + t.count(" ") - 1)) if w else 0.0

    small = [d for d, t, _ in docs if len(t or "") < 700][:40]
    got = {r["doc_id"]: r["score"] for r in T.query(spark, D).collect()}
    assert len(got) == len(docs)
    curve = T._curve(np.array([density(t) if len(t) > 2 else 0.0 for t in (x for _, x in sorted(least.items()))]), np.array([float(y > 0) for (_, y), _ in sorted(least.items())]))
    for d in small:
        assert got[d] == pytest.approx(1 / (1 + math.exp(-(curve[0] + curve[1] * density(texts[d])))), abs=1e-4)


def test_toxicity_held_out(spark):
    big = "/root/testdata/sf0.01"
    got = op10_toxicity.query(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out")
    assert got.where("predicted = toxic").count() >= 0.95 * got.count()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, score int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for q in (op2_quality, op4_language, op5_media, op9_packing, op10_toxicity):
        assert q.query(spark, str(tmp_path)).collect() == []


def test_repeated_rows_score_alike(spark, tmp_path):
    rows = [(1, "some words of a text that repeats"), (1, "some words of a text that repeats"), (None, "some words of a text that repeats"), (2, None), (3, "")]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, toxicity string, x int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{D}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    for q in (op2_quality, op10_toxicity):
        got = [r["score"] for r in q.query(spark, str(tmp_path)).orderBy(F.col("doc_id").isNull(), "doc_id").collect()]
        assert len(got) == 5
        assert got[0] == got[1] == got[4]
        assert got[2] == got[3]


# --- packing


def plain_pack(lengths, caps, overhead, square):
    """The same rules, every bin looked at."""
    price = lambda used: next(overhead + c + c * c / square for c in caps if c >= used)

    def run(choose):
        order, bins, of = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)), [], {}
        filled = []  # (capacity, contents, when it was last filled)
        for step, i in enumerate(order):
            n = lengths[i]
            fits = [b for b in range(len(filled)) if filled[b][0] - filled[b][1] >= n]
            if fits:
                b = min(fits, key=lambda b: (filled[b][0] - filled[b][1], -filled[b][2]))
            else:
                b = len(filled)
                filled.append([choose(n, [lengths[j] for j in order[step + 1 :]]), 0, 0])
            of[i] = b, filled[b][1]
            filled[b][1] += n
            filled[b][2] = step
        return sum(price(f[1]) for f in filled), of, [next(c for c in caps if c >= f[1]) for f in filled]

    def least_cost(n, rest):
        def rate(c):
            room = c - n
            for x in rest:
                if x <= room:
                    room -= x
            return price(c - room) / (c - room), c

        return min(rate(c) for c in caps if c >= n)[1]

    rules = [least_cost] + [lambda n, _, least=least: next(c for c in caps if c >= max(n, least)) for least in caps]
    best = None
    for r in rules:
        got = run(r)
        if best is None or got[0] < best[0]:
            best = got
    return best


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]


def test_plan_like_plain_rules_and_near_the_optimum():
    rng, ratios = random.Random(6), []
    for _ in range(60):
        lengths = [rng.randint(1, 16) for _ in range(rng.randint(1, 7))]
        of, at, sizes = op9_packing.plan(lengths, (4, 8, 16), 2, 40)
        total, want, caps = plain_pack(lengths, (4, 8, 16), 2, 40)
        assert [(b, o) for b, o in zip(of, at, strict=True)] == [want[i] for i in range(len(lengths))]
        assert sizes == caps
        price = {c: op9_packing.cost(c, 2, 40) for c in (4, 8, 16)}
        least = min(sum(price[next(c for c in (4, 8, 16) if c >= sum(g))] for g in p) for p in partitions(lengths) if all(sum(g) <= 16 for g in p))
        ratios.append(total / least)
    assert max(ratios) < 1.35
    assert sum(r < 1 + 1e-9 for r in ratios) >= 0.6 * len(ratios)


def test_pack_like_plain_rules(spark, tmp_path):
    rng = random.Random(5)
    docs = [(k, " ".join(["w"] * rng.choice((1, 7, 200, 511, 600, 900, 3000, 8192, 20_000)))) for k in range(60)] + [(None, "w w"), (None, "w w"), (7, "x"), (70, None)]
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, copy int").write.parquet(str(tmp_path / "documents.parquet"))
    got = op9_packing.query(spark, str(tmp_path)).collect()
    full = sorted((r for r in got if r["n_tokens"]), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text_key"], r["copy"], r["piece"]))
    caps = op9_packing.CAPACITIES
    _, of, sizes = plain_pack([r["n_tokens"] for r in full], caps, op9_packing.OVERHEAD, op9_packing.SQUARE)
    assert [(r["bin_id"], r["bin_offset"], r["capacity"]) for r in full] == [(*of[i], sizes[of[i][0]]) for i in range(len(full))]
    assert len({(r["doc_id"], r["text_key"], r["copy"], r["piece"]) for r in got}) == len(got)
    assert sum(r["n_tokens"] for r in got) == sum(len((t or "").split()) for _, t in docs)


# --- records by their index


def test_records_in_any_order(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, folder = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/records"
    t = Tokenizer.from_file(path)
    docs = [(k, f"word {k} " * (k % 50)) for k in range(300)] + [(None, "without an id"), (None, None), (0, "again")]
    manifest = op6_records.write_records(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), folder, tokenizer=path)
    index = op6_records.read_index(spark, folder, manifest)
    assert index.count() == len(docs)
    shuffled = index.orderBy(F.xxhash64("doc_id", "start"))
    got = op6_records.fetch(spark, folder, shuffled, 2).collect()
    assert [r["start"] for r in got] == [r["start"] for r in shuffled.collect()] != sorted(r["start"] for r in got)
    want = sorted((str(d), t.encode(x or "", add_special_tokens=False).ids + [1]) for d, x in docs)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == np.cumsum([0, *(len(r["ids"]) for r in by_start[:-1])]).tolist()


# --- pages


def test_pages_keep_their_order(spark, tmp_path):
    docs = [(1, "first line\nsecond <b>line</b> & more\nthird"), (2, "one line"), (3, "\nlate"), (4, None), (5, "a &amp; b\nc")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["pos"], r["caption"]) for r in op5_media.query(spark, str(tmp_path)).collect()}
    assert got == {1: (2, "document 1"), 2: (2, "document 2"), 3: (1, "document 3"), 4: (1, "document 4"), 5: (2, "document 5")}
    pages = op5_media.resolved_pages_query(spark, D)
    assert pages.where("payload_sha256 IS NOT NULL").count() == spark.read.parquet(f"{D}/pages.parquet").count()
