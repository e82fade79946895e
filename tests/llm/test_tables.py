"""Mixing, packing, records, media and search against brute force; awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lodestone.llm import op5_media, op6_records, op7_mixing, op8_knn, op9_packing, registry

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_same_rows(spark, same_rows, name):
    same_rows(spark, registry.QUERIES[name], registry.ORACLES[name])


# --- mixing


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "b", "b", "b", "c", None]), "w " * rng.randint(0, 9)) for k in range(300)] + [(None, "a", "x y"), (None, "a", "x y"), (7, "d", None), (8, "d", "")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, source string, text string, target double")
    got = op7_mixing.mix(spark, docs, rows_a_range=20).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], abs=1)
    total = sum(r["size"] for r in got)
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * total, abs=4)
    again = op7_mixing.mix(spark, docs.repartition(7), rows_a_range=20).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    out = [r["text"] for r in op7_mixing.mixture(spark, docs).collect()]
    assert sum(len(re.findall(op7_mixing.SPACED, t)) for t in out) == sum(r["taken"] for r in got)


def test_mix_of_long_and_equal_rows(spark):
    rows = [(1, "a", "w " * 200_000)] + [(None, "a", "x y z")] * 50 + [(None, None, f"t{k}") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = op7_mixing.mix(spark, docs).collect()
    for s in ("a", None):
        own = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], abs=1)
    out = op7_mixing.mixture(spark, docs).select("source", "text").collect()
    assert sum(len(r["text"].split()) for r in out) == sum(r["taken"] for r in got)


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert op7_mixing.mix(spark, docs).collect() == []
    assert op7_mixing.mixture(spark, docs).collect() == []
    docs = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert [r["taken"] for r in op7_mixing.mix(spark, docs).collect()] == [0, 0]


# --- packing


def test_packing(spark):
    rng = random.Random(3)
    rows = [(k, "w " * rng.choice((1, 5, 300, 700, 9000, 20_000))) for k in range(60)] + [(3, "w w"), (3, "w w"), (3, "w w"), (None, "w"), (None, None), (5, "")]
    got = op9_packing.pack(spark, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int"), shard_rows=40).collect()
    assert sum(r["n_tokens"] for r in got) == sum(len((t or "").split()) for _, t in rows)
    assert len({(r["doc_id"], r["copy"], r["piece"], r["n_tokens"]) for r in got}) == len(got)
    bins = {}
    for r in got:
        if r["bin_id"] is None:
            assert r["n_tokens"] == 0
        else:
            bins.setdefault((r["bin_id"], r["capacity"]), []).append((r["bin_offset"], r["n_tokens"]))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), items in bins.items():
        end = 0
        for offset, n in sorted(items):
            assert offset == end
            end += n
        assert end <= capacity
        assert capacity == next(c for c in op9_packing.CAPACITIES if c >= end)
    assert op9_packing.pack(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(200)]
    bins, offsets, filled = op9_packing.best_fit(lengths, (50, 100), 50)
    room, want = [], {}
    for i in sorted(range(200), key=lambda i: (-lengths[i], i)):
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            r = min(fits)
            room.remove(r)
        else:
            r = next(c for c in (50, 100) if c >= lengths[i])
        want[i] = r
        room.append(r - lengths[i])
    assert len(filled) == len(room)
    assert sorted(filled) == sorted(np.bincount(bins, lengths).astype(int).tolist())


# --- records


def test_records_round_trip(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["Don't été É word<|endoftext|> x|y ΑΣ ΑΣ. İ ﬁne ½ 3rd a b\x1cb ''s she'll I'M… a\tb\n\n c É.́ y,'t", None, "", "日本語。 ñ", "a.b,c!d e)]f K Å Ω <|startoftext|>a", "word " * 30_000, "dup", "dup"]
    rows = [(k - 2, x) for k, x in enumerate(texts)] + [(None, "null id"), (3, "same id")]
    folder = f"file://{tmp_path}/records"
    manifest = op6_records.write_records(spark, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int"), folder, tokenizer=path)
    got = sorted(op6_records.read_records(spark, folder, manifest, 2).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows)
    ids = lambda x: t.encode(x or "", add_special_tokens=False).ids + [1]
    crc = lambda x: zlib.crc32(np.array(ids(x), "<u4").tobytes())
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(d), len(ids(x)), crc(x)) for d, x in rows)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    assert [r["doc_id"] for r in got if r["doc_id"] is not None] == sorted(d for d, _ in rows if d is not None)
    first = next((tmp_path / "records").glob("*.rec"))
    data = bytearray(first.read_bytes())
    data[20] ^= 1
    first.write_bytes(data)
    with open(first, "rb") as f, pytest.raises(ValueError, match="damaged"):
        while op6_records.unframe(f) is not None:
            pass


def test_no_records(spark, tmp_path):
    import public_tokenizers

    folder = f"file://{tmp_path}/records"
    manifest = op6_records.write_records(spark, spark.createDataFrame([], "doc_id long, text string"), folder, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    assert manifest == []
    assert op6_records.read_records(spark, folder, manifest, 2).collect() == []


# --- media


def test_media_columns(spark, tmp_path):
    texts = [None, "", "a" * 64, "a" * 65, "é" * 5000, "b", "b"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "b"), (2, "other")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op5_media.query(spark, str(tmp_path)).collect()
    want = []
    for d, t in rows:
        b = (t or "").encode()
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        m = op5_media.wav(p)
        want.append((str(d), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), op5_media.feature(p)))
    assert sorted((str(r["doc_id"]), *r[1:8]) for r in got) == sorted(want)


def test_sequences():
    html = "<head><title>t</title></head><p>A <b>b</b><img src='u1' alt='alt'>c</p><figure><img src='u2'><img src='u3' alt='z'><figcaption>Cap <i>x</i></figcaption></figure><script>no</script><p>end"
    got = [(x["pos"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in op5_media.sequence(html)]
    assert got == [(0, "text", "A b", None), (1, "media", "u1", "alt"), (2, "text", "c", None), (3, "media", "u2", "Cap x"), (4, "media", "u3", "Cap x"), (5, "text", "end", None)]
    assert op5_media.sequence(None) == [] == op5_media.sequence("")
    op5_media.sequence("<figure><img src=a><figure><figcaption>" + "<b>" * 5000)


def test_resolve_keeps_what_it_cannot_resolve(spark):
    digest = "ab" * 32
    pages = spark.createDataFrame([(1, f"<img src='sha256:{digest}'><img src='http://x/y'><img src='sha256:{'0' * 64}'>"), (2, None)], "page_id long, html string")
    out = op5_media.resolve(op5_media.interleave(spark, pages), spark.createDataFrame([(digest, "f"), (digest, "f")], "digest string, feature string"))
    assert sorted((r["pos"], r["feature"]) for r in out.collect()) == [(0, "f"), (1, None), (2, None)]


def test_wav_round_trip():
    for b in (b"", b"a", b"abcd"):
        assert op5_media.unwav(op5_media.wav(b)) == b
    with pytest.raises(ValueError, match="container"):
        op5_media.unwav(b"RIFF")


# --- search


@pytest.mark.parametrize(("block_bytes", "pivots", "scale"), [(1 << 22, 4096, 1), (1100, 5, 1), (1 << 22, 40, 1e4), (1100, 9, 1e6), (1 << 22, 9, 1e9), (1 << 22, 5, 1e200)])
def test_search(spark, block_bytes, pivots, scale):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    good = [(k, (rng.normal(0, 1, 8) * (1 + k % 3) * scale).tolist()) for k in range(200)] + [(k, (np.ones(8) * scale / 2 + (k % 3) / 256).tolist()) for k in range(200, 260)]
    odd = [(300, None), (301, [None] + [1.0] * 7), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8), (350, [1.0, 2.0]), (351, [2.0, 1.0]), (5, [-9.0] * 8), (400, [])]
    v = spark.createDataFrame([(*r, "x") for r in good + odd], "vec_id long, embedding array<double>, grp string")
    got = sorted(map(tuple, op8_knn.top_k(spark, v, F.col("vec_id") % 50 == 0, block_bytes=block_bytes, max_pivots=pivots).collect()))
    kept = {}
    for i, x in good + odd:
        if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            q = np.floor(256 * np.array(x, np.float64)).tolist()
            kept[i] = min(kept[i], q) if i in kept else q
    want = []
    for i, q in kept.items():
        if i % 50 == 0:
            s = sorted((-sum(int(a) * int(b) for a, b in zip(q, x, strict=True)), j) for j, x in kept.items() if j != i and len(x) == len(q))[:5]
            want += [(i, r, j, max(-(2**63), min(2**63 - 1, -n))) for r, (n, j) in enumerate(s, 1)]
    assert got == sorted(want)


def test_search_of_nothing(spark):
    from pyspark.sql import functions as F

    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert op8_knn.top_k(spark, v, F.lit(True)).collect() == []
    v = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert op8_knn.top_k(spark, v, F.lit(True)).collect() == []
