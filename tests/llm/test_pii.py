"""Base spans against Python's re; disclosure on a small corpus; awkward rows."""

import hashlib
import random
import re

from lodestone.llm import op3_pii


def luhn(v):
    t = 0
    for i, c in enumerate(reversed(re.sub(r"\D", "", v))):
        x = int(c) * (1 + i % 2)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(re.sub(r"\D", "", v)) <= 19 and luhn(v)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub(r"\D", "", v)) <= 15),
}


def model(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m[0])]


def test_base_spans(spark, tmp_path):
    rng = random.Random(3)
    texts = [
        "a@b.cc_x@d.e a@b..c x@y.z. é@a.b .@-.- a.b@c.d.e.f.g@h.i", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111111111 411111111111 1",
        "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255 1.2.3 1.2.3.256.1.2.3", "+1 (499) 555-6503 +49 30 1234-5678. +1 +12 345 6789 012 345 678 ++123456789 +1-2-3-4-5-6-7-8-9-",
        "😀😀 a@b.co ﷐ 1﷐1 4111﷐1111 4111 1111 1111 1111", None, "", "1 " * 30_000, "a@" + "b." * 20_000 + "c", "9" * 50_000, "x" * 60_000 + "@" + "y" * 100, None, "",
    ] + ["".join(rng.choice("0123456789 -+.()@ab._") for _ in range(300)) for _ in range(300)]
    rows = [(None if i % 7 == 0 else i // 2, t, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r["doc_id"]), r["base_sha256"], r["n_email"], r["n_phone"]) for r in op3_pii.query(spark, str(tmp_path)).collect())
    want = sorted((str(d), hashlib.sha256(",".join(model(t)).encode()).hexdigest(), sum(x[0] == "e" for x in model(t)), sum(x[0] == "p" for x in model(t))) for d, t, _ in rows)
    assert got == want


def test_disclosing_terms(spark):
    rows = [(k, f"number {k} word{chr(97 + k % 26)} the Zanzibar office writes to jo@ex.org about the matter {chr(97 + k)}") for k in range(5)]
    rows += [(100 + k, f"the office and the matter, once more about number {k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in op3_pii.sanitise(spark, docs).collect()}
    assert "[EMAIL]" in out[0]
    assert "Zanzibar" not in out[0]
    assert "office" in out[0]
    assert out[150] == rows[55][1]


def test_copies_are_no_evidence(spark):
    docs = spark.createDataFrame([(k, "the Zanzibar office writes to jo@ex.org today") for k in range(50)] + [(99, "other words")], "doc_id long, text string")
    assert all("Zanzibar" in r["text"] for r in op3_pii.sanitise(spark, docs).where("doc_id < 99").collect())


def test_copies_keep_the_share(spark):
    rows = [(k, f"{w} the Zanzibar office writes to jo@ex.org {w}") for k, w in enumerate(("today", "later", "often"))]
    rows += [(100 + k, rows[0][1]) for k in range(100)] + [(1000 + k, f"the office number {k}") for k in range(900)]
    out = op3_pii.sanitise(spark, spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 1000").collect()
    assert len(out) == 103
    assert not any("Zanzibar" in r["text"] for r in out)
    assert all("office" in r["text"] for r in out)


def test_empty_and_clashing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, dk string, spans int")
    assert op3_pii.sanitise(spark, docs).collect() == []
    docs = spark.createDataFrame([(1, None, "k", 1), (1, None, "k", 1), (None, "a@b.co", "k", 2)], "doc_id long, text string, dk string, cuts int")
    assert sorted((r["text"] or "", r["cuts"], r["dk"]) for r in op3_pii.sanitise(spark, docs).collect()) == [("", 1, "k"), ("", 1, "k"), ("[EMAIL]", 2, "k")]


def test_terms_far_away_and_elsewhere(spark):
    far = "the office keeps its own old books here and goes on with them for a long while yet " * 3
    rows = [(k, f"Zanzibar {far} jo@ex.org") for k in range(2)]  # two documents, one text, and one more
    rows += [(2, f"{far} a line of the matter. Zanzibar. {far} jo@ex.org"), (3, f"{far} once@only.org {far} Quagga {far}")]
    rows += [(1000 + k, f"{far} number {k} the matter of the line") for k in range(900)]
    rows += [(5000, "éQuagga quagga quaggas QUAGGA Quagga@only.net"), (5001, "a letter from Zanzibar")]
    out = {r["doc_id"]: r["text"] for r in op3_pii.sanitise(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == len(rows)
    assert not any("Zanzibar" in out[k] for k in (0, 1, 2))
    assert "Zanzibar" not in out[5001] and "a letter from" in out[5001]
    assert "Quagga" not in out[3] and "[EMAIL]" in out[3]
    assert out[3].count("office") == rows[3][1].count("office")
    assert out[1500] == rows[504][1]
