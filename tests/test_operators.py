"""Operators against small models in Python."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone import rules
from lodestone.functions import text as tx
from lodestone.operators import label, matching, orders, segment, validate, xmltext
from lodestone.sources import files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_alias_to_doi(spark):
    assert one(spark, "dryad.Ab12", lambda c: tx.doi_url(tx.aliased(c))) == "https://doi.org/10.5061/dryad.ab12"


@pytest.mark.parametrize(("value", "ok"), [("10.5061/dryad.(ab", False), ("a(b)[c]", True), (")(", False), ("", True), ("([)]", True)])
def test_balanced(spark, value, ok):
    assert one(spark, value, tx.balanced) is ok


def test_rejected_dois(spark):
    rows = [("10.5061/abc", "10.1_a"), ("10.5061/dryad.ab12", "10.1_a"), ("10.5061/dryad", "10.1_a"), ("10.1038/s41586", "10.1_a"), ("10.7777/data1", "10.7777_x")]
    d = spark.createDataFrame(rows, "doi string, a string").select(validate.doi_rejected(F.col("doi"), F.col("a")).alias("r"))
    assert [r["r"] for r in d.collect()] == [True, False, True, True, True]


def test_offsets_match_finditer(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1 .é😀-") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for pattern in (r"[ab]+", r"1", r"\.|-"):
        d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        got = {r["i"]: [tuple(m) for m in r["m"]] for r in d.select("i", matching.all_matches(F.col("t"), pattern).alias("m")).collect()}
        assert got == {i: [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t)] for i, t in enumerate(texts)}


def test_clusters(spark):
    d = spark.createDataFrame([(1, "x" * 200, "a", s, e) for s, e in ((0, 5), (40, 44), (100, 104), (130, 140))], "doc_id int, text string, prefix string, start int, end int")
    got = sorted((r["cluster_start"], r["cluster_end"]) for r in matching.clusters(d.drop("text"), d.select("doc_id", "text").distinct()).collect())
    assert got == [(0, 44), (100, 140)]


@pytest.mark.parametrize(("cites", "cut"), [(5, 12), (4, None)])
def test_bibliography_cut(spark, cites, cut):
    lines = ["some text of the body"] * 12 + ["References"] + ["[1] Smith (2020)"] * cites + ["plain words"] * (9 - cites)
    got = segment.bibliography_cut(spark.createDataFrame([(1, "\n".join(lines))], "doc_id int, text string")).collect()
    assert [r["cut"] for r in got] == ([cut] if cut else [])


def test_recovery_takes_the_first_pattern(spark):
    found = spark.createDataFrame([(1, "v", "b", 2, 5), (1, "v", "a", 1, 9), (1, "w", "a", 1, 3)], "doc_id int, value string, pattern_name string, priority int, start int")
    known = spark.createDataFrame([(1, "w")], "doc_id int, value string")
    assert [(r["value"], r["pattern_name"]) for r in matching.first_by_priority(found, known).collect()] == [("v", "a")]


def test_availability(spark):
    text = "Intro words. The dataset was deposited in Zenodo under 1. More. Data availability: on request."
    a = one(spark, text, matching.availability)
    assert a["method"] == "hybrid"
    assert a["statement"].startswith("The dataset was deposited in Zenodo")
    assert one(spark, "nothing here", matching.availability)["method"] == "none"


def test_majority_tie_goes_to_the_smallest(spark):
    rows = [(1, "A1", ["P2", "P1"], []), (1, "A2", ["P1"], []), (1, "A3", ["P2"], []), (1, "https://doi.org/10.1/x", [], []), (2, "B", [], ["E"]), (2, "C", [], [])]
    d = spark.createDataFrame(rows, "doc_id int, dataset_id string, pmc_ids array<string>, ext_ids array<string>")
    assert sorted(r["dataset_id"] for r in label.majority_filter(d).collect()) == ["A1", "A2", "B", "https://doi.org/10.1/x"]


@pytest.mark.parametrize(("n", "kind"), [(10, {"Primary"}), (9, {"Primary", "Secondary"})])
def test_promotion(spark, n, kind):
    d = spark.createDataFrame([(1, "Primary")] * n + [(1, "Secondary")], "g int, type string")
    assert {r["type"] for r in label.promote(d, ["g"]).collect()} == kind


def test_scoring_nothing(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([], "k int")
    r = label.f1(label.outcome(a, b, ["k"])).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)


def test_row_ids_with_ties(spark):
    d = spark.createDataFrame([(k % 3, k) for k in range(100)] + [(None, 1)], "a int, b int")
    got = [(r["a"], r["b"]) for r in label.with_row_ids(d, "a", "b").orderBy("row_id").collect()]
    assert got == [(None, 1)] + sorted((k % 3, k) for k in range(100))


def test_lock_boundary(spark):
    t = datetime(2024, 1, 1)
    d = spark.createDataFrame([(1, t, True)], "order_id int, expires_at timestamp_ntz, is_active boolean")
    now = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    assert orders.active(d, now).count() == 0
    assert orders.expire(d, now).first()["is_active"] is True


def test_triage(spark):
    rows = ["https://doi.org/10.5281/zenodo.1", "10.1038/x12345", "10.9999/data.123", "10.9999/journal.1", "x", None]
    d = spark.createDataFrame([(r,) for r in rows], "doi string").select(validate.triage(F.col("doi")).alias("k"))
    assert [r["k"] for r in d.collect()] == ["dataset", "drop", "lookup", "drop", "drop", "drop"]


def test_chunks():
    text = "# A\n" + "One sentence here. " * 40 + "\n# B\nshort"
    got = segment.chunks(text, 50, 200, 50)
    assert all(len(c) <= 200 for c in got)
    assert got[-1] == "short" or got[-1].endswith("short")
    assert segment.chunks(None, 1, 10, 2) == [] == segment.chunks("", 1, 10, 2)
    assert segment.chunks("# A\nx", 1, 10, 2, keep_headings=True) == ["# A\nx"]


def test_text_rewrites(spark):
    assert one(spark, "see https:// doi.org/10.1234/ abc", tx.repair_links) == "see https://doi.org/10.1234/abc"
    assert one(spark, "a\nb.\nc", tx.page_text) == "a b.\nc"
    assert one(spark, "ﬁne é https://zenodo.org/record/12", tx.normalised) == "fine   10.5281/zenodo.12"
    assert one(spark, "x\nSmith (2020a). T\ny", tx.without_citation_years) == "x\ny"
    assert one(spark, "```json\n{}\n```", tx.fenced_json) == "{}"
    assert one(spark, "https://doi.org/10.5281/x", tx.doi_key) == "10.5281_x"
    assert one(spark, 'see (#page-1-2)\n<span id="page-1-2"></span> 10.1234/ab\n\nend', tx.page_links_resolved).startswith("see (10.1234/ab)")


def test_xml_dialects():
    text, method, error = xmltext.extract("<article><body><sec><p>A <i>b</i></p></sec></body><back><ref-list><ref>Smith J</ref></ref-list></back></article>", "jats")
    assert (text, method, error) == ("A b\nReferences\nSmith J.", "standard", None)
    assert xmltext.extract("<a>x & y</a>", "unknown")[:2] == ("x & y", "mended")
    assert xmltext.extract("", "tei") == ("", "none", "empty")
    assert xmltext.extract("<p>one</p><p>two</p>", "unknown")[:2] == ("one two", "wrapped")


def test_files(spark, tmp_path):
    (tmp_path / "GEO.csv").write_text("GEO,PMCID,EXTID\nGSE1,PMC1,\nGSE1,PMC2,E1\n")
    (tmp_path / "other.csv").write_text("x,y\n1,2\n")
    got = files.catalog(spark, [str(tmp_path / "GEO.csv"), str(tmp_path / "other.csv")]).collect()
    assert [tuple(r) for r in got] == [("GSE1", ["PMC1", "PMC2"], ["E1"], ["GEO"])]
    (tmp_path / "dois.txt").write_text("10.1/A\nx\n 10.1/a\n")
    assert files.doi_lines(spark, str(tmp_path / "dois.txt")).count() == 1
    (tmp_path / "ann.txt").write_text("a.jpg 1\nb.jpg 2\na.jpg 3\n")
    assert dict(map(tuple, files.annotations(spark, str(tmp_path / "ann.txt")).collect())) == {"a.jpg": 3, "b.jpg": 2}
    (tmp_path / "names.json").write_text('{"1": "rose", "2": "lily"}')
    assert dict(map(tuple, files.class_map(spark, str(tmp_path / "names.json")).collect())) == {1: "rose", 2: "lily"}
    (tmp_path / "t.tsv").write_text("words here\t3\n\n")
    assert [tuple(r) for r in files.labelled_lines(spark, str(tmp_path / "t.tsv")).collect()] == [("words here", 3)]
    (tmp_path / "a.xml").write_text("<a>\nb</a>")
    assert [tuple(r) for r in files.xml_directory(spark, str(tmp_path / "a.xml")).collect()] == [("a", "<a>\nb</a>")]
    files.write_csv(spark.createDataFrame([("a", 'q"')], "x string, y string"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, escape="\\").first()["y"] == 'q"'
    assert files.cover(["x" * 600, "y" * 600, "z"]) == "x" * 600 + "\n" + "y" * 600


def test_streaming_leases(spark, tmp_path):
    from lodestone.streaming import leases

    rows = [("t", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 10, 20)] + [("u", datetime(2024, 1, 1, 0, 10))]
    spark.createDataFrame(rows, "lock_token string, locked_at timestamp").write.parquet(str(tmp_path / "in"))
    s = leases.expirations(spark.readStream.schema("lock_token string, locked_at timestamp").parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("expired").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["lock_token"], r["renewals"]) for r in spark.table("expired").collect()] == [("t", 3)]


def test_rule_tables():
    assert len(rules.PATTERNS) == 53
    assert len(set(rules.JOURNALS)) == 153
    for _, _, p in rules.PATTERNS:
        re.compile(p)


def test_one_text_with_very_many_matches(spark):
    import time

    d = spark.createDataFrame([("GSE12 x " * 100_000,)], "t string").cache()
    d.count()
    count = lambda: d.select(F.size(matching.all_matches(F.col("t"), r"GSE\d+")).alias("n"), F.element_at(matching.all_matches(F.col("t"), r"GSE\d+"), -1)["end"].alias("e")).first()
    count()
    began = time.perf_counter()
    assert tuple(count()) == (100_000, 8 * 100_000 - 3)
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("[click](http://e.com/a)", "url", "(http://e.com/a)"),
        ("[" + "x" * 31 + "](http://e.com/a)", "url", "[" + "x" * 31 + "](http://e.com/a)"),
        ("(http://e.com/a)(http://e.com/a)(http://e.com/a)", "url", "(http://e.com/a)"),
        ("(http://a.b)(http://c.d)(http://c.d)(http://a.b) z", "url", " z"),
        ("(10.1234/ab)(10.1234/ab)", "doi", "(10.1234/ab)"),
        ("[x](10.1234/Ab(1)) and (10.1234/ab) or (10.1234/AB)", "doi", "[x](10.1234/Ab(1)) and (10.1234/ab) or "),
        ("", "url", ""),
        (None, "doi", None),
    ],
)
def test_without_labels(spark, text, kind, want):
    assert one(spark, text, lambda c: tx.without_labels(c, kind)) == want


def test_sentence_context_reaches_out(spark):
    text = "x" * 30 + ". " + "a" * 390 + " GSE1 " + "b" * 90 + "。" + "c" * 500
    got = spark.createDataFrame([(text,)], "t string").select(F.inline(matching.all_matches(F.col("t"), r"GSE\d")), "t")
    got = got.select(matching.sentence_context(F.col("t"), F.col("start"), F.col("end")).alias("c")).first()["c"]
    assert got == "a" * 390 + " GSE1 " + "b" * 90 + "。"
    none = "y" * 900 + "GSE1" + "z" * 900
    got = spark.createDataFrame([(none,)], "t string").select(matching.sentence_context(F.col("t"), F.lit(900), F.lit(904)).alias("c")).first()["c"]
    assert got == "y" * 200 + "GSE1" + "z" * 100


def test_requests_that_repeat(spark):
    t = datetime(2024, 1, 1)
    now = F.expr("TIMESTAMP_NTZ '2023-12-31 00:00:00'")
    locks = spark.createDataFrame([("a", "u1", t, True), ("b", "u2", t, True)], "lock_token string, locked_by string, expires_at timestamp_ntz, is_active boolean")
    asks = spark.createDataFrame([("a", "u9", 1), ("a", "u1", 10), ("a", "u1", 20), ("b", "u1", 5)], "token string, user_id string, seconds int")
    assert sorted((r["lock_token"], r["is_active"]) for r in orders.release(locks, asks).collect()) == [("a", False), ("b", True)]
    assert sorted((r["lock_token"], r["expires_at"].second) for r in orders.extend(locks, asks, now).collect()) == [("a", 30), ("b", 0)]
    have = spark.createDataFrame([(1, "P", "s", t, 1), (2, "P", "s", t, 3)], "order_id int, status string, updated_by string, updated_at timestamp_ntz, version int")
    patches = spark.createDataFrame([(1, 1, "u2", "B"), (1, 1, "u1", "A"), (1, 2, "u0", "C"), (2, 1, "u1", "A"), (2, 2, "u1", "B")], "order_id int, expected_version int, user_id string, status string")
    got = sorted((r["order_id"], r["status"], r["updated_by"], r["version"], r["result"]) for r in orders.amend(have, patches, now, ("status",)).collect())
    assert got == [(1, "A", "u1", 2, "amended"), (2, "P", "s", 3, "conflict")]


def test_classifier_tasks(spark):
    rows = [
        (1, "https://doi.org/10.1/a", "body", "Secondary", "text", "A", "doi", "Primary"),
        (2, "GSE1", "body", "Secondary", "was deposited", "C", "accession", None),
        (3, "GSE1", "body", "Secondary", "was seen", "A", None, "Secondary"),
        (4, "EPI_ISL_1", "body", "Primary", "deposited", "B", None, "Primary"),
        (5, "GSE1", "references", "Secondary", "x", None, "reference", "Secondary"),
        (6, "GSE1", "body", None, "deposited", "A", None, None),
    ]
    d = spark.createDataFrame([r[:5] for r in rows], "doc_id int, dataset_id string, section string, type string, context string")
    tasks = label.asked(d)
    assert {r["doc_id"]: r["task"] for r in tasks.collect()} == {r[0]: r[6] for r in rows}
    answers = spark.createDataFrame([(r[0], r[5]) for r in rows], "doc_id int, choice string")
    assert {r["doc_id"]: r["type"] for r in label.answered(tasks, answers, ["doc_id"]).collect()} == {r[0]: r[7] for r in rows}
    told = tasks.withColumns({"statement": F.lit("s" * 2000), "snippet": F.lit("Dryad ")})
    assert {r["doc_id"]: (r["data_information"] or "")[:8] for r in label.prompts(told).collect()} == {1: "", 2: "ssssssss", 3: "", 4: "", 5: "Dryad ss", 6: ""}


def test_row_ids_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(label, "RANGE_ROWS", 50)
    d = spark.createDataFrame([(k % 7, k) for k in range(1000)] + [(None, 5), (3, None)], "a int, b int")
    got = [(r["a"], r["b"]) for r in label.with_row_ids(d, "a", "b").orderBy("row_id").collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert got == sorted(((r["a"], r["b"]) for r in d.collect()), key=key)


def test_last_headings():
    assert segment.last_headings("body\nREFERENCES\n[1] a\nreferences: b") == ("body", "REFERENCES\n[1] a\nreferences: b")
    assert segment.last_headings("one\n[1] a\n[2] b") == ("one", "[1] a\n[2] b")
    assert segment.last_headings("a\nb\nc\nd\n7. x\n8. y\n9. z") == ("a\nb\nc\nd", "7. x\n8. y\n9. z")
    assert segment.last_headings("plain") == ("plain", "")
    assert segment.last_headings(None) == ("", "")


def test_xml_front_and_back():
    a = (
        "<article><front><article-title>My Title</article-title><abstract><p>Abs</p></abstract></front><body><sec><title>One</title><p>A <i>b</i></p></sec></body><back><ack><p>Thanks.</p></ack>"
        '<notes notes-type="data-availability"><p>N</p><fn-group><fn>F</fn></fn-group></notes><sec><title>Supplementary data</title><p>S</p></sec><ref-list><ref><article-title>Ref title one</article-title></ref></ref-list></back></article>'
    )
    assert xmltext.extract(a, "jats")[0].split("\n") == ["My Title", "Abs", "One", "A b", "Acknowledgements", "Thanks.", "Data availability", "N", "F", "Supplementary data", "S", "References", "Ref title one."]
    w = (
        '<component xmlns="http://www.wiley.com/namespaces/wiley"><header><contentMeta><titleGroup><title type="short">S</title><title type="main">Main <i>t</i></title></titleGroup><creators><creator creatorRole="author">'
        "<personName><givenNames>Ann B</givenNames><familyName>Lee</familyName></personName></creator><creator creatorRole='editor'><personName><familyName>Ed</familyName></personName></creator></creators><abstractGroup>"
        '<abstract type="main"><title>x</title><p>Abs p.</p></abstract></abstractGroup></contentMeta></header><body><section><title>T</title><p>P</p></section><bibliography><bib><citation>Smith J A Tale</citation></bib></bibliography></body></component>'
    )
    assert xmltext.extract(w, "wiley")[0].split("\n") == ["Main t", "Ann B Lee", "Abstract", "Abs p.", "T", "P", "References", "Smith J A. Tale."]
    deep = "<article><body>" + "<sec>" * 5000 + "<p>x</p>" + "</sec>" * 5000 + "</body></article>"
    assert xmltext.extract(deep, "jats")[:2] == ("x", "standard")
    assert xmltext.extract("<a>" * 3000 + "x" + "</a>" * 3000, "unknown")[:2] == ("x", "standard")


def test_xml_encodings(spark, tmp_path):
    for name, raw in {"a": '<?xml version="1.0" encoding="iso-8859-1"?><a>é</a>'.encode("latin-1"), "b": "<a>é</a>".encode("utf-16"), "c": "<a>é</a>".encode("cp1252"), "d": "\ufeff<a>é</a>".encode()}.items():
        (tmp_path / f"{name}.xml").write_bytes(raw)
    got = {r["article_id"]: xmltext.extract(r["content"], "unknown")[0] for r in files.xml_directory(spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys("abcd", "é")


def test_more_files(spark, tmp_path):
    import json

    (tmp_path / "pub.json").write_text('{"10.1/a": ["GSE1", "10.2/b"], "10.1/c": []}')
    assert sorted(map(tuple, files.publication_datasets(spark, str(tmp_path / "pub.json")).collect())) == [("10.1_a", ["GSE1", "10.2/b"]), ("10.1_c", [])]
    resolved = spark.createDataFrame([("10.1/a", "10.5281/z"), ("10.1/a", "10.5061/y"), ("10.1/b", "10.5061/y")], "article_id string, doi string")
    files.write_datasets(resolved, str(tmp_path / "one"))
    got = json.loads(spark.read.text(str(tmp_path / "one")).first()[0])
    assert got == {"datasets_by_article": {"10.1_a": ["10.5061/y", "10.5281/z"], "10.1_b": ["10.5061/y"]}, "all_datasets": ["10.5061/y", "10.5281/z"], "summary": {"articles_with_datasets": 2, "total_unique_datasets": 2}}
    files.write_datasets(resolved, str(tmp_path / "many"), one_file=False)
    assert spark.read.text(str(tmp_path / "many" / "all_datasets")).count() == 2
    (tmp_path / "1").mkdir()
    (tmp_path / "2").mkdir()
    (tmp_path / "1" / "x.pdf").write_bytes(b"one|" + b"y" * 1200 + b"|three")
    (tmp_path / "2" / "y.pdf").write_bytes(b"z")
    pages = files.binary_directory(spark, str(tmp_path / "1"), lambda raw: raw.decode().split("|")).first()
    assert (pages["article_id"], pages["cover"], pages["text"][:5]) == ("x", "one\n" + "y" * 1200, "one\ny")
    assert sorted(map(tuple, files.folder_labels(spark, f"{tmp_path}/[12]").collect())) == [("x.pdf", 0), ("y.pdf", 1)]
    vec = files.embeddings_for(spark.createDataFrame([("a 1 2",), ("bad 1",)], "value string"), spark.createDataFrame([("a", 0), ("bad", 1)], "token string, id int"), size=2).orderBy("id").collect()
    assert vec[0]["vector"] == [1.0, 2.0]
    assert len(vec[1]["vector"]) == 2


def test_seed_orders(spark):
    from lodestone import schemas

    assert [r["order_number"] for r in schemas.seed_orders(spark).collect()] == ["ORD-001", "ORD-002", "ORD-003"]


def test_remaining_text_functions(spark):
    assert one(spark, "https://doi.org/10.1234/a/b", tx.last_segment) == "b"
    assert one(spark, "10.1234 / ab 10.5/ x", tx.xml_doi_space) == "10.1234/ab 10.5/ x"
    assert one(spark, 'x\n- <span id="page-1"></span>\ny', tx.without_span_lines) == "x\ny"
    assert one(spark, "# T\nbody\n## **References**\n1", segment.markdown_cut) == "# T\nbody\n"
    assert one(spark, "One. Two! Three", segment.sentences) == ["One.", "Two!", "Three"]


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from lodestone import storage

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="share"):
        storage.shared_dir(fake)


def test_jdbc(spark):
    url, driver = "jdbc:derby:memory:orders;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.createDataFrame([(k, f"n{k}") for k in range(20)], "id int, name string").write.option("driver", driver).jdbc(url, "t")
    assert files.jdbc(spark, url, "t", driver=driver).where("id > 16").count() == 3
    split = files.jdbc(spark, url, "t", driver=driver, column="ID", low=0, high=20, parts=4)
    assert split.rdd.getNumPartitions() == 4
    assert split.count() == 20


def test_wider_windows_for_raw_texts(spark):
    d = spark.createDataFrame([(1, "GSE1234 " + "x" * 6000 + " genome", "")], "doc_id int, body string, refs string")
    near = lambda n: [r["near"] for r in matching.mentions(d, names=("geo_id",), widen=n).collect()]
    assert (near(1), near(2)) == ([False], [True])


def test_bounds_beside_other_letters(spark):
    """A letter beyond ASCII ends a word, as in the SQL."""
    d = spark.createDataFrame([(1, "ENSSÜ, ÄGSE12 xGSE13 GSE14é GSE15_ PDX é2020"), (2, "5.2.3.-x 5.2.4.- é5.2.5.1")], "doc_id long, text string")
    assert {tuple(r) for r in matching.distinct_values(d).collect()} == {(1, "ensembl_id", "ENSS"), (1, "geo_id", "GSE12"), (1, "geo_id", "GSE14")}
    found = matching.mentions(d.withColumn("refs", F.lit("")), names=("geo_id", "brenda_ec_number"), body="text")
    assert {(r.doc_id, r.value) for r in found.collect()} == {(1, "GSE12"), (1, "GSE14"), (2, "5.2.3.-"), (2, "5.2.5.1")}


def test_short_tables_are_dealt_out(spark):
    """One file of one row group doesn't leave all work to one task."""
    from lodestone.plans import citations

    assert citations.label_links(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1


def test_small_batches():
    import pyarrow as pa

    from lodestone.functions.batches import small

    b = pa.RecordBatch.from_pydict({"k": [1, 2, 3, 4, 5], "text": ["aaa", None, "bbbb", "c", "dddddddddddd"]})
    assert [x["k"].to_pylist() for x in small([b, b.slice(0, 0)], "text", most=5)] == [[1, 2], [3, 4], [5]]


def test_patterns_of_digit_words():
    """Only patterns whose matches hold a digit and no white space are tried on words with a digit alone."""
    kept = {n for n, _, p in rules.PATTERNS if not matching.in_digit_words(p)}
    assert kept == {"doi2", "doi_ref2", "brenda_tissue_ontology_id", "cellosaurus_id", "uniparc_id"}
    assert not any(map(matching.in_digit_words, (r"a\d?", r"\d$", r"\d \d", r"\d[^a]", r"\d.")))
    assert matching.starts(r"\bABC\d|DEFG") == ["ABC", "DEFG"] and matching.starts(r"AB\d") == []
