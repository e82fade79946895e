"""The stages on a small table: what goes, what stays, and the columns."""

import corpus_pipeline as P


def test_stages(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and then it runs away to the far hills"
    fr = "le renard brun saute par dessus le chien paresseux et puis il court vers les collines"
    rows = [(k, f"{text} number {'abcdefghij'[k]} " + " ".join(f"w{k}x{j}" for j in range(k + 5)), "en", f"s{k % 2}", 0) for k in range(10)]
    rows += [(20, fr, "fr", "s1", 0), (21, fr, "fr", "s1", 0), (22, None, "en", "s0", 0), (23, "123 !!", None, None, 0), (24, "write to jo@ex.org or call them at once please my friend", "en", "s1", 0), (24, "write to jo@ex.org or call them at once please my friend", "en", "s1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    seen = {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = docs = spark.createDataFrame(docs.collect(), schema)
    ids = lambda n: sorted(r["doc_id"] for r in seen[n].collect())
    assert ids("language_id") == [*range(10), 20, 21, 24, 24]
    assert ids("jaccard_join") == [*range(10), 20, 24]
    assert {r["text"] for r in seen["pii"].where("doc_id = 24").collect()} == {"write to [EMAIL] or call them at once please my friend"}
    words = lambda n: sum(len(r["text"].split()) for r in seen[n].collect())
    assert abs(words("mixing") - 1.5 * words("pii")) <= 2
    last = P.STAGES[-1][1](spark, docs, "")
    assert sum(r["n_tokens"] for r in last.collect()) == words("mixing")


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
