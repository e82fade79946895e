"""Queries of the token and vector features, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, label
from .citations import table

MOST = 10_000
WEIGHTS = (50.0, 0.01, 1.0)
DIM = 64


def _vocab(spark, sf_dir):
    return features.vocabulary(table(spark, sf_dir, "documents").where("text IS NOT NULL"), least=1, most=MOST)


def vocab_topn(spark, sf_dir):
    return _vocab(spark, sf_dir)


def char_vocab(spark, sf_dir):
    return features.vocabulary(table(spark, sf_dir, "conversations").withColumn("k", F.struct("conv_id", "turn")), key="k", most=MOST, by_char=True)


def encode_pad(spark, sf_dir):
    return features.encode(table(spark, sf_dir, "documents").where("text IS NOT NULL"), _vocab(spark, sf_dir))


def ngram_hash(spark, sf_dir):
    e = encode_pad(spark, sf_dir)
    return e.select("doc_id", features.bigrams(F.col("ids"), 250_499).alias("bigram"), features.trigrams(F.col("ids"), 250_499).alias("trigram"))


def _scores():
    return F.transform("embedding", lambda x: x.cast("double"))


def softmax_top3(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", features.softmax(_scores()).alias("p"))
    e = e.select("vec_id", F.posexplode(features.top_classes(F.col("p"), 3)).alias("place", "top"))
    return e.select("vec_id", "place", F.col("top.label").alias("label"), F.round("top.score", 6).alias("score"))


def weighted_argmax(spark, sf_dir):
    logs = F.transform("embedding", lambda x: -F.abs(x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", features.weighted_argmax(logs, [WEIGHTS[k % 3] for k in range(DIM)]).alias("label"))


def mean_pool(spark, sf_dir):
    d = features.mean_pool(table(spark, sf_dir, "embeddings"), "label", "embedding", DIM, F.col("embedding")[0] >= 0)
    return d.select("label", F.posexplode("mean").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def max_pool(spark, sf_dir):
    d = features.max_pool(table(spark, sf_dir, "embeddings"), "label", "embedding", DIM)
    return d.select("label", F.posexplode("max").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def batch_numbers(spark, sf_dir):
    return features.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 128).groupBy("batch_no").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def best_so_far(spark, sf_dir):
    return features.best_so_far(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "event_id", "value", "user_id")


def best_of_all(spark, sf_dir):
    """Over the whole table, without groups."""
    return features.best_so_far(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", "value")


def rank_by_class(spark, sf_dir):
    return label.with_row_ids(table(spark, sf_dir, "embeddings").select("label", "vec_id"), "label", "vec_id")


QUERIES = {f.__name__: f for f in (vocab_topn, char_vocab, encode_pad, ngram_hash, softmax_top3, weighted_argmax, mean_pool, max_pool, batch_numbers, best_so_far, best_of_all, rank_by_class)}

# --- SQL ----------------------------------------------------------------------------------------------------------------

_V = f"""w AS (SELECT doc_id, unnest(string_split(trim(text, ' \t\r\n'), ' ')) AS token, generate_subscripts(string_split(trim(text, ' \t\r\n'), ' '), 1) AS pos FROM documents WHERE text IS NOT NULL),
  n AS (SELECT token, count(*) AS n, min((doc_id, pos)) AS f FROM w WHERE token <> '' GROUP BY token), r AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, f) - 1 AS INT) AS id FROM n ORDER BY id LIMIT {MOST}),
  v AS (SELECT * FROM r UNION ALL SELECT '<UNK>', CAST(count(*) AS INT) FROM r UNION ALL SELECT '<PAD>', CAST(count(*) + 1 AS INT) FROM r)"""
_E = f"""{_V}, m AS (SELECT map_from_entries(list((token, id))) AS m, max(id) AS pad FROM v), t AS (SELECT doc_id, list_filter(string_split(trim(text, ' \t\r\n'), ' '), lambda x: x <> '')[1:32] AS t FROM documents WHERE text IS NOT NULL),
  e AS (SELECT doc_id, list_concat(list_transform(t, lambda x: coalesce(m[x], pad - 1)), list_transform(range(32 - len(t)), lambda x: pad)) AS ids, CAST(len(t) AS INT) AS seq_len FROM t, m)"""
_P = "p AS (SELECT vec_id, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE))) AS e FROM embeddings)"
SQL = {
    "vocab_topn": f"WITH {_V} SELECT token, id FROM v",
    "char_vocab": """WITH w AS (SELECT conv_id, turn, unnest(string_split(trim(text, ' \t\r\n'), '')) AS token, generate_subscripts(string_split(trim(text, ' \t\r\n'), ''), 1) AS pos FROM conversations WHERE text IS NOT NULL),
      n AS (SELECT token, count(*) AS n, min((conv_id, turn, pos)) AS f FROM w WHERE token <> '' GROUP BY token), r AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, f) - 1 AS INT) AS id FROM n ORDER BY id LIMIT 10000)
      SELECT * FROM r UNION ALL SELECT '<UNK>', CAST(count(*) AS INT) FROM r UNION ALL SELECT '<PAD>', CAST(count(*) + 1 AS INT) FROM r""",
    "encode_pad": f"WITH {_E} SELECT doc_id, ids, seq_len FROM e",
    "ngram_hash": f"""WITH {_E} SELECT doc_id, list_transform(range(1, 33), lambda i: CAST(CASE WHEN i > 1 THEN CAST(ids[i - 1] AS BIGINT) * 14918087 % 250499 ELSE 0 END AS BIGINT)) AS bigram,
      list_transform(range(1, 33), lambda i: CAST((CASE WHEN i > 2 THEN CAST(ids[i - 2] AS BIGINT) * 14918087 * 18408749 ELSE 0 END + CASE WHEN i > 1 THEN CAST(ids[i - 1] AS BIGINT) * 14918087 ELSE 0 END) % 250499 AS BIGINT)) AS trigram FROM e""",
    "softmax_top3": f"""WITH {_P}, u AS (SELECT vec_id, unnest(list_transform(e, lambda x: x / list_sum(e))) AS s, generate_subscripts(e, 1) - 1 AS label FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) - 1 AS place FROM u)
      SELECT vec_id, CAST(place AS INT) AS place, CAST(label AS INT) AS label, round(s, 6) AS score FROM k WHERE place < 3""",
    "weighted_argmax": "WITH w AS (SELECT vec_id, list_transform(embedding, lambda x, i: -abs(CAST(x AS DOUBLE)) * CAST([50.0, 0.01, 1.0][1 + (i - 1) % 3] AS DOUBLE)) AS w FROM embeddings) SELECT vec_id, CAST(list_position(w, list_max(w)) - 1 AS INT) AS label FROM w",
    "mean_pool": "WITH u AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings WHERE embedding[1] >= 0) SELECT label, CAST(pos AS INT) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM u GROUP BY ALL",
    "max_pool": "WITH u AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label, CAST(pos AS INT) AS pos, round(max(CAST(x AS DOUBLE)), 6) AS x FROM u GROUP BY label, pos",
    "batch_numbers": "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) SELECT i // 128 AS batch_no, count(*) AS n, min(doc_id) AS first FROM r GROUP BY 1",
    "best_so_far": "SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM events",
    "best_of_all": "SELECT event_id, value, max(value) OVER (ORDER BY event_id) AS best FROM events",
    "rank_by_class": "SELECT label, vec_id, CAST(row_number() OVER (ORDER BY label, vec_id) - 1 AS BIGINT) AS row_id FROM embeddings",
}
