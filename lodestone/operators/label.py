"""Majority filters, promotion, labels, deduplication and scoring of mentions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..storage import materialise


def is_doi(c: Column) -> Column:
    return c.startswith("https://doi.org/")


def majority_filter(found: DataFrame, key="doc_id") -> DataFrame:
    """Of the accessions of an article (with pmc_ids, ext_ids), those with its commonest PMC id, else with its commonest
    external id, else all; DOIs pass. Ties go to the smallest id."""
    found = materialise(found.sparkSession, found, "found")  # it is counted and filtered
    tagged = lambda c, kind: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("id")))
    ids = found.where(~is_doi(F.col("dataset_id"))).select(key, F.explode(F.concat(tagged("pmc_ids", "pmc"), tagged("ext_ids", "ext"))).alias("i"))
    n = ids.groupBy(key, "i").agg(F.count("*").alias("n"))
    top = lambda kind: F.min_by(F.when(F.col("i.kind") == kind, F.col("i.id")), F.when(F.col("i.kind") == kind, F.struct(-F.col("n"), F.col("i.id"))))
    d = found.join(n.groupBy(key).agg(top("pmc").alias("top_pmc"), top("ext").alias("top_ext")), key, "left")
    keep = F.when(is_doi(F.col("dataset_id")), True).when(F.col("top_pmc").isNotNull(), F.array_contains("pmc_ids", F.col("top_pmc"))).when(F.col("top_ext").isNotNull(), F.array_contains("ext_ids", F.col("top_ext"))).otherwise(True)
    return d.where(keep).drop("top_pmc", "top_ext")


def rule_label(dataset_id: Column, section: Column) -> Column:
    """Samples are primary in the body; all else is secondary."""
    return F.when((section != "references") & ~is_doi(dataset_id) & dataset_id.startswith("SAMN"), "Primary").otherwise("Secondary")


def promote(labelled: DataFrame, group, kind="type", least=10, exempt: Column | None = None) -> DataFrame:
    """Groups with ``least`` primary rows become primary as a whole. Groups are counted, then joined back, so that a large
    one needs no task of its own."""
    keys = list(group)
    rows = labelled if exempt is None else labelled.where(~exempt)
    go = rows.where(F.col(kind) == "Primary").groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    same = functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    d = labelled.join(go, same if exempt is None else same & ~exempt, "left")
    return d.withColumn(kind, F.when(F.col("__n").isNotNull(), "Primary").otherwise(F.col(kind))).select(*labelled.columns)


def one_label(labelled: DataFrame, keys=("article_id", "dataset_id"), kind="type") -> DataFrame:
    """One row for each key; Primary, which sorts first, wins. Rows without a label go."""
    return labelled.where(F.col(kind).isNotNull()).groupBy(*keys).agg(F.min(kind).alias(kind))


#: Rows that one range of ``with_row_ids`` holds, and the most values that are looked at to find the ranges.
RANGE_ROWS, LOOKED_AT = 1_000_000, 20_000


def with_row_ids(df: DataFrame, *order: str) -> DataFrame:
    """row_id from 0 in the given order. Rows fall into ranges between a bounded sample of values of the order's columns,
    as many as their number asks for; ranges are counted, then numbered within, so that no task sorts all rows. Small
    tables are one range."""
    df = materialise(df.sparkSession, df, "rows")  # it is counted, sampled and numbered
    n = df.count()
    splits = min(LOOKED_AT, -(-n // RANGE_ROWS))
    if splits <= 1:
        return df.withColumn("row_id", (F.row_number().over(W.orderBy(*order)) - 1).cast("long"))  # RANGE_ROWS rows at most
    key, whole = F.struct(*order), functools.reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in order))
    picked = df.where(whole & (F.pmod(F.xxhash64(*order), F.lit(max(1, n // LOOKED_AT))) == 0)).select(*order).distinct()
    values = sorted(map(tuple, picked.orderBy(F.xxhash64(*order)).limit(LOOKED_AT).collect()))
    at = [values[k] for k in sorted({len(values) * k // splits for k in range(splits)})] if values else []
    bounds = df.sparkSession.createDataFrame(at, df.select(*order).schema).select(F.array_sort(F.collect_list(F.struct(*order))).alias("__b"))
    bounds = bounds.withColumn("__b", F.coalesce("__b", F.array().cast(bounds.schema["__b"].dataType)))
    # the range of a row: how many bounds are not above it, found by halving
    halve = lambda acc, _: F.when(acc["lo"] < acc["hi"], F.when(F.get("__b", F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")) <= key, F.struct((F.floor((acc["lo"] + acc["hi"]) / 2) + 1).cast("int").alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), F.floor((acc["lo"] + acc["hi"]) / 2).cast("int").alias("hi")))).otherwise(acc)
    steps = F.sequence(F.lit(1), F.lit(len(at).bit_length() + 1))
    d = df.join(F.broadcast(bounds)).withColumn("__p", F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size("__b").alias("hi")), halve, lambda acc: acc["lo"])).drop("__b")
    sizes = d.groupBy("__p").agg(F.count("*").alias("__n"))
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(W.partitionBy("__p").orderBy(*order)) - 1
    d = d.withColumn("__i", inside).join(F.broadcast(sizes.drop("__n")), "__p")  # a row a range
    return d.withColumn("row_id", (F.col("__before") + F.col("__i")).cast("long")).drop("__p", "__i", "__before")


def outcome(labels: DataFrame, predictions: DataFrame, keys) -> DataFrame:
    """Full outer join with ``outcome``: tp, fp or fn."""
    a, b = labels.select(*keys).withColumn("__l", F.lit(1)), predictions.select(*keys).withColumn("__p", F.lit(1))
    return a.join(b, list(keys), "full_outer").withColumn("outcome", F.when(F.col("__l").isNull(), "fp").when(F.col("__p").isNull(), "fn").otherwise("tp")).drop("__l", "__p")


def f1(outcomes: DataFrame, slice_: Column | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of the whole ('overall') and, if given, of each slice, in one pass."""
    d = outcomes.withColumn("slice", F.lit("overall") if slice_ is None else slice_)
    n = [F.count_if(F.col("outcome") == k).alias(k) for k in ("tp", "fp", "fn")]
    if slice_ is None:
        g = d.groupBy("slice").agg(*n)
    else:
        g = d.rollup("slice").agg(F.grouping("slice").alias("__g"), *n).withColumn("slice", F.when(F.col("__g") == 1, "overall").otherwise(F.col("slice"))).drop("__g")
    return f1_columns(g)


def scored_labels(labels: DataFrame, key="article_id") -> DataFrame:
    """Labels without 'Missing', and without any article that has one."""
    return labels.where("type <> 'Missing'").join(labels.where("type = 'Missing'").select(key).distinct(), key, "left_anti")


def difference(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Distinct keys of a that b lacks."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), list(keys), "left_anti")


def primary_gate(context: Column) -> Column:
    return context.rlike(rules.PRIMARY_WORDS)


def with_article_context(found: DataFrame, statements: DataFrame, authors: DataFrame, snippets: DataFrame) -> DataFrame:
    """Left lookups: availability statement and authors by article, repository snippets by article and registrant."""
    d = found.withColumn("registrant", F.when(is_doi(F.col("dataset_id")), F.split(F.regexp_replace("dataset_id", "^https://doi.org/", ""), "/")[0]))
    return d.join(statements, "doc_id", "left").join(authors, "doc_id", "left").join(snippets, ["doc_id", "registrant"], "left")


ANSWERS = {"A": "Primary", "B": "Secondary"}


def asked(found: DataFrame) -> DataFrame:
    """Adds ``task``, which classifier a mention goes to: 'accession' (the body's accessions with a primary word nearby),
    'doi' (the body's DOIs), 'reference' (all of the references); null for mentions without a label so far, viral isolates
    and accessions that the gate stops, which keep the label they have."""
    doi = is_doi(F.col("dataset_id"))
    body = F.when(doi, "doi").when(~F.startswith("dataset_id", F.lit("EPI_ISL_")) & primary_gate(F.col("context")), "accession")
    return found.withColumn("task", F.when(F.col("type").isNotNull(), F.when(F.col("section") == "references", "reference").otherwise(body)))


def prompts(found: DataFrame, most: int = 1000) -> DataFrame:
    """Adds ``data_information``, what a classifier is told beside the context: for references the snippets of the DOI's
    repository, then the statement; for accessions the statement; ``most`` characters of it. Authors stand beside it."""
    statement = F.coalesce("statement", F.lit(""))
    told = F.when(F.col("task") == "reference", F.concat(F.coalesce("snippet", F.lit("")), statement)).when(F.col("task") == "accession", statement)
    return found.withColumn("data_information", F.left(told, F.lit(most)))


def answered(found: DataFrame, answers: DataFrame, keys) -> DataFrame:
    """Labels by the answers (keys, choice) of a classifier: A is primary and B secondary; any other answer, or none, is
    no label for an accession and secondary for the rest. Mentions without a task keep theirs."""
    a = answers.select(*keys, F.col("choice").alias("__choice")).dropDuplicates(list(keys))
    d = found.join(a, list(keys), "left")
    by = F.when(F.col("__choice") == "A", ANSWERS["A"]).when((F.col("__choice") == "B") | (F.col("task") != "accession"), ANSWERS["B"])
    return d.withColumn("type", F.when(F.col("task").isNull(), F.col("type")).otherwise(by)).drop("__choice")


def scored_by(rows: DataFrame, scorer, schema: str) -> DataFrame:
    """Answers of a pluggable scorer: it maps Arrow batches to Arrow batches of ``schema`` (a model client, say). By
    default answers are a column that was worked out before (``answered``)."""
    return rows.mapInArrow(scorer, schema)


def cover_authors(covers: DataFrame, scorer=None, key="doc_id", most: int = 2000) -> DataFrame:
    """(key, authors) from covers: a scorer reads the first ``most`` characters of ``cover`` and gives (key, answer); by
    default the column ``answer`` is there already."""
    from ..functions.text import tagged_authors

    asked = covers.withColumn("cover", F.left("cover", F.lit(most)))
    got = asked if scorer is None else asked.mapInArrow(scorer, f"{key} {covers.schema[key].dataType.simpleString()}, answer string")
    return got.select(key, tagged_authors(F.col("answer")).alias("authors"))


def f1_of_matches(labels: DataFrame, predictions: DataFrame, keys) -> DataFrame:
    """One row of scores from an inner join on all ``keys``: repeated rows count as often as they meet."""
    hits = labels.select(*keys).join(predictions.select(*keys), list(keys)).agg(F.count("*").alias("tp"))
    n = lambda d, c: d.agg(F.count("*").alias(c))
    d = hits.join(F.broadcast(n(predictions, "claimed"))).join(F.broadcast(n(labels, "support")))  # one row each
    d = d.select("tp", (F.col("claimed") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"))
    return f1_columns(d)


def f1_columns(d: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp and fn; 0 where there is nothing to divide by."""
    d = d.withColumn("precision", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)))
    d = d.withColumn("recall", F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0)))
    return d.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def confusion(df: DataFrame, label: str, predicted: str, classes) -> DataFrame:
    return df.groupBy(label).pivot(predicted, list(classes)).count().na.fill(0)


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every class."""
    t = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("support"), F.count_if(F.col(label) == F.col(predicted)).alias("hits"))
    p = df.groupBy(F.col(predicted).alias("class")).agg(F.count("*").alias("claimed"))
    d = t.join(p, "class", "full_outer").na.fill(0)
    d = d.withColumn("precision", F.coalesce(F.try_divide("hits", "claimed"), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("hits", "support"), F.lit(0.0)))
    return d.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))).select("class", "support", "precision", "recall", "f1")
