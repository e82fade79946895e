"""Filters and lookups over mentions, and triage of DOIs. Small reference tables are joined, never collected."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as tx


def starts_with_any(c: Column, prefixes) -> Column:
    """One alternation: cheaper to plan and to run than a test for each."""
    return c.rlike("^(?:" + "|".join(map(re.escape, prefixes)) + ")")


def contains_any(c: Column, words) -> Column:
    return c.rlike("|".join(map(re.escape, words)))


def doi_rejected(doi: Column, article_id: Column, *, journals=rules.JOURNALS, exempt: tuple[str, ...] = ()) -> Column:
    """The article's own registrant, a truncated DOI, a journal, or a last segment under 4 characters."""
    own = F.contains(doi, F.split(article_id, "_")[0])
    short = F.length(tx.last_segment(doi)) < 4
    if exempt:
        short &= ~starts_with_any(doi, exempt)
    return own | doi.isin(*rules.TRUNCATED) | contains_any(F.lower(doi), journals) | short


def canonical(found: DataFrame) -> DataFrame:
    """Adds ``dataset_id``: DOIs as lower-case links with aliases resolved, accessions as cleaned text; what has
    unbalanced brackets goes."""
    clean = tx.match_text(F.col("value"))
    is_doi = F.col("pattern_name").startswith("doi")
    return found.withColumn("clean", clean).where(tx.balanced(F.col("clean"))).withColumn("dataset_id", F.when(is_doi, tx.doi_url(tx.aliased(F.col("clean")))).otherwise(F.col("clean"))).drop("clean")


def known_dois(found: DataFrame, known: DataFrame) -> DataFrame:
    """Mentions whose DOI stands in ``known`` (doi, bare or as a link)."""
    k = known.select(tx.doi_url(tx.bare_doi(F.col("doi"))).alias("dataset_id")).distinct()
    return found.join(k, "dataset_id", "left_semi")


def known_registrants(found: DataFrame, known: DataFrame) -> DataFrame:
    k = known.select(tx.registrant(tx.bare_doi(F.col("doi"))).alias("__r")).distinct()
    return found.withColumn("__r", tx.registrant(tx.bare_doi(F.col("dataset_id")))).join(k, "__r", "left_semi").drop("__r")


def in_catalog(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Accessions that the catalog (id) holds, by case."""
    return found.join(catalog.select(F.col("id").alias("dataset_id")).distinct(), "dataset_id", "left_semi")


def with_catalog_ids(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds pmc_ids and ext_ids, empty if the catalog has none."""
    none = F.array().cast("array<string>")
    c = catalog.select(F.col("id").alias("dataset_id"), "pmc_ids", "ext_ids")
    return found.join(c, "dataset_id", "left").withColumns({k: F.coalesce(k, none) for k in ("pmc_ids", "ext_ids")})


def doi_or_has_xml(found: DataFrame, xml_articles: DataFrame, key="doc_id") -> DataFrame:
    """DOIs, and whatever else stands in articles that have XML."""
    m = xml_articles.select(key).distinct().withColumn("__xml", F.lit(True))
    return found.join(m, key, "left").where(F.col("dataset_id").startswith("https://doi.org/") | F.col("__xml")).drop("__xml")


def not_blank(c: Column) -> Column:
    return F.coalesce(F.length(F.btrim(c, F.lit(" \t\r\n"))) > 0, F.lit(False))


def likely_dataset(doi: Column) -> Column:
    d, low = tx.bare_doi(doi), F.lower(tx.bare_doi(doi))
    ends = low.rlike("(?:" + "|".join(map(re.escape, rules.ARTICLE_ENDINGS)) + ")$")
    return ~starts_with_any(d, rules.ARTICLE_REGISTRANTS) & ~contains_any(low, rules.ARTICLE_WORDS) & F.length(d).between(10, 100) & F.contains(d, F.lit("/")) & ~ends


def triage(doi: Column) -> Column:
    """'dataset' (a repository's), 'lookup' (may be one), 'drop'."""
    listed = starts_with_any(tx.bare_doi(doi), rules.REPOSITORIES)
    return F.when(doi.isNull() | (doi == ""), "drop").when(listed, "dataset").when(likely_dataset(doi), "lookup").otherwise("drop")


def looked_up(references: DataFrame, index: DataFrame) -> DataFrame:
    """``references`` (article_id, doi) with ``kind`` (see ``triage``) and ``found``: a repository's, or one that may be a
    dataset and stands in ``index`` (doi)."""
    t = references.withColumn("kind", triage(F.col("doi"))).withColumn("__d", F.when(F.col("kind") == "lookup", tx.bare_doi(F.lower("doi"))))
    hit = index.select(tx.bare_doi(F.lower("doi")).alias("__d")).distinct().withColumn("__hit", F.lit(True))
    return t.join(hit, "__d", "left").withColumn("found", (F.col("kind") == "dataset") | F.col("__hit").isNotNull()).drop("__d", "__hit")


def resolve(references: DataFrame, index: DataFrame) -> DataFrame:
    """(article_id, doi) of ``references`` that are datasets."""
    return looked_up(references, index).where("found").drop("kind", "found")


def datasets_by_article(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy(tx.doi_key(F.col("article_id")).alias("article_key")).agg(F.array_sort(F.collect_list("doi")).alias("datasets"))


def resolver_summary(references: DataFrame, index: DataFrame) -> DataFrame:
    """One row: the counters of a run, and the shares made of them. Equal references are triaged once."""
    g = looked_up(references.groupBy("article_id", "doi").agg(F.count("*").alias("n")), index)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    found, kind = F.col("found"), F.col("kind")
    out = g.agg(
        F.count_distinct("article_id").alias("total_articles"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_dois"), *(n(kind == k).alias(f"n_{k}") for k in ("dataset", "lookup", "drop")),
        n(found).alias("total_datasets_found"), n((kind == "lookup") & ~found).alias("filtered_dois"),
        F.count_distinct(F.when(found, F.col("doi"))).alias("total_unique_datasets"), F.count_distinct(F.when(found, F.col("article_id"))).alias("articles_with_datasets"),
    )
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 9)
    return out.withColumn("articles_share", share(F.col("articles_with_datasets"), F.col("total_articles"))).withColumn("lookup_success", share(F.col("total_datasets_found") - F.col("n_dataset"), F.col("n_lookup")))


def violations(**checks: Column) -> Column:
    """Names of the checks that fail, as an array."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
