"""Queries of the citation-mining operators, with the SQL that gives the same rows.

The driver's texts hold no identifiers, so the same expression adds some to every document, in Spark and in SQL alike:
a repository DOI, an archive's short name, two accessions, a journal DOI, and a bibliography for every third document.
That part of the input is synthetic; the rest of each text is scanned as it is.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import text as tx
from ..operators import label, matching, segment, validate, xmltext

INJECTED = (
    "coalesce(text, '') || ' Data deposited in Dryad at 10.5061/dryad.' || CAST(doc_id % 97 AS STRING) || 'abcd and zenodo.' || CAST(1000 + doc_id % 37 AS STRING)"
    " || ' under accession GSE' || CAST(10000 + doc_id % 50 AS STRING) || ' and SAMN0' || CAST(1000 + doc_id % 20 AS STRING)"
    " || ' (Zenodo hosted); see 10.1038/s41586-' || CAST(doc_id % 11 AS STRING) || 'xy.'"
    " || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'References' || repeat(chr(10) || '[1] Smith J. (2020) A title. doi:10.1234/abc' || CAST(doc_id % 5 AS STRING), 6) ELSE '' END"
)
#: The catalogs, from the ids of documents.
KNOWN = "SELECT DISTINCT '10.5061/dryad.' || CAST(doc_id % 97 AS STRING) || 'abcd' AS doi FROM documents WHERE doc_id % 97 < 60 UNION SELECT DISTINCT '10.5281/zenodo.' || CAST(1000 + doc_id % 37 AS STRING) AS doi FROM documents WHERE doc_id % 37 < 20"
CATALOG = (
    "SELECT id, pmc, ext FROM (SELECT 'GSE' || CAST(10000 + doc_id % 50 AS STRING) AS id, 'PMC' || CAST(doc_id % 4 AS STRING) AS pmc, 'EXT' || CAST(doc_id % 3 AS STRING) AS ext FROM documents WHERE doc_id % 50 < 35"
    " UNION ALL SELECT 'SAMN0' || CAST(1000 + doc_id % 20 AS STRING), 'PMC' || CAST(doc_id % 4 AS STRING), CAST(NULL AS STRING) FROM documents WHERE doc_id % 20 < 15) x"
)
ACCESSIONS = ("geo_id", "biosample_id")
_P = "'<p>' || p_name || '</p><p>Brand <b>' || p_brand || '</b>, size ' || CAST(p_size AS STRING) || '</p>'"
ARTICLES = (
    "SELECT p_partkey, CASE p_partkey % 6"
    f" WHEN 0 THEN '<TEI xmlns=\"http://www.tei-c.org/ns/1.0\"><text><body>' || {_P} || '</body><back><listBibl><biblStruct>Smith J (2020) ' || p_type || '</biblStruct></listBibl></back></text></TEI>'"
    f" WHEN 1 THEN '<!DOCTYPE article PUBLIC \"-//NLM//DTD x\" \"x.dtd\"><article><body><sec>' || {_P} || '</sec></body><back><ack><p>Thanks.</p></ack><ref-list><ref>' || p_type || '.</ref></ref-list></back></article>'"
    f" WHEN 2 THEN '<component xmlns=\"http://www.wiley.com/namespaces/wiley\"><body>' || {_P} || '</body><bibliography><bib>' || p_type || '</bib></bibliography></component>'"
    " WHEN 3 THEN '<!DOCTYPE collection SYSTEM \"BioC.dtd\"><collection><passage><infon key=\"section_type\">REF</infon><infon key=\"name_0\">surname:Smith;given-names:J</infon><text>' || p_name || '</text></passage><passage><text>' || p_type || '</text></passage></collection>'"
    f" WHEN 4 THEN '<doc>' || {_P} || '</doc>' ELSE '<p>broken ' || p_name END AS content FROM part"
)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark, df):
    """Short rows of a table in few files, or few row groups, dealt to all cores before much is done with each."""
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def docs(spark, sf_dir, keep=("doc_id",)):
    return table(spark, sf_dir, "documents").select(*keep, F.expr(INJECTED).alias("text"))


def sql_of(spark, sf_dir, sql, *names):
    """A statement over tables given by parameter, without registered views."""
    return spark.sql(_named(sql, names), **{n: table(spark, sf_dir, n) for n in names})


def _named(sql, names):
    for n in names:
        sql = sql.replace(f"FROM {n}", "FROM {" + n + "}").replace(f"JOIN {n}", "JOIN {" + n + "}")
    return sql


def known(spark, sf_dir):
    return sql_of(spark, sf_dir, KNOWN, "documents")


def catalog(spark, sf_dir):
    from ..sources.files import catalog_sets

    return catalog_sets(sql_of(spark, sf_dir, CATALOG, "documents").withColumn("source", F.lit("catalog")))


def found(spark, sf_dir, names):
    d = docs(spark, sf_dir).select("doc_id", F.col("text").alias("body"), F.lit("").alias("refs"))
    return validate.canonical(matching.mentions(d, names=names))


def doi_mentions(spark, sf_dir):
    return found(spark, sf_dir, ("doi", "doi2")).select("doc_id", "pattern_name", "value", "dataset_id")


def match_offsets(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", F.inline(matching.all_matches(F.col("text"), f"(?i){rules.DOI}"))).select("doc_id", "start", "end", "value")


def _valid(spark, sf_dir):
    m = found(spark, sf_dir, ("doi", "doi2"))
    m = m.where(~validate.doi_rejected(tx.bare_doi(F.col("dataset_id")), F.concat(F.lit("10.9999_"), F.col("doc_id").cast("string"))))
    k = known(spark, sf_dir)
    return validate.known_dois(validate.known_registrants(m, k), k)


def doi_valid(spark, sf_dir):
    """The flagship: extract, normalise, filter, semi-join, deduplicate, number."""
    m = _valid(spark, sf_dir).select(F.concat(F.lit("10.9999_"), F.col("doc_id").cast("string")).alias("article_id"), "dataset_id", F.lit("Secondary").alias("type"))
    return label.with_row_ids(label.one_label(m), "article_id", "dataset_id").select("row_id", "article_id", "dataset_id", "type")


def accession_valid(spark, sf_dir):
    m = found(spark, sf_dir, ACCESSIONS).where("near")
    return validate.in_catalog(m, catalog(spark, sf_dir)).select("doc_id", "pattern_name", "dataset_id", "start")


def recovery_pass(spark, sf_dir):
    """Identifiers that stand only in the last 120 characters of a text, by the first pattern: what a pass over all before
    has not found. Both passes are one scan."""
    d = docs(spark, sf_dir).select("doc_id", (F.length("text") - 120).alias("seen"), F.col("text").alias("body"), F.lit("").alias("refs"))
    raw = matching.mentions(d, names=("doi", "doi2", *ACCESSIONS), keep=("doc_id", "seen"))
    return matching.recovered(raw.withColumn("known", F.col("end") <= F.col("seen"))).select("doc_id", "value", "pattern_name")


def keyword_clusters(spark, sf_dir):
    d = docs(spark, sf_dir)
    return matching.clusters(matching.prefixed(d), d)


def repository_snippets(spark, sf_dir):
    return matching.snippets(keyword_clusters(spark, sf_dir))


def reference_cut(spark, sf_dir):
    return segment.bibliography_cut(docs(spark, sf_dir))


def last_heading_cut(spark, sf_dir):
    return segment.last_heading_cut(docs(spark, sf_dir))


def divided(spark, sf_dir):
    d = docs(spark, sf_dir)
    return segment.divide(d, segment.bibliography_cut(d)).select("doc_id", F.length("body").alias("n_body"), F.length("refs").alias("n_refs"), F.md5(F.col("refs").cast("binary")).alias("refs_md5"))


def year_line_filter(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit("(2020) A"), F.lit("(2020b). A")).alias("text"))
    return d.select("doc_id", F.md5(tx.without_citation_years(F.col("text")).cast("binary")).alias("kept_md5"))


def text_rules(spark, sf_dir):
    """The rules that no other query goes through, over made-up texts, a column each."""
    k = F.col("p_partkey").cast("string")
    of = {
        "cleaned": (tx.generic_clean, (" a<br>b", k, " 1.  2 / c\n\n\nd\n&e re\\_x non-\nstop so\u00ad ft\u200b ")),
        "fenced": (tx.fenced_json, ('so:\n```json\n{"k": ', k, "}\n```\nend")),
        "linked": (tx.page_links_resolved, ("[2](#page-1-", k, ") [3](#page-9-9)\n- <span id=\"page-1-", k, "\"></span> 10.1234/AB", k, ", 10.1234/x;y. 10.1234/AB", k, "\n\n10.9999/no")),
        "unspanned": (tx.without_span_lines, ("x", k, '\n -  <span id="page-1-b"></span>z\ny\n')),
        "joined": (tx.xml_doi_space, ("10.1234 / ab", k, " and 10.5/ x")),
        "head": (segment.markdown_cut, ("# T", k, "\nbody\n## **References**\n1")),
    }
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", *(rule(F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in parts))).alias(name) for name, (rule, parts) in of.items()), F.array_join(segment.sentences(F.concat(F.lit("One"), k, F.lit(". Two! Dr. Three?  end"))), "|").alias("sentences"))


def spaced_headings(spark, sf_dir):
    """Blank lines around headings; those that end in a full stop stay."""
    ends = F.when(F.col("doc_id") % 2 == 0, F.lit("\nReferences Cited.\nREFERENCES \n2. Bibliography\nthe References")).otherwise("")
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.spaced_headings(F.concat("text", ends)).cast("binary")).alias("text_md5"))


def balanced_ids(spark, sf_dir):
    s = F.concat(F.lit("10.5061/"), F.when(F.col("p_partkey") % 3 == 0, "(").otherwise(""), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ")").otherwise(""), F.when(F.col("p_partkey") % 5 == 0, "[a]").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", s.alias("s")).where(tx.balanced(F.col("s")))


def availability_header(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 4 == 0, F.lit("\nData availability: all data are in the archive.")).otherwise("")).alias("text"))
    d = d.select("doc_id", F.regexp_instr("text", F.lit(rules.AVAILABILITY_HEADER)).alias("pos"), matching.availability_header(F.col("text")).alias("statement"))
    return d.where("pos > 0")


#: A sentence of its own behind each text, with all that the sentence rule wants or one thing missing; for some a heading.
STATED = (
    "coalesce(text, '') || ' end! ' || CASE doc_id % 3 WHEN 0 THEN 'The data were deposited in Dryad under number ' || CAST(doc_id AS STRING) || '.' WHEN 1 THEN 'They are with Zenodo for now.'"
    " ELSE 'All was deposited ' || repeat('with much care ', 15) || 'in Dryad.' END || ' Then more!' || CASE WHEN doc_id % 4 = 0 THEN ' Data Availability: on request.' ELSE '' END"
)


def availability_statement(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(STATED).alias("text"))
    return d.select("doc_id", matching.availability(F.col("text")).alias("a")).select("doc_id", "a.*")


def catalog_group_sets(spark, sf_dir):
    return catalog(spark, sf_dir).select("id", "pmc_ids", "ext_ids")


def _with_ids(spark, sf_dir):
    return validate.with_catalog_ids(found(spark, sf_dir, ("doi", *ACCESSIONS)).select("doc_id", "dataset_id"), catalog(spark, sf_dir))


def majority_filter(spark, sf_dir):
    """Mentions of 8 documents taken as one article."""
    m = _with_ids(spark, sf_dir).withColumn("article", F.floor(F.col("doc_id") / 8).cast("long"))
    return label.majority_filter(m, "article").select("article", "doc_id", "dataset_id")


def xml_filter(spark, sf_dir):
    m = found(spark, sf_dir, ("doi", *ACCESSIONS)).select("doc_id", "dataset_id")
    return validate.doi_or_has_xml(m, table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id"))


def union_mentions(spark, sf_dir):
    a = found(spark, sf_dir, ("doi",)).select("doc_id", "dataset_id", F.lit("body").alias("section"))
    return a.unionByName(found(spark, sf_dir, ("doi2",)).select("doc_id", "dataset_id", F.lit("references").alias("section")))


def rule_labels(spark, sf_dir):
    m = found(spark, sf_dir, ("doi", *ACCESSIONS)).select("doc_id", "dataset_id")
    return m.select("doc_id", "dataset_id", label.rule_label(F.col("dataset_id"), F.lit("body")).alias("type"))


#: Texts that hold their identifier in several forms, and other links.
CITING = "{t} || ' see https://doi.org/10.5061/dryad.' || CAST(doc_id % 97 AS STRING) || 'abcd or HTTPS://DOI.ORG/10.5061/DRYAD.' || CAST(doc_id % 97 AS STRING) || 'abcd at http://example.org/x<y>'"


def cite_marks(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.expr(CITING.format(t="text")).alias("text"))
    ids = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("GSE"), (10000 + F.col("doc_id") % 50).cast("string"))).otherwise(F.concat(F.lit("https://doi.org/10.5061/dryad."), (F.col("doc_id") % 97).cast("string"), F.lit("abcd")))
    return d.select("doc_id", tx.cited(F.col("text"), F.when(F.col("doc_id") % 7 != 0, ids)).alias("marked"))


def label_links(spark, sf_dir):
    """Labels before links, and links that repeat, of both kinds."""
    u, d = "'http://e.org/' || CAST(p_partkey AS STRING)", "'10.1234/Ab' || CAST(p_partkey AS STRING)"
    text = f"'see [here](' || {u} || ') or (' || {u} || ')(' || {u} || ') end (' || {u} || ') - (' || {u} || '); [' || p_name || ' and a label far too long to go](' || {d} || ') [x](' || {d} || ')(' || lower({d}) || ')(' || {d} || ').'"
    p = dealt(spark, table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", F.expr(text).alias("t"))
    return p.select("p_partkey", tx.without_labels(F.col("t")).alias("urls"), tx.without_labels(F.col("t"), "doi").alias("dois"))


def quotes_and_authors(spark, sf_dir):
    answer = F.concat(F.lit("<authors>"), F.col("p_name"), F.lit('; "'), F.col("p_brand"), F.lit('"</authors> and more'))
    p = label.cover_authors(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("cover"), answer.alias("answer")), key="p_partkey")
    return p.select("p_partkey", tx.single_quoted(F.col("authors")).alias("authors"))


def link_repairs(spark, sf_dir):
    """Links broken in all ways that the rewrites know, by part."""
    k = F.col("p_partkey").cast("string")
    t = F.concat(F.lit("a https:// doi. org/10. 1234/ x"), k, F.lit("- b- c- d- e (see 10.1234/ab"), k, F.lit(" cd) \n\nhttps://doi.org/10.5061/z"), k, F.lit(" doi.org/ 10.99999/ q"), k, F.lit(". rest, and 10.4321/p. DATA end"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.repair_links(t).alias("text"))


def line_contexts(spark, sf_dir):
    d = docs(spark, sf_dir)
    m = d.select("doc_id", "text", F.inline(matching.all_matches(F.col("text"), r"GSE\d+")))
    return m.select("doc_id", "start", matching.line_context(F.col("text"), F.col("start"), F.col("end")).alias("context"))


def sentence_contexts(spark, sf_dir):
    m = docs(spark, sf_dir).select("doc_id", "text", F.inline(matching.all_matches(F.col("text"), r"GSE\d+")))
    return m.select("doc_id", "start", matching.sentence_context(F.col("text"), F.col("start"), F.col("end")).alias("context"))


def fixed_windows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(segment.windows(F.col("text"))).alias("pos", "window")).select("doc_id", "pos", F.md5(F.col("window").cast("binary")).alias("window_md5"))


def smart_chunks(spark, sf_dir):
    return segment.chunked(table(spark, sf_dir, "documents"))


def heading_chunks(spark, sf_dir):
    return segment.chunked(table(spark, sf_dir, "documents"), keep_headings=True)


def normalise_nfkc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalised(F.col("text")).alias("text"))


def page_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.page_text(F.col("text")).alias("text"))


def xml_documents(spark, sf_dir):
    """Articles of every dialect, made from parts."""
    return xmltext.xml_text(sql_of(spark, sf_dir, ARTICLES, "part"), key="p_partkey").select("p_partkey", "kind", "text", "method")


def page_plain_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", xmltext.plain_text(F.col("html")).alias("text"))


def simple_ids(spark, sf_dir):
    return matching.distinct_values(docs(spark, sf_dir))


def headings_cut(spark, sf_dir):
    """The oldest rule for bibliographies."""
    return segment.divided_by_headings(docs(spark, sf_dir)).select("doc_id", F.md5(F.col("body").cast("binary")).alias("body_md5"), F.md5(F.col("refs").cast("binary")).alias("refs_md5"))


def article_context(spark, sf_dir):
    m = found(spark, sf_dir, ("doi",)).select("doc_id", "dataset_id")
    a = table(spark, sf_dir, "documents")
    statements = a.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("statement "), F.col("doc_id").cast("string")).alias("statement"))
    authors = a.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("author "), F.col("source")).alias("authors"))
    snippets = a.where("doc_id % 5 = 0").select("doc_id", F.lit("10.5061").alias("registrant"), F.lit("Dryad").alias("snippet"))
    return label.with_article_context(m, statements, authors, snippets).select("doc_id", "dataset_id", "statement", "authors", "snippet")


def _references(spark, sf_dir):
    """References of each order's article: DOIs of repositories, articles and others, by part."""
    return sql_of(spark, sf_dir, REFERENCES, "lineitem")


REFERENCES = (
    "SELECT 'https://doi.org/10.1234/a' || CAST(l_orderkey % 500 AS STRING) AS article_id, CASE l_partkey % 6 WHEN 0 THEN 'https://doi.org/10.5281/zenodo.' || CAST(l_partkey AS STRING)"
    " WHEN 1 THEN '10.1038/s41586-' || CAST(l_partkey AS STRING) WHEN 2 THEN '10.9876/data.' || CAST(l_partkey AS STRING) WHEN 3 THEN '10.9876/journal.' || CAST(l_partkey AS STRING)"
    " WHEN 4 THEN '10.24440/x' || CAST(l_partkey AS STRING) ELSE '10.9876/file' || CAST(l_partkey AS STRING) || '.pdf' END AS doi FROM lineitem"
)
INDEX = "SELECT DISTINCT '10.9876/data.' || CAST(p_partkey AS STRING) AS doi FROM part WHERE p_partkey % 4 = 0"


def doi_triage(spark, sf_dir):
    return _references(spark, sf_dir).groupBy(validate.triage(F.col("doi")).alias("kind")).agg(F.count("*").alias("n"))


def datasets_by_article(spark, sf_dir):
    return validate.datasets_by_article(validate.resolve(_references(spark, sf_dir), sql_of(spark, sf_dir, INDEX, "part")))


def resolver_summary(spark, sf_dir):
    return validate.resolver_summary(_references(spark, sf_dir), sql_of(spark, sf_dir, INDEX, "part"))


QUERIES = {
    f.__name__: f
    for f in (
        doi_mentions, match_offsets, doi_valid, accession_valid, recovery_pass, keyword_clusters, reference_cut, last_heading_cut, divided, year_line_filter, spaced_headings, balanced_ids,
        availability_header, availability_statement, catalog_group_sets, majority_filter, xml_filter, union_mentions, rule_labels, cite_marks, line_contexts, sentence_contexts, fixed_windows,
        smart_chunks, heading_chunks, normalise_nfkc, page_text, xml_documents, repository_snippets, label_links, quotes_and_authors, link_repairs, headings_cut, text_rules, page_plain_text, simple_ids, article_context, doi_triage, datasets_by_article, resolver_summary,
    )
}

# --- SQL ----------------------------------------------------------------------------------------------------------------

T = f"t AS (SELECT doc_id, {INJECTED} AS t FROM documents)"
CLEAN = "regexp_replace(regexp_replace(regexp_replace(v, '^PDB:', '', 'i'), '\\s+', '', 'g'), '[^A-Za-z0-9]+$', '')"
ALIAS = "CASE " + " ".join(f"WHEN starts_with(lower(c), '{a}') THEN '{r}' || lower(c)" for a, r in rules.ALIASES.items()) + " ELSE lower(c) END"
BALANCED = (
    "(len(regexp_replace(c, '[^(]', '', 'g')) = len(regexp_replace(c, '[^)]', '', 'g')) AND len(regexp_replace(c, '[^\\[]', '', 'g')) = len(regexp_replace(c, '[^\\]]', '', 'g'))"
    " AND strpos(c, ')') >= strpos(c, '(') * CAST(strpos(c, ')') > 0 AS INT))"
)


def _mentions(*names):
    parts = []
    for priority, (name, ci, pattern) in enumerate(rules.PATTERNS, 1):
        if name in names:
            p = ("(?i)" if ci else "") + pattern
            parts.append(f"SELECT doc_id, '{name}' AS pattern_name, {priority} AS priority, unnest(regexp_extract_all(t, '{p}')) AS v FROM t")
    is_doi = "starts_with(pattern_name, 'doi')"
    return f"{T}, r AS ({' UNION ALL '.join(parts)}), k AS (SELECT *, {CLEAN} AS c FROM r), m AS (SELECT doc_id, pattern_name, v AS value, CASE WHEN {is_doi} THEN 'https://doi.org/' || {ALIAS} ELSE c END AS dataset_id FROM k WHERE {BALANCED})"


def _offsets(pattern, start="s", end="e"):
    """(doc_id, t, v, start, end) of each match, from the lengths of what lies between."""
    return (
        f"x AS (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs FROM t), y AS (SELECT doc_id, t, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM x WHERE len(ms) > 0), "
        f"o AS (SELECT doc_id, t, ms[i] AS v, CAST(coalesce(list_sum(list_transform(gs[1:i], lambda q: len(q))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda q: len(q))), 0) AS INTEGER) AS {start} FROM y), "
        f"p AS (SELECT *, CAST({start} + len(v) AS INTEGER) AS {end} FROM o)"
    )


_HITS = ", ".join(f"h{k} AS (WITH {_offsets(w)} SELECT doc_id, t, s, e, '{p}' AS prefix FROM p)" for k, (p, w) in enumerate(rules.REPOSITORY_WORDS.items()))
_CLUSTERS = f"""{_HITS}, u AS ({" UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(len(rules.REPOSITORY_WORDS)))}),
      g AS (SELECT *, CASE WHEN s - lag(e) OVER w < 50 THEN 0 ELSE 1 END AS new FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY s, e, prefix)),
      n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e, prefix ROWS UNBOUNDED PRECEDING) AS k FROM g),
      q AS (SELECT doc_id, k, arg_min(prefix, (s, e, prefix)) AS prefix, min(s) AS cluster_start, arg_max(e, (s, e)) AS cluster_end, any_value(t) AS t FROM n GROUP BY doc_id, k),
      c AS (SELECT doc_id, prefix, cluster_start, cluster_end, trim(substr(t, greatest(cluster_start - 100, 0) + 1, cluster_end + 100 - greatest(cluster_start - 100, 0)), ' ') AS context FROM q)"""
# RE2 has no look-around. What the DOI's looks at is always so; book numbers stand at the end of a text alone, where none is.
_SIMPLE = " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS pattern_name, unnest(regexp_extract_all(t, '{p}', 1)) AS value FROM t"
    for n, p in (rules.SIMPLE_PATTERNS | {"doi": rules.SIMPLE_PATTERNS["doi"].replace(r"(?:\b|(?<!https://))", "")}).items() if n != "isbn"
)
CONTAINS_JOURNAL = "len(list_filter([" + ", ".join(f"'{j}'" for j in rules.JOURNALS) + "], lambda j: contains(lower(d), j))) > 0"
SQL = {
    "doi_mentions": f"WITH {_mentions('doi', 'doi2')} SELECT doc_id, pattern_name, value, dataset_id FROM m",
    "match_offsets": f"WITH {T}, {_offsets('(?i)' + rules.DOI)} SELECT doc_id, s AS start, e AS \"end\", v AS value FROM p",
    "doi_valid": f"""WITH {_mentions('doi', 'doi2')}, kn AS ({KNOWN}), d AS (SELECT doc_id, dataset_id, regexp_replace(dataset_id, '^https://doi.org/', '') AS d FROM m),
      f AS (SELECT DISTINCT '10.9999_' || CAST(doc_id AS STRING) AS article_id, dataset_id, 'Secondary' AS type FROM d WHERE NOT contains(d, '10.9999') AND d NOT IN {rules.TRUNCATED!r} AND NOT ({CONTAINS_JOURNAL})
        AND len(string_split(d, '/')[-1]) >= 4 AND split_part(d, '/', 1) IN (SELECT split_part(doi, '/', 1) FROM kn) AND dataset_id IN (SELECT 'https://doi.org/' || lower(doi) FROM kn))
      SELECT CAST(row_number() OVER (ORDER BY article_id, dataset_id) - 1 AS BIGINT) AS row_id, * FROM f""",
    "accession_valid": f"""WITH {T}, c AS ({CATALOG}), g AS (WITH {_offsets('(?i)' + dict((n, p) for n, _, p in rules.PATTERNS)['geo_id'])} SELECT doc_id, t, v, s, e, 'geo_id' AS pattern_name FROM p),
      b AS (WITH {_offsets('(?i)' + dict((n, p) for n, _, p in rules.PATTERNS)['biosample_id'])} SELECT doc_id, t, v, s, e, 'biosample_id' AS pattern_name FROM p), u AS (SELECT * FROM g UNION ALL SELECT * FROM b)
      SELECT doc_id, pattern_name, v AS dataset_id, s AS start FROM u WHERE v IN (SELECT id FROM c) AND
        regexp_matches(substr(t, greatest(s - 5000, 0) + 1, e + 5000 - greatest(s - 5000, 0)), CASE pattern_name WHEN 'geo_id' THEN '(?i){rules.CONTEXT['geo'][1]}' ELSE '(?i){rules.CONTEXT['biosample'][1]}' END)""",
    "keyword_clusters": f"WITH {T}, {_CLUSTERS} SELECT doc_id, prefix, cluster_start, cluster_end, context FROM c",
    "repository_snippets": f"""WITH {T}, {_CLUSTERS}, f AS (SELECT doc_id, prefix, context, min(cluster_start) AS s FROM c GROUP BY ALL)
      SELECT doc_id, prefix AS registrant, string_agg(context, '' ORDER BY s) AS snippet FROM f GROUP BY doc_id, prefix""",
    "reference_cut": f"""WITH {T}, l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS pos, len(string_split(t, chr(10))) AS n FROM t),
      b AS (SELECT doc_id, pos, n, trim(line, ' \t\r') AS bare FROM l), f AS (SELECT *, CAST(regexp_matches(bare, '{segment.CITATION}') AS INT) AS cites FROM b),
      w AS (SELECT *, coalesce(sum(cites) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING), 0) AS ahead, sum(cites) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS dense FROM f),
      c AS (SELECT doc_id, min(CASE WHEN pos > floor(n * 0.3) AND regexp_matches(bare, '{segment.HEADING}') AND len(bare) < 40 AND (upper(bare) = bare OR NOT regexp_matches(bare, '\\b[a-z]')) AND ahead >= 5 THEN pos END) AS h,
        min(CASE WHEN pos > floor(n * 0.3) AND pos <= n - 10 AND dense >= 9 THEN pos END) AS r FROM w GROUP BY doc_id) SELECT doc_id, CAST(coalesce(h, r) AS INTEGER) AS cut FROM c WHERE coalesce(h, r) IS NOT NULL""",
    "year_line_filter": f"""WITH {T}, r AS (SELECT doc_id, replace(t, '(2020) A', '(2020b). A') AS t FROM t), k AS (SELECT doc_id, array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '\\(\\d{{4}}[ab]?\\)\\.')), chr(10)) AS k FROM r)
      SELECT doc_id, md5(regexp_replace(k, '^\\s+|\\s+$', '', 'g')) AS kept_md5 FROM k""",
    "text_rules": """SELECT p_partkey, 'ab' || k || ' 1.2 /c' || chr(10) || 'd&e re_x non-stop soft' AS cleaned, '{"k": ' || k || '}' AS fenced,
      '[2](10.1234/ab' || k || ',10.1234/x;y) [3]' || chr(10) || '- <span id="page-1-' || k || '"></span> 10.1234/AB' || k || ', 10.1234/x;y. 10.1234/AB' || k || chr(10) || chr(10) || '10.9999/no' AS linked,
      'x' || k || chr(10) || 'y' AS unspanned, '10.1234/ab' || k || ' and 10.5/ x' AS joined, '# T' || k || chr(10) || 'body' || chr(10) AS head, 'One' || k || '.|Two!|Dr. Three?|end' AS sentences
      FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k FROM part)""",
    "balanced_ids": "WITH s AS (SELECT p_partkey, '10.5061/' || CASE WHEN p_partkey % 3 = 0 THEN '(' ELSE '' END || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN ')' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '[a]' ELSE '' END AS s FROM part) SELECT p_partkey, s FROM s WHERE (p_partkey % 3 = 0) = (p_partkey % 2 = 0)",
    "availability_header": f"""WITH t AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 4 = 0 THEN chr(10) || 'Data availability: all data are in the archive.' ELSE '' END AS t FROM documents),
      h AS (SELECT doc_id, t, strpos(t, regexp_extract(t, '{rules.AVAILABILITY_HEADER}')) AS pos FROM t WHERE regexp_matches(t, '{rules.AVAILABILITY_HEADER}')) SELECT doc_id, CAST(pos AS INTEGER) AS pos, regexp_replace(substr(t, pos, 500), '^\\s+|\\s+$', '', 'g') AS statement FROM h""",
    "catalog_group_sets": f"WITH c AS ({CATALOG}) SELECT id, list_sort(list(DISTINCT pmc) FILTER (pmc IS NOT NULL)) AS pmc_ids, coalesce(list_sort(list(DISTINCT ext) FILTER (ext IS NOT NULL)), []) AS ext_ids FROM c GROUP BY id",
    "majority_filter": f"""WITH {_mentions('doi', *ACCESSIONS)}, c AS ({CATALOG}), a AS (SELECT doc_id // 8 AS article, doc_id, dataset_id, starts_with(dataset_id, 'https://doi.org/') AS is_doi FROM m),
      sp AS (SELECT DISTINCT id, pmc FROM c WHERE pmc IS NOT NULL), se AS (SELECT DISTINCT id, ext FROM c WHERE ext IS NOT NULL),
      np AS (SELECT article, pmc, count(*) AS n FROM a JOIN sp ON dataset_id = id WHERE NOT is_doi GROUP BY ALL), ne AS (SELECT article, ext, count(*) AS n FROM a JOIN se ON dataset_id = id WHERE NOT is_doi GROUP BY ALL),
      tp AS (SELECT article, arg_min(pmc, (-n, pmc)) AS top FROM np GROUP BY article), te AS (SELECT article, arg_min(ext, (-n, ext)) AS top FROM ne GROUP BY article)
      SELECT a.article, doc_id, dataset_id FROM a LEFT JOIN tp ON a.article = tp.article LEFT JOIN te ON a.article = te.article
      WHERE CASE WHEN is_doi THEN true WHEN tp.top IS NOT NULL THEN EXISTS (SELECT 1 FROM sp WHERE id = dataset_id AND pmc = tp.top) WHEN te.top IS NOT NULL THEN EXISTS (SELECT 1 FROM se WHERE id = dataset_id AND ext = te.top) ELSE true END""",
    "xml_filter": f"WITH {_mentions('doi', *ACCESSIONS)} SELECT doc_id, dataset_id FROM m WHERE starts_with(dataset_id, 'https://doi.org/') OR doc_id % 2 = 0",
    "union_mentions": f"WITH {_mentions('doi', 'doi2')} SELECT doc_id, dataset_id, CASE pattern_name WHEN 'doi' THEN 'body' ELSE 'references' END AS section FROM m",
    "rule_labels": f"WITH {_mentions('doi', *ACCESSIONS)} SELECT doc_id, dataset_id, CASE WHEN starts_with(dataset_id, 'SAMN') THEN 'Primary' ELSE 'Secondary' END AS type FROM m",
    "fixed_windows": "WITH p AS (SELECT doc_id, text, unnest(range(0, greatest(len(text), 1), 400)) AS k FROM documents WHERE len(text) > 0) SELECT doc_id, CAST(k // 400 AS INTEGER) AS pos, md5(substr(text, k + 1, 500)) AS window_md5 FROM p",
    "simple_ids": f"WITH {T} SELECT DISTINCT * FROM ({_SIMPLE})",
    "line_contexts": f"""WITH {T}, {_offsets('GSE\\d+')}, h AS (SELECT doc_id, t, s, e, len(string_split(left(t, s), chr(10))[-1]) AS head, len(string_split(substr(t, e + 1), chr(10))[1]) AS tail FROM p)
      SELECT doc_id, s AS start, substr(t, greatest(s - 200, s - head) + 1, least(e + 100, e + tail) - greatest(s - 200, s - head)) AS context FROM h""",
    "article_context": f"""WITH {_mentions('doi')}, d AS (SELECT m.doc_id, dataset_id, split_part(regexp_replace(dataset_id, '^https://doi.org/', ''), '/', 1) AS r, source FROM m JOIN documents USING (doc_id))
      SELECT doc_id, dataset_id, CASE WHEN doc_id % 2 = 0 THEN 'statement ' || CAST(doc_id AS STRING) END AS statement, CASE WHEN doc_id % 3 = 0 THEN 'author ' || source END AS authors, CASE WHEN doc_id % 5 = 0 AND r = '10.5061' THEN 'Dryad' END AS snippet FROM d""",
}
_RAW = "r AS" + _mentions("doi", "doi2", *ACCESSIONS).split(", r AS", 1)[1].split(", k AS", 1)[0]
SQL |= {
    "xml_documents": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'tei' WHEN 1 THEN 'jats' WHEN 2 THEN 'wiley' WHEN 3 THEN 'bioc' ELSE 'unknown' END AS kind, CASE p_partkey % 6
      WHEN 0 THEN p_name || chr(10) || 'Brand ' || p_brand || ', size ' || CAST(p_size AS STRING) || chr(10) || 'References' || chr(10) || 'Smith J (2020) ' || p_type || '.'
      WHEN 1 THEN p_name || chr(10) || 'Brand ' || p_brand || ', size ' || CAST(p_size AS STRING) || chr(10) || 'Acknowledgements' || chr(10) || 'Thanks.' || chr(10) || 'References' || chr(10) || p_type || '.'
      WHEN 2 THEN p_name || chr(10) || 'Brand ' || p_brand || ', size ' || CAST(p_size AS STRING) || chr(10) || 'References' || chr(10) || p_type || '.'
      WHEN 3 THEN 'Smith J. ' || p_name || '.' || chr(10) || p_type WHEN 4 THEN p_name || ' Brand ' || p_brand || ' , size ' || CAST(p_size AS STRING) ELSE '' END AS text,
      CASE WHEN p_partkey % 6 = 5 THEN 'failed' ELSE 'standard' END AS method FROM part""",
    "recovery_pass": f"""WITH t0 AS (SELECT doc_id, {INJECTED} AS t FROM documents), f AS (WITH t AS (SELECT doc_id, left(t, greatest(len(t) - 120, 0)) AS t FROM t0), {_RAW} SELECT DISTINCT doc_id, v FROM r),
      w AS (WITH t AS (SELECT * FROM t0), {_RAW} SELECT doc_id, v, arg_min(pattern_name, priority) AS pattern_name FROM r GROUP BY doc_id, v)
      SELECT doc_id, v AS value, pattern_name FROM w ANTI JOIN f USING (doc_id, v)""",
    "last_heading_cut": f"""WITH {T}, l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS pos, len(string_split(t, chr(10))) AS n FROM t),
      f AS (SELECT *, CAST(regexp_matches(line, '{segment.LOOSE_CITATION}') AS INT) AS cites FROM l), w AS (SELECT *, coalesce(sum(cites) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 0) AS ahead FROM f)
      SELECT doc_id, CAST(max(pos) AS INTEGER) AS cut FROM w WHERE pos > floor(n * 0.3) AND regexp_matches(trim(line, ' '), '{segment.HEADING[:-1]}') AND (ahead > 0 OR pos >= n - 3) GROUP BY doc_id""",
    "spaced_headings": f"""WITH {T}, h AS (SELECT doc_id, t || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'References Cited.' || chr(10) || 'REFERENCES ' || chr(10) || '2. Bibliography' || chr(10) || 'the References' ELSE '' END AS t FROM t),
      l AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda x: CASE WHEN regexp_matches(rtrim(x, ' \t\r'), '{segment.HEADING}') AND NOT ends_with(rtrim(x, ' \t\r'), '.') THEN chr(10) || chr(10) || rtrim(x, ' \t\r') || chr(10) || chr(10) ELSE x END) AS x FROM h)
      SELECT doc_id, md5(array_to_string(x, chr(10))) AS text_md5 FROM l""",
    "cite_marks": f"""WITH {T}, d AS (SELECT doc_id, {CITING.format(t='t')} AS t, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'GSE' || CAST(10000 + doc_id % 50 AS STRING) ELSE 'https://doi.org/10.5061/dryad.' || CAST(doc_id % 97 AS STRING) || 'abcd' END AS i FROM t)
      SELECT doc_id, CASE WHEN i IS NULL THEN t ELSE regexp_replace(regexp_replace(t, regexp_escape(i), CASE WHEN doc_id % 5 = 0 THEN '<cite>Accession IDs</cite>' ELSE '<cite>DOI</cite>' END, 'gi'), 'https?://[^\\s<>"]+', '', 'g') END AS marked FROM d""",
    "availability_statement": """WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'The data were deposited in Dryad under number ' || CAST(doc_id AS VARCHAR) || '.' END AS s, CASE WHEN doc_id % 4 = 0 THEN 'Data Availability: on request.' END AS h FROM documents)
      SELECT doc_id, CASE WHEN s IS NULL THEN h WHEN h IS NULL THEN s ELSE s || chr(10) || h END AS statement, CASE WHEN s IS NOT NULL AND h IS NOT NULL THEN 'hybrid' WHEN h IS NOT NULL THEN 'header' WHEN s IS NOT NULL THEN 'sentence' ELSE 'none' END AS method FROM s""",
    "sentence_contexts": f"""WITH {T}, {_offsets('GSE\\d+')}, w AS (SELECT doc_id, s, v, substr(t, greatest(s - 400, 0) + 1, least(s, 400)) AS l2, substr(t, greatest(s - 200, 0) + 1, least(s, 200)) AS l1, substr(t, e + 1, 200) AS r2, substr(t, e + 1, 100) AS r1 FROM p),
      z AS (SELECT doc_id, s, CASE WHEN regexp_matches(l2, '[.!?\n。！？]') THEN regexp_replace(l2, '(?s)^.*?[.!?\n。！？]\\s*', '') ELSE l1 END || v || CASE WHEN regexp_matches(r2, '[.!?\n。！？]') THEN regexp_extract(r2, '(?s)^.*[.!?\n。！？]') ELSE r1 END AS c FROM w)
      SELECT doc_id, s AS start, regexp_replace(c, '^\\s+|\\s+$', '', 'g') AS context FROM z""",
    "label_links": """SELECT p_partkey, 'see (' || u || ') or  end  - (' || u || '); [' || p_name || ' and a label far too long to go](' || d || ') [x](' || d || ')(' || lower(d) || ')(' || d || ').' AS urls,
      'see [here](' || u || ') or (' || u || ')(' || u || ') end (' || u || ') - (' || u || '); [' || p_name || ' and a label far too long to go](' || d || ') .' AS dois
      FROM (SELECT p_partkey, p_name, 'http://e.org/' || CAST(p_partkey AS VARCHAR) AS u, '10.1234/Ab' || CAST(p_partkey AS VARCHAR) AS d FROM part)""",
    "quotes_and_authors": "SELECT p_partkey, p_name || '; ' || chr(39) || p_brand || chr(39) AS authors FROM part",
    "link_repairs": """SELECT p_partkey, 'a https://doi.org/10.1234/x' || k || '-b-c-d-e (see 10.1234/ab' || k || 'cd) https://doi.org/10.5061/z' || k || ' doi.org/10.99999/q' || k || '.rest, and 10.4321/p. DATA end' AS text FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k FROM part)""",
    "page_plain_text": """SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS text FROM pages""",
}
SQL |= {
    "divided": f"""WITH c AS ({SQL["reference_cut"]}), {T}, l AS (SELECT t.doc_id, string_split(t, chr(10)) AS l, coalesce(cut, len(string_split(t, chr(10)))) AS cut FROM t LEFT JOIN c USING (doc_id)),
      r AS (SELECT doc_id, trim(array_to_string(l[1:cut], chr(10)), ' \t\r\n') AS body, trim(array_to_string(l[cut + 1:], chr(10)), ' \t\r\n') AS refs FROM l)
      SELECT doc_id, CAST(len(body) AS INTEGER) AS n_body, CAST(len(refs) AS INTEGER) AS n_refs, md5(refs) AS refs_md5 FROM r""",
    "normalise_nfkc": """SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), 'https?://zenodo\\.org/record/(\\d+)', ' 10.5281/zenodo.\\1 ', 'g'), ' \t\n\r\x0b\x0c') AS text FROM documents""",
}


def _page(c):
    """The rewrites of page scans in RE2: its one look-ahead guards words that these texts hold nowhere behind a DOI."""
    steps = [("<br>", ""), (r"(\d+\.)\s+(\d+)", "$1$2"), (r"/\s", "/"), (r"\\_", "_"), *rules.LINK_REPAIRS, (r"(^|[^.\n])\n", "$1 ")]
    for pattern, put in steps:
        c = f"regexp_replace({c}, '{pattern.replace(r'(?!(?:DATAS?|RESULTS?|DISCUSSIONS?|REFERENCES?|CONFLICT|ORCID|ACKNOWLEDGMENTS?|References?)' + chr(92) + 'b)', '')}', '{put.replace('$', chr(92))}', 'g')"
    return c


SQL["page_text"] = f"WITH {T} SELECT doc_id, {_page('t')} AS text FROM t"
_TRIAGE = (
    "b AS (SELECT article_id, doi, regexp_replace(doi, '^https?://doi.org/', '') AS d FROM r), k AS (SELECT *, CASE WHEN len(list_filter(["
    + ", ".join(f"'{p}'" for p in rules.REPOSITORIES)
    + "], lambda p: starts_with(d, p))) > 0 THEN 'dataset' WHEN len(list_filter(["
    + ", ".join(f"'{p}'" for p in rules.ARTICLE_REGISTRANTS)
    + "], lambda p: starts_with(d, p))) = 0 AND len(list_filter(["
    + ", ".join(f"'{p}'" for p in rules.ARTICLE_WORDS)
    + "], lambda p: contains(lower(d), p))) = 0 AND len(d) BETWEEN 10 AND 100 AND contains(d, '/') AND len(list_filter(["
    + ", ".join(f"'{p}'" for p in rules.ARTICLE_ENDINGS)
    + "], lambda p: ends_with(lower(d), p))) = 0 THEN 'lookup' ELSE 'drop' END AS kind FROM b)"
)
_RESOLVED = f"WITH r AS ({REFERENCES}), {_TRIAGE}, i AS ({INDEX}), z AS (SELECT * FROM k WHERE kind = 'dataset' OR (kind = 'lookup' AND lower(d) IN (SELECT doi FROM i)))"
SQL |= {
    "doi_triage": f"WITH r AS ({REFERENCES}), {_TRIAGE} SELECT kind, count(*) AS n FROM k GROUP BY kind",
    "datasets_by_article": f"{_RESOLVED} SELECT replace(regexp_replace(article_id, '^https?://doi.org/', ''), '/', '_') AS article_key, list_sort(list(doi)) AS datasets FROM z GROUP BY 1",
    "resolver_summary": f"""{_RESOLVED}, c AS (SELECT (SELECT count(DISTINCT article_id) FROM k) AS total_articles, (SELECT count(*) FROM k) AS total_dois, (SELECT count(*) FROM k WHERE kind = 'dataset') AS n_dataset,
      (SELECT count(*) FROM k WHERE kind = 'lookup') AS n_lookup, (SELECT count(*) FROM k WHERE kind = 'drop') AS n_drop, count(*) AS total_datasets_found, (SELECT count(*) FROM k WHERE kind = 'lookup') - count(*) FILTER (kind = 'lookup') AS filtered_dois,
      count(DISTINCT doi) AS total_unique_datasets, count(DISTINCT article_id) AS articles_with_datasets FROM z)
      SELECT *, round(articles_with_datasets / total_articles, 9) AS articles_share, round((total_datasets_found - n_dataset) / n_lookup, 9) AS lookup_success FROM c""",
}
