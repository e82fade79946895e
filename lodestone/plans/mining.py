"""The mining of citations from end to end: texts, sections, mentions of every format, validation, labels, scores.

The driver's texts hold no identifiers. So every document gets one of 53 samples, a format each, in its text or in its
bibliography, by ``doc_id % 53``. What must be found is written beside each sample, by hand, and the SQL is made of that alone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import label, matching, segment, validate
from ..sources.files import catalog_sets
from ..storage import materialise

BODY, REFS = "body", "refs"
#: What stands in the text, where, the identifier it means, and the formats that find it.
SAMPLES = (
    ("10.5061/dryad.Body(1)x2", BODY, "https://doi.org/10.5061/dryad.body(1)x2", "doi doi2"),
    ("Zenodo.123456", BODY, "https://doi.org/10.5281/zenodo.123456", "doi2"),
    ("https://doi.org/10.7910/DVN/ABC123", REFS, "https://doi.org/10.7910/dvn/abc123", "doi_ref"),
    ("pangaea.778899", REFS, "https://doi.org/10.1594/pangaea.778899", "doi_ref2"),
    ("E-MTAB-1234", BODY, "E-MTAB-1234", "arrayexpress_id"),
    ("AF-P12345-F1", BODY, "AF-P12345-F1", "alphafold_id_1"),
    ("AF-A0ABC1-F1", BODY, "AF-A0ABC1-F1", "alphafold_id_2"),
    ("5.2.3.-", BODY, "5.2.3", ""),
    ("BTO:0000123", BODY, "BTO:0000123", "brenda_tissue_ontology_id"),
    ("S-BIAD123", BODY, "S-BIAD123", "bia_id biostudies"),
    ("BIOMD0000000123", BODY, "BIOMD0000000123", "biomodels_id"),
    ("SAMN01234567", BODY, "SAMN01234567", "biosample_id"),
    ("1abcA00", BODY, "1abcA00", "cath_id"),
    ("3.40.50.300", BODY, "3.40.50.300", "brenda_ec_number cath_domain"),
    ("CVCL_0030", BODY, "CVCL_0030", "cellosaurus_id"),
    ("CHEBI:15377", BODY, "CHEBI:15377", "chebi_id"),
    ("CHEMBL25", BODY, "CHEMBL25", "chembl_id"),
    ("CPX-1234", BODY, "CPX-1234", "complexportal_id"),
    ("SRS123456", BODY, "SRS123456", "metagenomics_sample_id"),
    ("EGAS00001000123", BODY, "EGAS00001000123", "ega_id"),
    ("EMD-1234", BODY, "EMD-1234", "emdb_id"),
    ("EMPIAR-10012", BODY, "EMPIAR-10012", "empiar_id"),
    ("U12345", BODY, "U12345", "ena_accession"),
    ("SRR123456", REFS, "SRR123456", "sra_id"),
    ("TI1234", BODY, "TI1234", "ena_trace"),
    ("ENSG00000139618", BODY, "ENSG00000139618", "ensembl_id"),
    ("HPA012345", BODY, "HPA012345", "hpa_id"),
    ("HG00123", BODY, "HG00123", "igsr_id"),
    ("EBI-123456", BODY, "EBI-123456", "intact_id"),
    ("MINT-123456", BODY, "MINT-123456", "mint_id"),
    ("IPR000123", BODY, "IPR000123", "interpro_id"),
    ("MTBLS123", BODY, "MTBLS123", "metabolights_id"),
    ("4HHB", BODY, "4HHB", "pdb_id"),
    ("PF00069", BODY, "PF00069", "pfam_id"),
    ("PXD000123", BODY, "PXD000123", "pride_id"),
    ("R-HSA-12345", BODY, "R-HSA-12345", "reactome_id"),
    ("RF00001", BODY, "RF00001", "rfam_id"),
    ("RHEA:12345", BODY, "RHEA:12345", "rhea_id"),
    ("URS0000123_9606", BODY, "URS0000123_9606", "rnacentral_id"),
    ("A0A024", BODY, "A0A024", "uniprot_id"),
    ("UPI0000000001", BODY, "UPI0000000001", "uniparc_id"),
    ("WTSIi012-A", BODY, "WTSIi012-A", "ebisc_id"),
    ("HPSI0114i-abcd_1", BODY, "HPSI0114i-abcd_1", "hipsci_id"),
    ("NM_000546.5", BODY, "NM_000546.5", "refseq_id"),
    ("rs12345", BODY, "rs12345", "refsnp_id"),
    ("PRJNA12345", BODY, "PRJNA12345", "bioproject_id"),
    ("TF101010", BODY, "TF101010", "ena_accession treefam_id"),
    ("2004-000446-20", BODY, "2004-000446-20", "eudract_id"),
    ("NCT01234567", BODY, "NCT01234567", "nct_id"),
    ("phs000123", REFS, "phs000123", "dbgap_id"),
    ("GSE1234", BODY, "GSE1234", "geo_id"),
    ("EPI_ISL_123456", BODY, "EPI_ISL_123456", "gisaid_id"),
    ("S-EPMC12345", BODY, "S-EPMC12345", "biostudies"),
)
_K = len(SAMPLES)
_pick = lambda where: "CASE doc_id % " + str(_K) + "".join(f" WHEN {k} THEN '{s[0]}'" for k, s in enumerate(SAMPLES) if s[1] == where) + " ELSE 'nothing' END"
#: The document: its own text, lines that say little, the sample in a sentence, and a bibliography. Part of the samples
#: stand at brackets and line ends.
PAGE = (
    "coalesce(text, '') || '.' || chr(10) || 'An accession, compound, cells, protein complex, pathway, trial, tree, allele, disease, enzyme, domain, samples, interaction or reaction of the archive.' || chr(10)"
    " || repeat('This filler line says little.' || chr(10), 16)"
    f" || CASE WHEN doc_id % 2 = 0 THEN 'It was deposited as ' ELSE 'It stands as ' END || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '(' ELSE '\"' END || {_pick(BODY)} || CASE doc_id % 3 WHEN 0 THEN ' here.' WHEN 1 THEN ').' ELSE '\".' END || chr(10)"
    f" || 'References' || chr(10) || '[1] Smith J. (2020) One title, ' || {_pick(REFS)} || '.' || chr(10) || repeat('[2] Jones K. (2019) Another title.' || chr(10), 8)"
)


def _fixture(spark):
    rows = [(k, s[1], s[2]) for k, s in enumerate(SAMPLES)]
    return spark.createDataFrame(rows, "k int, place string, dataset_id string")


def _mentions(spark, sf_dir, contexts=False):
    """Mentions that stand in the catalogs, near a word of their database."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(PAGE).alias("text"))
    docs = docs.select("doc_id", tx.page_text(tx.spaced_headings(tx.normalised(F.col("text")))).alias("text"))
    docs = segment.divided_at(docs.withColumn("cut", segment.bibliography_line(F.col("text")))).select("doc_id", "body", "refs")
    # cleaned and divided once, read for the mentions and for what surrounds those that the catalogs hold
    docs = materialise(spark, docs, "pages")
    found = materialise(spark, validate.canonical(matching.mentions(docs, near=False)), "mentions")
    known = _fixture(spark)
    dois = known.where(label.is_doi(F.col("dataset_id"))).select(F.col("dataset_id").alias("doi"))
    catalog = catalog_sets(known.where(~label.is_doi(F.col("dataset_id"))).select(F.col("dataset_id").alias("id"), F.lit("PMC1").alias("pmc"), F.lit(None).cast("string").alias("ext"), F.lit("fixture").alias("source")))
    doi = label.is_doi(F.col("dataset_id"))
    own = F.concat(F.lit("10.9999_"), F.col("doc_id").cast("string"))
    dois = validate.known_dois(validate.known_registrants(found.where(doi & ~validate.doi_rejected(tx.bare_doi(F.col("dataset_id")), own)), dois), dois)
    accessions = validate.in_catalog(found.where(~doi), catalog)
    known = dois.select(*found.columns).unionByName(accessions.select(*found.columns))
    known = matching.surrounded(known, docs, contexts=contexts).where(doi | F.col("near"))
    return validate.with_catalog_ids(known, catalog)


def pattern_mentions(spark, sf_dir):
    """All formats at work."""
    return _mentions(spark, sf_dir).select("doc_id", "pattern_name", "dataset_id")


def _choice():
    """Answers that a classifier has given before, by document: A, B or C."""
    return F.element_at(F.array(*map(F.lit, "ABC")), (F.col("doc_id") % 5 % 3 + 1).cast("int"))


def _labels(spark, sf_dir):
    section = F.when(F.col("pattern_name").isin("doi_ref", "doi_ref2"), "references").otherwise("body")
    found = _mentions(spark, sf_dir, contexts=True).withColumn("section", section)
    kept = label.majority_filter(found, "doc_id")
    kept = label.asked(kept.withColumn("type", label.rule_label(F.col("dataset_id"), F.col("section"))))
    answers = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", _choice().alias("choice"))
    done = label.answered(kept, answers, ("doc_id",)).where("type IS NOT NULL")
    done = label.promote(done, ("doc_id", "pattern_name"), exempt=label.is_doi(F.col("dataset_id")) | (F.col("pattern_name") == "ena_accession"))
    return label.one_label(done.withColumn("article_id", F.concat(F.lit("10.9999_"), F.col("doc_id").cast("string"))))


def mined_labels(spark, sf_dir):
    """From texts to numbered labels."""
    return label.with_row_ids(_labels(spark, sf_dir), "article_id", "dataset_id").select("row_id", "article_id", "dataset_id", "type")


def mined_scores(spark, sf_dir):
    """The labels against true ones: what stands in each document, primary wherever its id divides by 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.col("doc_id") % _K).cast("int").alias("k"))
    true = docs.join(F.broadcast(_fixture(spark)), "k").select(F.concat(F.lit("10.9999_"), F.col("doc_id").cast("string")).alias("article_id"), "dataset_id", F.when(F.col("doc_id") % 3 == 0, "Primary").otherwise("Secondary").alias("type"))
    keys = ["article_id", "dataset_id", "type"]
    out = label.f1(label.outcome(true, _labels(spark, sf_dir), keys), F.when(label.is_doi(F.col("dataset_id")), "doi").otherwise("accession"))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


QUERIES = {f.__name__: f for f in (pattern_mentions, mined_labels, mined_scores)}

_quoted = ", ".join(f"({k}, '{s[1]}', '{s[2]}', '{s[3]}')" for k, s in enumerate(SAMPLES))
_S = f"s AS (SELECT * FROM (VALUES {_quoted}) v(k, place, dataset_id, names)), m AS (SELECT doc_id, place, dataset_id, unnest(string_split(names, ' ')) AS pattern_name FROM documents JOIN s ON doc_id % {_K} = k WHERE names <> '')"
_L = f"""{_S}, l AS (SELECT DISTINCT doc_id, '10.9999_' || CAST(doc_id AS VARCHAR) AS article_id, dataset_id,
  CASE WHEN starts_with(dataset_id, 'https') THEN CASE WHEN doc_id % 5 % 3 = 0 THEN 'Primary' ELSE 'Secondary' END
    WHEN starts_with(dataset_id, 'EPI_ISL_') OR doc_id % 2 <> 0 THEN CASE WHEN starts_with(dataset_id, 'SAMN') THEN 'Primary' ELSE 'Secondary' END
    ELSE CASE doc_id % 5 % 3 WHEN 0 THEN 'Primary' WHEN 1 THEN 'Secondary' END END AS type FROM m), p AS (SELECT article_id, dataset_id, type FROM l WHERE type IS NOT NULL)"""
SQL = {
    "pattern_mentions": f"WITH {_S} SELECT doc_id, pattern_name, dataset_id FROM m",
    "mined_labels": f"WITH {_L} SELECT CAST(row_number() OVER (ORDER BY article_id, dataset_id) - 1 AS BIGINT) AS row_id, * FROM p",
    "mined_scores": f"""WITH {_L}, t AS (SELECT '10.9999_' || CAST(doc_id AS VARCHAR) AS article_id, dataset_id, CASE WHEN doc_id % 3 = 0 THEN 'Primary' ELSE 'Secondary' END AS type FROM documents JOIN s ON doc_id % {_K} = k),
      o AS (SELECT coalesce(t.dataset_id, p.dataset_id) AS d, CASE WHEN t.type IS NULL THEN 'fp' WHEN p.type IS NULL THEN 'fn' ELSE 'tp' END AS outcome FROM t FULL JOIN p ON t.article_id = p.article_id AND t.dataset_id = p.dataset_id AND t.type = p.type),
      c AS (SELECT CASE WHEN starts_with(d, 'https') THEN 'doi' ELSE 'accession' END AS slice, outcome FROM o UNION ALL SELECT 'overall', outcome FROM o),
      n AS (SELECT slice, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM c GROUP BY slice),
      q AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM n)
      SELECT slice, tp, fp, fn, round(coalesce(p, 0), 9) AS precision, round(coalesce(r, 0), 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1 FROM q""",
}
