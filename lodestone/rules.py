"""Rule tables of the citation-mining operators, as data. All of them can be replaced by the caller."""

from __future__ import annotations

# --- Fixed values: identifier formats, in order of priority: name, case-insensitive, pattern -------------------------

DOI = r"10\.\d{4,}/(?:[-._/A-Z0-9]*(?:\([-._/A-Z0-9]*\)[-._/A-Z0-9]*)*[A-Z0-9])"
DOI_ALIAS = r'dryad\.[^\s"<>]+|pasta/[^\s"<>]+|zenodo\.\d+|pangaea\.\d+'

PATTERNS: list[tuple[str, bool, str]] = [
    ("doi", True, DOI),
    ("doi2", True, DOI_ALIAS),
    ("doi_ref", True, DOI),
    ("doi_ref2", True, DOI_ALIAS),
    ("arrayexpress_id", False, r"\bE-[A-Z]{4}-\d+\b"),
    ("alphafold_id_1", True, r"\bAF-[OPQ]\d[A-Z0-9]{3}\d+-F\d\b"),
    ("alphafold_id_2", True, r"\bAF-[A-NR-Z]\d(?:[A-Z][A-Z0-9]{2}\d)+-F\d\b"),
    ("brenda_ec_number", False, r"\b\d+\.(?:\d+|-)\.(?:\d+|-)\.(?:\d+|-)\b"),
    ("brenda_tissue_ontology_id", True, r"\bBTO: ?\d{7}\b"),
    ("bia_id", True, r"\bS-BIAD\d+\b"),
    ("biomodels_id", True, r"\b(?:(?:BIOMD|MODEL)\d{10}|BMID\d{12})\b"),
    ("biosample_id", True, r"\bSAM[NED][A-Z]?\d+\b"),
    ("cath_id", False, r"\b\d[a-zA-Z0-9]{4}\d{2}\b"),
    ("cath_domain", False, r"\b[1-4](?:\.\d+){3}\b"),
    ("cellosaurus_id", True, r"\bCVCL_[a-zA-Z0-9]{4}\b"),
    ("chebi_id", True, r"\bCHEBI:\d+\b"),
    ("chembl_id", True, r"\bCHEMBL\d+\b"),
    ("complexportal_id", True, r"\bCPX-\d+\b"),
    ("metagenomics_sample_id", True, r"\bSRS\d{6}\b"),
    ("ega_id", True, r"\bEGA[SDC]\d{11}\b"),
    ("emdb_id", True, r"\bEMD-\d{4}\b"),
    ("empiar_id", False, r"\bEMPIAR-\d{5}\b"),
    ("ena_accession", True, r"\b(?:[A-Z]\d{5}|[A-Z]{2}\d{6}|[A-RT-Z][A-Z]{3}S?\d{8,9}|[A-Z]{3}\d{5})\b"),
    ("sra_id", True, r"\b(?:[EDS]R[PXRAZ]|ERS)\d{5,}\b"),
    ("ena_trace", True, r"\bTI\d+\b"),
    ("ensembl_id", True, r"\bENS[A-Z]*[GTP]\d{11,}\b"),
    ("hpa_id", True, r"\b(?:HPA|CAB)\d{6}\b"),
    ("igsr_id", False, r"\b(?:HG0[0-4]\d{3}|(?:NA|GM)[0-2]\d{4})\b"),
    ("intact_id", True, r"\bEBI-\d+\b"),
    ("mint_id", True, r"\b(?:MINT|IM)-\d+\b"),
    ("interpro_id", True, r"\bIPR\d{6}\b"),
    ("metabolights_id", True, r"\bMTBLS\d+\b"),
    ("pdb_id", False, r"\b\d[a-zA-Z0-9]{3}\b"),
    ("pfam_id", True, r"\bPF(?:AM)?\d{5}\b"),
    ("pride_id", True, r"\bR?PXD\d{6}\b"),
    ("reactome_id", True, r"\bR-HSA-\d+\b"),
    ("rfam_id", False, r"\bRF\d{5}\b"),
    ("rhea_id", True, r"\bRHEA:[1-9]\d*\b"),
    ("rnacentral_id", False, r"\bURS[0-9A-Z]+_\d+\b"),
    ("uniprot_id", True, r"\b(?:[A-NR-Z]\d[A-Z][A-Z0-9]{2,}\d|[OPQ]\d[A-Z0-9]{3,}\d)(?:-\d+)?\b"),
    ("uniparc_id", True, r"\bUPI[A-F0-9]{10}\b"),
    ("ebisc_id", False, r"\b[A-Z]{2,}i\d{3}-[A-Z]\b"),
    ("hipsci_id", False, r"\bHPSI\d{4}(?:i|pf)-[a-z]+_\d+\b"),
    ("refseq_id", True, r"\b(?:AC|AP|NC|NG|NM|NP|NR|NT|NW|NZ|XM|XP|XR|YP|ZP|NS)_(?:[A-Z]{4})*\d{6,9}(?:\.\d+)?\b"),
    ("refsnp_id", True, r"\b[rs]s\d{1,9}\b"),
    ("bioproject_id", True, r"\bPRJ[DEN][A-Z]\d+\b"),
    ("treefam_id", True, r"\bTF\d{6}\b"),
    ("eudract_id", False, r"\d{4}-\d{6}-\d{2}"),
    ("nct_id", True, r"\bNCT0\d{7}\b"),
    ("dbgap_id", True, r"\bphs\d{6}\b"),
    ("geo_id", True, r"\bG(?:PL|SM|SE|DS)\d{2,}\b"),
    ("gisaid_id", True, r"EPI\d{6,}|EPI_ISL_\d{5,}"),
    ("biostudies", False, r"\bS-[A-Z]{3,5}\d+\b"),
]

# --- Fixed values: words that must stand near an identifier, by database: window in characters, alternatives ---------

CELLS = r"\bcell\b|sample|iPSCs?|iPS|fibroblasts?|e?QTL|pluripotent|induced|\bdonor\b|\bstem\b|EBiSC|1000 Genomes|Coriell|\bLCL\b|lymphoblastoid"
CONTEXT: dict[str, tuple[int, str]] = {
    "arrayexpress": (5000, "arrayexpress|atlas|gxa|accession|experiment"),
    "alphafold": (5000, "alphafold|structures|predicted structure|predicted protein structure|protein|identifier|accession"),
    "brenda": (2000, "BRENDA|BRaunschweig ENzyme DAtabase|enzyme|lysosomes|lysosomal|BTO|ontology"),
    "bia": (5000, "bia|bioimage archive|database|identifier|accession"),
    "biomodels": (3000, "biomodels|accession|model|identifier"),
    "biosample": (5000, "biosample|accession|model"),
    "cath": (5000, r"cath|c\.a\.t\.h|domain|families|pdb|superfamily"),
    "cellosaurus": (5000, "cells|cellosaurus|cell lines|cell bank|accession number|RRID:"),
    "chebi": (5000, "chebi|compound"),
    "chembl": (5000, "chembl|compound"),
    "complexportal": (5000, "protein|complex"),
    "metagenomics": (5000, "samples|metagenomics|database"),
    "ega": (5000, "ega|accession|archive|studies|study|set|data|dac|European Genome.phenome Archive"),
    "emdb": (5000, "emdb|accession|code"),
    "ena": (2000, r"genbank|\bgen\b|\bena\b|ddbj|embl|accession|nucleotide|archive|asssembled|annotated|sequence|protein|trace|study|studies|sample|experiment|run|analysis|analyses|submission"),
    "ensembl": (5000, "ensembl|accession|transcript|sequence"),
    "go": (5000, "go|gene ontology"),
    "hgnc": (5000, "hugo|gene|nomenclature|committee|database"),
    "igsr": (3000, CELLS),
    "intact": (5000, "intact|interaction|protein"),
    "mint": (5000, "MINT|molecular interaction database|interaction"),
    "interpro": (5000, "interpro|domain|family|motif|accession"),
    "metabolights": (5000, "metabolights|accession|repository"),
    "pdb": (1000, r"pdb|protein\s+data\s*bank|accession|structure|domain"),
    "pfam": (5000, "pfam|domain|family|accession|motif"),
    "pxd": (5000, "pxd|proteomexchange|pride|dataset|accession|repository"),
    "reactome": (5000, "biological|regulatory|pathway|database"),
    "rhea": (5000, "reactions|database|accession"),
    "uniprot": (5000, r"swiss-prot|sprot|uniprot|swiss prot|accession|Locus|GenBank|genome|sequence|protein|trembl|uniparc|Acc\.No|Acc\. No"),
    "uniparc": (5000, r"uniprot|accession|Locus|sequence|protein|uniparc|Acc\.No|Acc\. No"),
    "ebisc": (5000, CELLS),
    "hipsci": (5000, CELLS),
    "refseq": (5000, "refseq|genbank|accession|sequence"),
    "refsnp": (5000, "allele|model|multivariate|polymorphism|locus|loci|haplotype|genotype|variant|chromosome|snp"),
    "bioproject": (5000, "bioproject|accession|archive"),
    "treefam": (5000, "tree|family|accession|dendrogram"),
    "eudract": (5000, "eudract|trial|agency|register|clinical"),
    "nct": (5000, "trial"),
    "dbgap": (5000, "database of genotypes and phenotypes|dbgap|accession|archives|studies|interaction"),
    "geo": (5000, "gene expression omnibus|genome|geo|accession|functional genomics|data repository|data submissions"),
    "orphadata": (5000, "disease|data|nomenclature|syndrome|id|number|name|orpha"),
    "gisaid": (5000, "gisaid|global initiative on sharing all influenza data|segment|identifier|flu|epi|database|sequence|isolate|accession|virus|strain"),
}
#: Patterns whose database is not the part of their name before the first underscore.
DATABASE_OF = {"sra_id": "ena", "ena_trace": "ena", "pride_id": "pxd"}

# --- Fixed values: DOI prefixes and words ------------------------------------------------------------------------------

ALIASES = {"dryad.": "10.5061/", "zenodo.": "10.5281/", "pasta/": "10.6073/", "pangaea.": "10.1594/"}
TRUNCATED = ("10.5061/dryad", "10.6073/pasta", "10.5281/zenodo", "10.25386/genetics", "10.1175/jcli")
JOURNALS = (
    "10.18637/jss journal 10.1109/cvpr figshare 10.1111 10.1016/j. 10.1002/ 10.1038/ 10.1126/ 10.1073/ 10.1093/ 10.1103/ 10.1021/ 10.1007/ 10.1186/ "
    "10.1371/ 10.3390/ 10.1155/ 10.1159/ 10.1161/ 10.1210/ 10.1212/ 10.1214/ 10.1215/ 10.1242/ 10.1256/ 10.1261/ 10.1289/ 10.1299/"
).split() + [f"10.{n}/" for n in range(1300, 2000, 10)] + (
    "10.1080/ 10.1029/ 10.1143/ 10.3238/arztebl 10.3322/caac 10.2458/azu_js_rc 10.21105/joss 10.1089 10.5194/gmd 10.1146/annurev 10.1098/rspb "
    "10.3897/neobiota 10.3763/ghgmm 10.1175/jhm 10.5194/acp 10.5194/hess 10.1098/ 10.11613/bm 10.4161/rna 10.2307 10.3354 10.4159/harvard "
    "10.1051/forest 10.1098/rstb 10.1127 10.1086/ 10.1071/ 10.2193/ 10.1641/ 10.3201/ 10.1162/ 10.14806/ej 10.1669/ 10.1006/ 10.1152 10.2525 "
    "10.2217/ 10.14411 10.14440/ 10.5665/ 10.1113/ 10.1586/ 10.1177/ 10.1895/ 10.13039/ 10.1128/ 10.1191/ 10.1109 10.4049/ 10.1145 "
    "10.3389/fimmu 10.1175/ 10.2202/ 10.4061/"
).split()
#: Registrants whose works are articles, for triage.
ARTICLE_REGISTRANTS = (
    "10.1111/j. 10.1016/j. 10.1002/ 10.1038/ 10.1126/ 10.1073/ 10.1093/ 10.1103/ 10.1021/ 10.1007/ 10.1186/ 10.1371/ 10.3390/ 10.1155/ 10.1159/ "
    "10.1161/ 10.1210/ 10.1212/ 10.1214/ 10.1215/ 10.1242/ 10.1256/ 10.1261/ 10.1289/ 10.1299/"
).split() + [f"10.{n}/" for n in range(1300, 2000, 10)]
REPOSITORIES = "10.5281/ 10.5061/ 10.7910/ 10.6073/ 10.6084/ 10.4121/ 10.17026/".split() + [f"10.{n}/" for n in range(24432, 24500)]
ARTICLE_WORDS = "journal article paper research study review letter note comment correspondence editorial abstract proceedings conference symposium workshop".split()
ARTICLE_ENDINGS = ".pdf .html .xml .txt .doc .docx abstract full supplement appendix".split()
REPOSITORY_WORDS = {
    "10.15468": "GBIF|Global Biodiversity Information Facility",
    "10.5061": "Dryad Digital Repository|Dryad",
    "10.5281": "Zenodo|CERN",
    "10.6073": "PASTA|EDI|Environmental Data Initiative",
    "10.17605": "OSF|Open Science Framework",
    "10.5256": "F1000Research",
    "10.6084": "Figshare",
    "10.1594": "Pangaea|Data Publisher for Earth & Environmental Science",
    "10.7910": "Harvard Dataverse|Dataverse",
    "10.3886": "ICPSR|Inter-university Consortium for Political and Social Research",
}

# --- Fixed values: headings, citations, availability statements, primary words ---------------------------------------

HEADINGS = (
    r"REFERENCES?", r"\d+\.?\s+REFERENCES?", r"REFERENCES?:?", r"REFERENCES?\s+CITED.{0,10}", r"BIBLIOGRAPHY:?", r"\d+\.?\s+BIBLIOGRAPHY",
    r"LITERATURE\s+CITED", r"WORKS\s+CITED.{0,10}", r"ACKNOWLEDGMENTS?", r"FUNDING", r"CONFLICTS?\s+OF\s+INTEREST", r"NOTES",
)
CITATION_FEATURES = (r"\((19|20)\d{2}\)", r"\b(19|20)\d{2}[a-z]?\b", r"(?i)doi:", r"(?i)et al", r"^\s*\[\d+\]", r"^\s*\d+\.\s", r"[A-Z]\.")
AVAILABILITY_HEADER = r"(?i)(?:(?:data|code|software|materials)\s*(?:and\s+materials\s*)?availab(?:ility|le)|data\s*deposition)[\s.:;]*"
# Words of sentences about the availability of data, then names of repositories
AVAILABILITY_TERMS = (
    r"data\s+and\s+materials\s+availability", r"data\s+availability", r"code\s+availability",
    r"underlying\s+data", r"source\s+data", r"source\s+code", r"generated", r"produced", r"collected",
    r"submitted", r"deposited", r"released", r"archived", r"data\s+release",
    r"provided\s+by", r"available\s+at", r"available\s+in", r"available\s+from", r"can\s+be\s+found", r"are\s+provided", r"are\s+included", r"hosted",
    r"dataset", r"datasets", r"data\s+set", r"accession", r"availability",
)
REPOSITORY_TERMS = (
    r"zenodo", r"figshare", r"dryad", r"github", r"gitlab", r"GBIF",
    r"AlphaFold\sDB", r"AlphaFold", r"ArrayExpress", r"BioImage\sArchive", r"bia", r"BioModels", r"NCBI\sBioProject", r"BioProject", r"NCBI\sBioSample", r"BioSample",
    r"BRaunschweig\sENzyme\sDAtabase", r"BRENDA\senzyme", r"BRENDA", r"BTO", r"cath-Gene3D", r"cath", r"Cellosaurus", r"ChEBI", r"ChEMBL", r"ClinicalTrials\.gov",
    r"ComplexPortal", r"Coriell", r"database\sof\sgenotypes\sand\sphenotypes", r"dbgap", r"dbSNP", r"ebi\smetagenomics", r"EBiSC", r"EMBL", r"EMDB", r"EMPIAR", r"Ensembl",
    r"European\sGenome-phenome\sArchive", r"EGA", r"European\sNucleotide\sArchive", r"EudraCT", r"Gene\sExpression\sOmnibus", r"GEO", r"Gene\sOntology", r"GenBank", r"gisaid", r"gxa",
    r"HipSci", r"HUGO\sGene\sNomenclature\sCommittee", r"hgnc", r"IntAct", r"InterPro", r"MetaboLights", r"molecular\sinteraction\sdatabase", r"MINT",
    r"Orphanet", r"Orphadata", r"ORPHA", r"Pangaea", r"Pfam", r"Protein\sData\sBank", r"PDB", r"ProteomeXchange", r"PRIDE",
    r"Reactome", r"Reference\sSequence", r"RefSeq", r"rhea", r"RNAcentral", r"swiss-prot", r"swiss\sprot", r"UniProtKB", r"TrEMBL", r"UniProt", r"Sprot", r"uniparc",
    r"TreeFam", r"1000\sGenomes",
)
AVAILABILITY_WORDS = r"(?i)\b(?:" + "|".join(AVAILABILITY_TERMS) + r")\b"
REPOSITORY_NAMES = r"(?i)\b(?:" + "|".join(REPOSITORY_TERMS) + r")\b"
PRIMARY_WORDS = (
    r"deposited|accessible|submitted|measured|collected|observed|detected|analyzed|generated|produced|obtained|recorded|sequenced|amplified|isolated|"
    r"vailability|vailable|novel|hosted|raw(?:\s+data)?|supplementary"
)
# the first look-ahead repeats what follows: only white space is looked at from behind
SENTENCE_END = r"(?=\s)(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|!)\s+"
# Broken links, as (pattern, replacement), applied in this order
LINK_REPAIRS = (
    (r"https?://\s*([a-zA-Z0-9\.\-]+)", "https://$1"),
    (r"(doi\.)\s+(org/10\.)", "$1$2"),
    (r"doi\.org/\s+10\.", "doi.org/10."),
    (r"doi\.org/10\.\s*(\d+)", "doi.org/10.$1"),
    (r"doi\.org/10\.(\d{4,5})/\s+([a-zA-Z0-9\.\-_]+)", "doi.org/10.$1/$2"),
    (r"(10\.\d{4,5}/[a-zA-Z0-9\.\-/]+\.)\s+([a-z0-9\.\-_/]{4,20},?\s+|(?!(?:DATAS?|RESULTS?|DISCUSSIONS?|REFERENCES?|CONFLICT|ORCID|ACKNOWLEDGMENTS?|References?)\b)[A-Z0-9\.\-_/]{4,20}\s+)", "$1$2"),
    (r"\n+(https?://doi\.org/[^\s]*)", "$1"),
    (r"(\(.{0,20}10\.\d{4,}/.{1,30})\s+([A-Za-z0-9]{1,10}\))", "$1$2"),
    (r"(10\.\d{4,5}/[a-zA-Z0-9\.\-/]+-)\s+([a-zA-Z0-9\.\-_/]+)", "$1$2"),
    (r"(doi\.org/10\.\d{4,5}/[a-zA-Z0-9\.\-/]+-)\s+([a-zA-Z0-9\.\-_/]+)", "$1$2"),
    (r"(https://doi\.org/10\.\d{4,5}/[a-zA-Z0-9\.\-/]+-)\s+([a-zA-Z0-9\.\-_/]+)", "$1$2"),
    (r"(10\.\d{4,5}/[a-zA-Z0-9\.\-/]+-)\s+([a-zA-Z0-9\.\-_/]+)", "$1$2"),
)

# Links as they stand in round brackets behind a label, and as they repeat
LABELLED = {
    "url": (r"https?://[^\s\)]+", r"https?://[^\s\)]+"),
    "doi": (r"10\.\d{4,}/(?:[-._;/:,A-Z0-9]*(?:\([-._;/:,A-Z0-9]*\)[-._;/:,A-Z0-9]*)*[A-Z0-9]|[-._;/:,A-Z0-9]*[A-Z0-9])", r"10\.\d{4,}/[^\)]+"),
}

# A DOI with more signs than ``DOI`` takes, at page links
WIDE_DOI = r"10\.\d{4,}/(?:[-._;/:A-Z0-9]*(?:\([-._;/:A-Z0-9]*\)[-._;/:A-Z0-9]*)*[A-Z0-9]|[-._;/:A-Z0-9]*[A-Z0-9])"

# Headings, entries and first entries of a bibliography, older rule
LAST_HEADING = r"(?i)\b(?:R\s*E\s*F\s*E\s*R\s*E\s*N\s*C\s*E\s*S|BIBLIOGRAPHY|LITERATURE CITED|WORKS CITED|CITED WORKS|ACKNOWLEDGEMENTS)\b[:\s]*"
NUMBERED_ENTRY = r"^\s*(?:\[\d+\]|\(\d+\)|\d+\.|\d+\)|\d+(?=\s|$))\s*"
FIRST_ENTRY = r"^\s*(?:\[1\]|\(1\)|1\.|1\)|1(?=\s|$))"

# Identifier formats of the plain extraction, older set
SIMPLE_PATTERNS = {
    "doi": r"(?i)(?:\b|(?<!https://))(?:https://doi\.org/)?(10\.\d{4,}/(?:[-._;/:A-Z0-9]*(?:\([-._;/:A-Z0-9]*\)[-._;/:A-Z0-9]*)*[A-Z0-9]|[-._;/:A-Z0-9]*[A-Z0-9]))",
    "isbn": r"(\b(?:ISBN(?:-1[03])?:? )?(?=[0-9X]{10}$|(?=(?:[0-9]+[- ]){3})[- 0-9X]{13}$|97[89][0-9]{10}$|(?=(?:[0-9]+[- ]){4})[- 0-9]{17}$)(?:97[89][- ]?)?[0-9]{1,5}[- ]?[0-9]+[- ]?[0-9]+[- ]?[0-9X]\b)",
    "kegg_like_id": r"(\b[A-Z]\d{5}\b)",
    "gisaid_id": r"\b(EPI_ISL_\d+|EPI\d+)",
    "prj_id": r"\b(PRJ[ED]?[A-Z]+\d+)\b",
    "chembl_id": r"\b(CHEMBL\d+)\b",
    "interpro_id": r"\b(IPR\d{5,})\b",
    "pfam_id": r"\b(PF\d{5,})\b",
    "geo_id": r"\b(GSE\d+)\b",
    "sra_id": r"\b((?:SR|ER|DR)[RX]\d{7})\b",
    "srp_id": r"\b(SRP\d{6})\b",
    "empiar_id": r"\b(EMPIAR-\d{4,7})\b",
    "ensembl_id": r"\b(ENS[A-Z0-9]+)\b",
    "refseq_id": r"\b((?:NM|NC|NR|NP|NG|NT|XM|XR|XP|WP|NW|NZ|CP|AP|AC|KX)_?\d+(?:\.\d+)?)\b",
    "biosample_id": r"\b(SAMN\d+)\b",
    "proteomexchange_id": r"\b(PXD\d+)\b",
    "cellosaurus_id": r"\b(CVCL_[A-Z0-9]+)\b",
    "dbsnp_id": r"\b(rs\d+)\b",
    "arrayexpress_id": r"\b(E-[A-Z]{3,5}-\d+)\b",
    "hpa_id": r"\b((?:HPA|CAB)\d+)\b",
    "uniprot_id": r"\b([A-NR-Z][0-9][A-Z][A-Z0-9]{2}[0-9]|[OPQ][0-9][A-Z0-9]{3}[0-9])\b",
    "cath_id": r"(\b3\.(?:[1-9]\d{0,2}|0)\.(?:[1-9]\d{0,2}|0)\.(?:[1-9]\d{0,2}|0)\b)",
}

# Status codes of errors
ERROR_STATUS = {
    "ORDER_NOT_FOUND": 404,
    "ORDER_ALREADY_LOCKED": 409,
    "INVALID_LOCK": 401,
    "CONCURRENT_MODIFICATION": 409,
    "LOCK_ACQUISITION_FAILED": 409,
    "AMENDMENT_FAILED": 400,
    "LOCK_RELEASE_FAILED": 400,
    "LOCK_EXTENSION_FAILED": 400,
    "ORDER_CANNOT_BE_AMENDED": 409,
}
