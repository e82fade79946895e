"""Personal data: base patterns, and information-theoretic sanitisation of what stands around them. No Python code runs
on the executors.

Base spans are e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers. Every span's value is a
protected entity. From all documents, co-occurrence within whole documents tells how much a term discloses an entity:
with ``PMI(t, e) = IC(e) + log(df(t, e) / df(t))`` and ``IC(e) = log(N / df(e))``, the share ``PMI / IC`` is 1 if the
term occurs nowhere else and falls with every other document that holds it. From ``generalise`` on, the term becomes a
placeholder, from ``remove`` on it is dropped. All of df(t, e), df(e), df(t) and N count documents, copies too.
Whether a pair is more than chance is told by how far its PMI exceeds what is expected: with k different texts of the
pair and m expected ones, ``k log(k / m) - k + m`` must reach ``surprise`` for the term to go from all documents of the
entity (by default chance brings such a pair about at most once in 100 times), and ``surprise`` plus the log of the
number of pairs for it to go from every other document as well. Of an entity's texts, copies and near copies are one in k
and m, as their words all come together and prove nothing. Texts meet by any of eight least hashes of five words in a
row; one counts as the least text met there that it resembles: NEAR of the telling terms of both, and SHARED at least,
are in both. Terms in half of all documents or more don't tell. A sentence or passage in common is no near copy.
An entity in a single text is settled as soon as the corpus is large enough.

Offsets are code points, ends exclusive. Null text is the empty text and has no spans. Repeated rows and null ids are
treated row by row. Empty table: no rows. Long runs of digits, dots or labels are matched without recursion: signs
between two digits, and dots between two label characters, are marked first by stand-ins (texts that hold these
non-characters have them blanked, at equal length).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import let
from ..operators.matching import all_matches
from .common import materialise, row_key, sieve, sifted, used_up

KINDS = ("email", "ip", "card", "phone")
TERMS = "array<struct<start:int,end:int,action:string>>"
SIGN, DOT = "\ufdd0", "\ufdd1"
SURPRISE = 4.6
SKETCHES = 8
KEPT_TERMS = 256
NEAR = 0.5
SHARED = 5
GENERALISE = 0.7
REMOVE = 0.9
TERM = r"\p{L}{3,}"
COMMON = 200_000
LOCAL = rf"[A-Za-z0-9._%+\-{DOT}]"
PATTERNS = {
    # possessive, and only from the start of a run or the end of the last match: any other start fails likewise
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]+{DOT}[A-Za-z0-9\-{DOT}]*",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of digits and marked signs, if it has 13 to 19 digits
    "card": rf"(?<![0-9{SIGN}])[0-9](?:{SIGN}?[0-9]){{12,18}}(?![0-9{SIGN}])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def one(i: Column) -> Column:
        d = F.substr(number, -i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(number)), one), F.lit(0), lambda a, x: a + x) % 10 == 0


CHECKS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: p.cast("double") <= 255),
    "card": lambda v: luhn(digits(v)),
    "phone": lambda v: F.length(digits(v)).between(9, 15),
}


def mail_view(text: Column) -> Column:
    """The text with a stand-in for dots between label characters, at equal length."""
    return F.regexp_replace(F.translate(text, SIGN + DOT, "||"), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind, array<struct<start, end, value>> of the spans in a text that is not null."""
    plain = F.translate(text, SIGN + DOT, "||")
    view = {
        "email": mail_view(text),
        "ip": text,
        "card": F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", SIGN),
        "phone": text,
    }
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    seen = {k: F.contains(text, F.lit("@")) if k == "email" else F.rlike(text, F.lit(GUARDS[k])) for k in KINDS}
    passed = lambda k: F.filter(all_matches(view[k], PATTERNS[k]), lambda s: CHECKS[k](s["value"]))
    return {k: F.when(seen[k], passed(k)).otherwise(none) for k in KINDS}


def masked(text: Column) -> Column:
    """The text with blanks for e-mail addresses, at equal length; the other kinds hold no letters. (Dots between label
    characters are stand-ins, which matters to no term.)"""
    view, pattern = mail_view(text), F.lit(PATTERNS["email"])
    values = F.regexp_extract_all(view, F.concat(F.lit("("), pattern, F.lit(")")), 1)
    parts = F.zip_with(F.split(view, pattern, -1), values, lambda g, v: F.concat(g, F.coalesce(F.repeat(F.lit(" "), F.length(v)), F.lit(""))))
    return F.when(F.contains(text, F.lit("@")), F.array_join(parts, "")).otherwise(text)


def find(spark: SparkSession, docs: DataFrame, *, text="text", doc_id="doc_id") -> DataFrame:
    """(dk, own, sk, spans, forms) of every row, written out; dk tells rows apart by id and text; of rows with spans, own tells
    texts apart and sk are hashes that near copies share. A span has kind, start, end and the entity (numbers by their
    digits); forms are the different terms of the whole text outside of e-mail addresses."""
    d = docs.select(row_key(doc_id, text).alias("dk"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.select("dk", "t", *(c.alias(k) for k, c in base_spans(F.col("t")).items()))

    def dress(kind: str) -> Column:
        value = {"email": lambda v: F.lower(F.translate(v, DOT, ".")), "ip": lambda v: v}.get(kind, digits)
        return F.transform(F.col(kind), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit(kind + ":"), value(s["value"])).alias("entity")))

    without = F.when(F.contains("t", F.lit("@")), F.regexp_replace(mail_view(F.col("t")), PATTERNS["email"], " ")).otherwise(F.col("t"))
    forms = F.array_distinct(F.regexp_extract_all(without, F.lit(TERM), 0))
    d = d.select("dk", "t", F.concat(*map(dress, KINDS)).alias("spans"), forms.alias("forms"))
    both = let(runs(F.col("t")), lambda h: F.struct(F.xxhash64(h).alias("own"), least_each(h).alias("sk")))
    d = d.select("dk", F.when(F.size("spans") > 0, both).alias("both"), "spans", "forms")
    return materialise(spark, d.select("dk", "both.own", "both.sk", "spans", "forms"), "pii")


def runs(text: Column) -> Column:
    """Hashes of the runs of five words (of all words, if there are fewer)."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return let(words, lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0))), lambda k: F.xxhash64(F.array_join(F.slice(w, k + 1, F.lit(5)), " "))))


def least_each(hashes: Column) -> Column:
    """The least of SKETCHES further hashes each."""
    least = lambda r: F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, F.lit(r))))
    return F.array(*(least(r) for r in range(SKETCHES)))


def sketch(text: Column) -> Column:
    """The least of SKETCHES hashes each over the runs of five words (all words, if there are fewer)."""
    return let(runs(text), least_each)


def least_of(hashes: Column) -> Column:
    """The KEPT_TERMS least different ones, in order."""
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, KEPT_TERMS)


def near(a: Column, b: Column) -> Column:
    """Whether two sets, given by their KEPT_TERMS least elements, share SHARED elements and NEAR of all that they hold
    (exact if they hold no more)."""
    both = lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b)))
    return let(least_of(F.concat(a, b)), lambda u: let(both(u), lambda n: (n >= SHARED) & (n >= NEAR * F.size(u))))


def kin(spark: SparkSession, some: DataFrame, held: DataFrame, dull: DataFrame) -> DataFrame:
    """(dk, entity, tk) of ``held`` (dk, own, sk, entity), written out: what a row's text counts as, the least of its own
    and of the least texts that it meets at its sketches and resembles by its forms (in ``some``) but the terms in ``dull``."""
    each = held.select("entity", "own", F.posexplode("sk").alias("r", "s"))
    least = each.groupBy("entity", "r", "s").agg(F.min("own").alias("least"))
    met = materialise(spark, each.join(least, ["entity", "r", "s"]).where("own != least").select("entity", "own", "least").distinct(), "pii-met")
    pairs = met.select("own", "least").distinct()
    # terms are moved for texts that meet others alone
    bits = sieve(spark, pairs.select("own").unionByName(pairs.select(F.col("least").alias("own"))), "met")
    low = sifted(some.select("own", "forms"), "own", bits).where("__may").crossJoin(F.broadcast(dull.agg(F.collect_list("term").alias("dull"))))
    telling = F.array_except(F.transform("forms", lambda x: F.lower(x)), F.col("dull"))
    low = low.select("own", least_of(F.transform(telling, lambda x: F.xxhash64(x))).alias("low")).groupBy("own").agg(F.min("low").alias("low"))
    low = materialise(spark, low, "pii-low")
    alike = pairs.join(low, "own").join(low.select(F.col("own").alias("least"), F.col("low").alias("other")), "least").where(near(F.col("low"), F.col("other")))
    kept = met.join(alike.select("own", "least"), ["own", "least"]).groupBy("entity", "own").agg(F.min("least").alias("least"))
    out = held.select("dk", "entity", "own").join(kept, ["entity", "own"], "left").select("dk", "entity", F.least("own", "least").alias("tk"))
    out = materialise(spark, out, "pii-kin")
    used_up(spark, met, bits, low)
    return out


def disclosures(spark: SparkSession, found: DataFrame, *, surprise=SURPRISE, generalise=GENERALISE, remove=REMOVE) -> DataFrame:
    """(dk, hits) of the rows with terms that disclose some entity, written out; hits maps forms to 'generalise' or 'remove'."""
    terms = F.array_distinct(F.transform("forms", lambda x: F.lower(x)))
    df = materialise(spark, found.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df_term")), "pii-df")
    n = float(max(found.count(), 1))
    some = found.where(F.size("spans") > 0)
    held = some.select("dk", "own", "sk", F.explode(F.array_distinct(F.transform("spans", lambda s: F.xxhash64(s["entity"])))).alias("entity"), "forms")
    # entities go by their hash, which is short; rows that repeat share dk and stand for themselves in all counts
    classes = kin(spark, some, held.select("dk", "own", "sk", "entity").distinct(), df.where(F.col("df_term") >= n / 2))
    tks = classes.groupBy("dk").agg(F.map_from_entries(F.collect_list(F.struct("entity", "tk"))).alias("tks"))  # a document's entities
    docs = materialise(spark, some.select("dk", "forms").join(tks, "dk"), "pii-held")  # words are moved once
    held = docs.select("dk", F.explode("tks").alias("entity", "tk"), "forms")
    per_text = held.groupBy("entity", "tk").agg(F.count("*").alias("rows"))
    entities = materialise(spark, per_text.groupBy("entity").agg(F.sum("rows").alias("df_entity"), F.count("*").alias("entity_texts")), "pii-entities")
    # no pair with a term of more documents than this reaches the share; such terms of the commonest are left out at once
    most = float(entities.agg(F.max("df_entity")).first()[0] or 0) ** generalise * n ** (1 - generalise) * 1.001
    plain = F.broadcast(commonest(df).where(F.col("df_term") > most).select("term"))
    pairs = held.select("tk", "entity", F.explode(terms).alias("term")).join(plain, "term", "left_anti")
    pairs = pairs.groupBy("entity", "term", "tk").agg(F.count("*").alias("rows")).groupBy("entity", "term").agg(F.sum("rows").alias("df_pair"), F.count("*").alias("texts"))
    pairs = pairs_made = materialise(spark, pairs, "pii-pairs")
    tried = float(max(pairs.count(), 1))
    pairs = pairs.join(df, "term").join(entities, "entity")
    ic = F.log(F.lit(n) / F.col("df_entity"))
    share = F.when(ic > 0, 1 + F.log(F.col("df_pair") / F.col("df_term")) / ic)
    # different texts where the term stands with the entity, and how many chance would give; further copies count in neither
    k = F.col("texts")
    m = F.col("entity_texts") * (F.col("df_term") - F.col("df_pair") + k) / (F.lit(n) - F.col("df_entity") + F.col("entity_texts"))
    pairs = pairs.select("entity", "term", share.alias("share"), k.alias("k"), m.alias("m")).where((F.col("share") >= generalise) & (F.col("k") > F.col("m")))
    pairs = pairs.withColumn("gain", F.col("k") * F.log(F.col("k") / F.col("m")) - F.col("k") + F.col("m")).where(F.col("gain") >= surprise)
    action = F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("action")
    telling = materialise(spark, pairs.select("entity", "term", action, (F.col("gain") >= surprise + F.log(F.lit(tried))).alias("wide")), "pii-telling")
    # of the terms beside each entity, only those that may tell are dealt out
    both = sieve(spark, telling.select(F.xxhash64("entity", "term").alias("pair")), "telling")
    own = held.select("dk", "entity", F.explode("forms").alias("form")).withColumn("pair", F.xxhash64("entity", F.lower("form")))
    own = sifted(own, "pair", both).where("__may").select("dk", "entity", "form", F.lower("form").alias("term"))
    own = own.join(telling.hint("merge"), ["entity", "term"]).select("dk", "form", "action")
    wide = telling.where("wide").groupBy("term").agg(F.max("action").alias("action"))
    # never empty (no word is that short), so that the plan is the same whether there are such terms or not
    wide = materialise(spark, wide.unionByName(spark.range(1).select(F.lit("").alias("term"), F.lit("generalise").alias("action"))), "pii-wide")
    # words that are common and disclose nothing, most of all text, need not be dealt out
    dull = F.broadcast(commonest(df).join(wide, "term", "left_anti").select("term"))
    words = found.select("dk", F.explode("forms").alias("form")).withColumn("term", F.lower("form")).join(dull, "term", "left_anti")
    bits = sieve(spark, wide.select("term"), "wide")
    words = sifted(words, "term", bits).where("__may")
    hits = own.unionByName(words.join(wide, "term").select("dk", "form", "action"))
    hits = hits.groupBy("dk", "form").agg(F.max("action").alias("action")).groupBy("dk").agg(F.map_from_entries(F.collect_list(F.struct("form", "action"))).alias("hits"))
    hits = materialise(spark, hits, "pii-hits")
    used_up(spark, df, classes, docs, entities, pairs_made, telling, wide, bits, both)
    return hits


def commonest(df: DataFrame) -> DataFrame:
    """The terms that hold at least a COMMON-th of all places each: never more than COMMON terms."""
    places = df.agg(F.sum("df_term")).first()[0] or 0
    return df.where(F.col("df_term") >= places / COMMON)


def mark(spark: SparkSession, docs: DataFrame, *, text="text", doc_id="doc_id", **options) -> DataFrame:
    """``docs`` with __spans (the base spans) and __terms (start, end and action of disclosing terms). Only texts that may
    have some, by a sieve of their keys, are shuffled to them."""
    found = find(spark, docs, text=text, doc_id=doc_id)
    hits = disclosures(spark, found, **options)
    base = found.where(F.size("spans") > 0).select("dk", "spans", F.lit(None).cast("map<string,string>").alias("hits"))
    both = base.unionByName(hits.select("dk", F.lit(None).cast(base.schema["spans"].dataType).alias("spans"), "hits"))
    both = both.groupBy(F.col("dk").alias("__dk")).agg(F.first("spans", True).alias("__spans"), F.first("hits", True).alias("__hits"))
    both = materialise(spark, both, "pii-marks")
    used_up(spark, found, hits)
    none, no_terms = F.array().cast(base.schema["spans"].dataType), F.array().cast(TERMS)
    d = sifted(docs.withColumn("__dk", row_key(doc_id, text)), "__dk", sieve(spark, both.select("__dk"), "marks"))
    plain = d.where("NOT __may").withColumn("__spans", none).withColumn("__terms", no_terms)
    d = d.where("__may").join(both, "__dk", "left").withColumn("__spans", F.coalesce("__spans", none))
    some = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.map_keys("__hits"), "|"), F.lit(r")(?!\p{L})"))
    terms = F.transform(all_matches(masked(F.col(text)), some), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.col("__hits")[m["value"]].alias("action")))
    d = d.withColumn("__terms", F.when(F.col("__hits").isNotNull(), terms).otherwise(no_terms)).drop("__hits")
    return d.unionByName(plain).drop("__dk", "__may")


def sanitise(spark: SparkSession, docs: DataFrame, *, text="text", doc_id="doc_id", **options) -> DataFrame:
    """``docs`` with base spans replaced by their kind in brackets, disclosing terms by [TERM] or nothing."""
    d = mark(spark, docs, text=text, doc_id=doc_id, **options)
    base = F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put")))
    term = F.transform("__terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == "remove", F.lit("")).otherwise(F.lit("[TERM]")).alias("put")))
    none = F.array().cast("array<struct<start:int,end:int,put:string>>")
    # of overlapping base spans the first stands; terms overlap nothing
    apart = F.aggregate(
        F.array_sort(base),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, c: F.when(c["start"] >= acc["at"], F.struct(c["end"].alias("at"), F.concat(acc["out"], F.array(c)).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )
    d = d.withColumn("__cuts", F.array_sort(F.concat(apart, term)))
    last = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("__cuts", i - 1)["end"])
    pieces = F.transform(F.col("__cuts"), lambda c, i: F.concat(F.substr(text, last(i) + 1, c["start"] - last(i)), c["put"]))
    tail = F.substr(F.col(text), F.element_at("__cuts", -1)["end"] + 1)
    return d.withColumn(text, F.when(F.size("__cuts") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col(text))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = mark(spark, docs)
    shown = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    terms = F.transform("__terms", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    of = lambda kind: F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [F.size("__terms").cast("long").alias("n_term"), (F.size("__spans") + F.size("__terms")).cast("long").alias("n_spans")]
    out = out.select("doc_id", *map(of, KINDS), *counts, shown(F.col("__spans")).alias("base"), shown(terms).alias("more"))
    spans = F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif("more", F.lit(""))).alias("spans")
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), spans, "n_term", "n_spans")
