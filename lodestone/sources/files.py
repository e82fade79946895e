"""Readers and writers. Schemas are given; only the columns of catalogs come from the headers of their files."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEM = r"([^/]+?)(?:\.[^./]+)?$"
PROCESSED = "processing_info struct<total_files:long,total_chunks:long,total_identifiers:long>, chunks array<struct<pattern_name:string,chunk_text:string,result_value:string>>, found_items array<struct<type:string,article_id:string,identifier:string>>"


def stem(path="_metadata.file_path"):
    return F.regexp_extract(path, STEM, 1)


def xml_directory(spark: SparkSession, path: str) -> DataFrame:
    """(article_id, content) of a folder of XML files, in whatever encoding they declare."""
    import pyarrow as pa

    from ..operators.xmltext import decoded

    raw = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", STEM, 1).alias("article_id"), "content")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["article_id"], pa.array([decoded(c) for c in b["content"].to_pylist()], pa.string())], ["article_id", "content"])

    return raw.mapInArrow(run, "article_id string, content string")


def publication_datasets(spark: SparkSession, path: str) -> DataFrame:
    """(article_id, datasets) of a JSON object that maps publications to the identifiers of their datasets."""
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("publication", "datasets"))
    return d.select(F.replace("publication", F.lit("/"), F.lit("_")).alias("article_id"), "datasets")


def binary_directory(spark: SparkSession, path: str, decoder, glob="*.pdf") -> DataFrame:
    """(article_id, text, cover): ``decoder`` turns the bytes of a file into the texts of its pages. Pages are joined by
    line breaks; the cover is the first page and those after it while it is under 1,000 characters."""
    import pyarrow as pa

    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.regexp_extract("path", STEM, 1).alias("article_id"), "content")

    def run(batches):
        for b in batches:
            pages = [decoder(c) for c in b["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["article_id"], pa.array(["\n".join(p) for p in pages], pa.string()), pa.array([cover(p) for p in pages], pa.string())], ["article_id", "text", "cover"])

    return raw.mapInArrow(run, "article_id string, text string, cover string")


def cover(pages: list[str], least: int = 1000) -> str:
    out = ""
    for p in pages:
        if out and len(out) >= least:
            break
        out = f"{out}\n{p}" if out else p
    return out


def catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id, pmc_ids, ext_ids, source) of CSV files whose key column is named after the file; files without it are skipped."""
    parts = []
    for p in paths:
        d = spark.read.csv(p, header=True)
        by_name = {c.lower(): c for c in d.columns}
        key = p.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        if key.lower() not in by_name:
            continue
        opt = lambda n: F.col(by_name[n]) if n in by_name else F.lit(None).cast("string")  # noqa: B023, E731
        parts.append(d.select(F.col(by_name[key.lower()]).alias("id"), opt("pmcid").alias("pmc"), opt("extid").alias("ext"), F.lit(key).alias("source")))
    return catalog_sets(functools.reduce(DataFrame.unionByName, parts)) if parts else spark.createDataFrame([], "id string, pmc_ids array<string>, ext_ids array<string>, sources array<string>")


def catalog_sets(rows: DataFrame) -> DataFrame:
    """Rows (id, pmc, ext, source) gathered by id into sorted sets; nulls are skipped."""
    s = lambda c: F.array_sort(F.collect_set(c))
    return rows.where("id IS NOT NULL").groupBy("id").agg(s("pmc").alias("pmc_ids"), s("ext").alias("ext_ids"), s("source").alias("sources"))


def doi_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doi): trimmed, lower case, distinct; lines that don't start like a DOI are skipped."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("doi")).where(F.startswith("doi", F.lit("10."))).distinct()


def labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """(content, label) of tab-separated lines; blank lines are skipped."""
    return spark.read.csv(path, sep="\t", schema="content string, label int", quote="").where("content IS NOT NULL")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(filename, label) of space-separated lines; of a repeated name the last line counts."""
    d = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("x"), "_metadata.file_path", F.monotonically_increasing_id().alias("line"))
    return last_wins(d.where("size(x) = 2").select(F.col("x")[0].alias("filename"), F.col("x")[1].cast("long").alias("label"), "line"), "filename", "label", "line")


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def folder_labels(spark: SparkSession, path: str) -> DataFrame:
    """(filename, label) of image files in numbered folders; folders count from 1, labels from 0."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return d.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), (F.regexp_extract("path", r"(\d+)/[^/]+$", 1).cast("long") - 1).alias("label"))


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, name) of a JSON object."""
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("class_id", "name"))
    return d.select(F.col("class_id").cast("int").alias("class_id"), "name")


def embeddings_for(lines: DataFrame, vocab: DataFrame, size=300, seed=7) -> DataFrame:
    """(id, vector) for a vocabulary from lines 'word v1 v2 ...'; words without one get seeded random values."""
    parts = F.split("value", " ")
    v = lines.select(parts[0].alias("token"), F.transform(F.slice(parts, 2, size), lambda x: x.cast("double")).alias("vector")).where(F.size("vector") == size)
    fill = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.pmod(F.xxhash64("token", i, F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0)
    return vocab.join(v, "token", "left").select("id", F.coalesce("vector", fill).alias("vector"))


def processed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROCESSED).json(path, multiLine=True)


def filter_blank(results: DataFrame) -> DataFrame:
    """Chunks without a value and items without an identifier go; the counts before stay beside them."""
    full = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    d = results.withColumns({"original_chunks": F.size("chunks"), "original_identifiers": F.size("found_items")})
    d = d.withColumn("chunks", F.filter("chunks", lambda c: full(c["result_value"]))).withColumn("found_items", F.filter("found_items", lambda c: full(c["identifier"])))
    return d.withColumns({"filtered_out_chunks": F.col("original_chunks") - F.size("chunks"), "filtered_out_identifiers": F.col("original_identifiers") - F.size("found_items")})


def blank_report(results: DataFrame, samples=5) -> DataFrame:
    """How many chunks are blank, with the first few."""
    c = results.select(F.inline("chunks")).where(F.length(F.trim(F.coalesce("result_value", F.lit("")))) == 0)
    first = c.orderBy("pattern_name", "chunk_text").limit(samples)
    return c.agg(F.count("*").alias("blank")).join(F.broadcast(first.agg(F.collect_list(F.struct("pattern_name", "chunk_text")).alias("samples"))))


def write_csv(df: DataFrame, path: str) -> None:
    """With header, all fields quoted."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape="\\")


def datasets_json(resolved: DataFrame) -> DataFrame:
    """One row: the JSON text of a run, datasets by article, all of them, and a summary."""
    from ..operators.validate import datasets_by_article

    by = datasets_by_article(resolved).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("article_key", "datasets")))).alias("datasets_by_article"), F.count("*").alias("a"))
    every = resolved.agg(F.array_sort(F.collect_set("doi")).alias("all_datasets"), F.count_distinct("doi").alias("n"))
    summary = F.struct(F.col("a").alias("articles_with_datasets"), F.col("n").alias("total_unique_datasets"))
    return by.join(F.broadcast(every)).select(F.to_json(F.struct("datasets_by_article", "all_datasets", summary.alias("summary"))).alias("value"))


def write_datasets(resolved: DataFrame, path: str, *, one_file: bool = True) -> None:
    """One JSON file, as ``datasets_json`` makes it: a report, which must fit a task. Otherwise, for results of any size,
    folders: a JSON line an article, a line a dataset, and the summary."""
    from ..operators.validate import datasets_by_article

    if one_file:
        datasets_json(resolved).coalesce(1).write.mode("overwrite").text(path)
        return
    by = datasets_by_article(resolved)
    by.select(F.to_json(F.struct("article_key", "datasets")).alias("value")).write.mode("overwrite").text(f"{path}/datasets_by_article")
    resolved.select("doi").distinct().orderBy("doi").write.mode("overwrite").text(f"{path}/all_datasets")
    resolved.agg(F.count_distinct("article_id").alias("articles_with_datasets"), F.count_distinct("doi").alias("total_unique_datasets")).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/summary")


def jdbc(spark: SparkSession, url: str, table: str, *, column=None, low=None, high=None, parts=1, **options) -> DataFrame:
    """A table of a database; filters and columns are pushed down, and ranges of ``column`` read side by side."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return (r.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts) if column else r).load()
