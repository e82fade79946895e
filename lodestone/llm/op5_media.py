"""Media columns: interleaved document sequences.

``interleave`` parses HTML into an ordered array of items, text or a reference to media, with the caption (of its
figure, else its alternative text) beside the reference. ``resolve`` joins references to a table of payloads by the
digest that they name: positions, captions and unresolved references stay as they are. ``store_samples`` puts byte
payloads into WAV containers (8-bit samples) and writes those out; ``read_samples`` reads the stored bytes back,
checks them and computes what goes beside a digest.

Null and empty HTML: no items. Broken markup is read as far as it goes; text inside script, style and template is not
text of the document. A reference with another address than ``sha256:<hex>`` or without a payload stays unresolved. A
digest that several rows store is one payload. Whole pages and payloads are read, however long. Repeated rows are pages of
their own. Columns of pages go along, but one named ``items`` is replaced. Empty tables: no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, sliced, with_fields

ITEMS = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"
SILENT = {"script", "style", "template", "head"}
BLOCKS = {"p", "div", "li", "ul", "ol", "table", "tr", "td", "th", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "blockquote", "pre", "nav", "header", "footer", "main", "aside", "body", "figure"}
MEDIA = {"img", "audio", "video", "source", "embed"}
RATE = 8_000
STORED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.words, self.silent, self.figure, self.caption = [], [], 0, [], None

    def flush(self):
        if text := " ".join("".join(self.words).split()):
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})
        self.words = []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in SILENT:
            self.silent += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in MEDIA and attrs.get("src"):
            self.flush()
            self.items.append({"kind": "media", "text": None, "ref": attrs["src"], "caption": attrs.get("alt") or None})
            if self.figure:
                self.figure[-1].append(len(self.items) - 1)
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure.append([])

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            if self.figure and text:
                self.figure[-1].append(text)
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure" and self.figure:
                own = self.figure.pop()
                text = next((x for x in own if isinstance(x, str)), None)
                for k in own:
                    if text and not isinstance(k, str):
                        self.items[k]["caption"] = text

    def handle_data(self, data):
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    """The items of a page in order, with their positions from 0."""
    p = _Sequence()
    p.feed(html or "")
    p.close()
    while p.figure:
        p.handle_endtag("figure")
    p.flush()
    return [{"pos": k} | x for k, x in enumerate(p.items)]


def interleave(spark: SparkSession, pages: DataFrame, html="html") -> DataFrame:
    """``pages`` with ``items`` in place of ``html``."""
    kept = [c for c in pages.columns if c not in (html, "items")]
    d = pages.select(*kept, F.col(html).alias("__html"))
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches):
        for batch in sliced(batches, 256):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([sequence(h) for h in batch["__html"].to_pylist()], kind)], [*kept, "items"])

    return d.mapInArrow(run, with_fields(d.select(*kept).schema, items=ITEMS))


def resolve(pages: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row for each media item of ``pages`` (with items), its payload's columns beside it by digest (null: none)."""
    kept = [c for c in pages.columns if c != "items"]
    refs = pages.select(*kept, F.explode("items").alias("item")).where("item.kind = 'media'")
    refs = refs.select(*kept, "item.pos", "item.ref", "item.caption", F.nullif(F.regexp_extract("item.ref", "^sha256:([0-9a-f]{64})$", 1), F.lit("")).alias("digest"))
    one = payloads.groupBy("digest").agg(*(F.min(c).alias(c) for c in payloads.columns if c != "digest"))  # copies are alike
    one = materialise(pages.sparkSession, one, "payloads")  # read from files, a digest that many refer to can be split in the join
    return refs.join(one, "digest", "left")


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono samples in a RIFF container; an odd number of them is padded as the format asks."""
    body = samples + b"\0" * (len(samples) % 2)
    n = (36 + len(body)).to_bytes(4, "little")
    fmt = b"".join(v.to_bytes(k, "little") for v, k in ((16, 4), (1, 2), (1, 2), (rate, 4), (rate, 4), (1, 2), (8, 2)))
    return b"RIFF" + n + b"WAVEfmt " + fmt + b"data" + len(samples).to_bytes(4, "little") + body


def unwav(media: bytes) -> bytes:
    """The samples of a container as ``wav`` makes it; ValueError if it is something else."""
    n = int.from_bytes(media[40:44], "little")
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data" or len(media) < 44 + n:
        raise ValueError("not such a container")
    return media[44 : 44 + n]


def feature(samples: bytes) -> str:
    """Mean, spread, crossings of the middle and the energy of 8 equal parts of a signal, as fixed text."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
    parts = [float(np.sqrt((p * p).mean())) for p in np.array_split(x, 8) if len(p)]
    return f"mean={x.mean():.4f};sd={x.std():.4f};cross={int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())};rms=" + ",".join(f"{p:.3f}" for p in parts)


def store_samples(spark: SparkSession, payloads: DataFrame) -> DataFrame:
    """(digest, payload) to stored (digest, media), written to the shared folder; what is returned reads the files."""

    def run(batches):
        for batch in sliced(batches, 256):
            yield pa.RecordBatch.from_arrays([batch["digest"], pa.array([wav(b) for b in batch["payload"].to_pylist()], pa.binary())], ["digest", "media"])

    return materialise(spark, payloads.select("digest", "payload").mapInArrow(run, "digest string, media binary"), "media")


def read_samples(spark: SparkSession, stored: DataFrame) -> DataFrame:
    """What the stored bytes hold, by digest."""

    def run(batches):
        for batch in sliced(batches, 256):
            rows = []
            for digest, media in zip(batch["digest"].to_pylist(), batch["media"].to_pylist(), strict=True):
                p = unwav(media)
                rows.append((digest, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(p)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(run, STORED)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text becomes a payload, and a page that shows it between its first line and all the others; the pages'
    references are resolved to the stored bytes. ``pos`` is the place of the reference among the items of its page."""
    text, name = F.coalesce(F.col("text"), F.lit("")), escaped(F.coalesce(F.col("doc_id").cast("string"), F.lit("?")))
    raw = text.cast("binary")
    n = F.length(raw).cast("long")
    pad = F.greatest(F.lit(64), F.ceil(n / 64).cast("long") * 64) - n
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.alias("text"), n.alias("n_bytes"), F.concat(raw, F.unhex(F.repeat(F.lit("00"), pad.cast("int")))).alias("payload"))
    docs = docs.withColumn("digest", F.sha2("payload", 256))
    stored = store_samples(spark, docs)
    lead = F.substring_index("text", "\n", 1)
    rest = F.substr("text", F.length(lead) + 1)
    figure = F.concat(F.lit("<figure><img src='sha256:"), F.col("digest"), F.lit("'><figcaption>document "), name, F.lit("</figcaption></figure>"))
    html = F.concat(F.lit("<article><h1>"), name, F.lit("</h1><p>"), escaped(lead), F.lit("</p>"), figure, F.lit("<p>"), escaped(rest), F.lit("</p></article>"))
    pages = interleave(spark, docs.select("doc_id", "n_bytes", html.alias("html")))
    return resolve(pages, read_samples(spark, stored)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")


def resolved_pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages``, each with a figure at the head of its article that refers to a payload (the bytes of its address): the
    references of whole pages, resolved."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.coalesce("html", F.lit("")).alias("html"), F.coalesce("url", F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    stored = store_samples(spark, pages)
    mark = F.locate("<article>", F.col("html"))
    cut = F.when(mark > 0, mark + 8).otherwise(F.length("html"))  # right behind it, else at the end
    figure = F.concat(F.lit("<figure><img src='sha256:"), F.col("digest"), F.lit("'><figcaption>page "), F.col("page_id").cast("string"), F.lit("</figcaption></figure>"))
    html = F.concat(F.substr("html", F.lit(1), cut), figure, F.substr("html", cut + 1))
    items = interleave(spark, pages.select("page_id", html.alias("html")))
    return resolve(items, read_samples(spark, stored)).select("page_id", "pos", "caption", "payload_bytes", "payload_sha256")


def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of ``pages``: one row an item, in order."""
    out = interleave(spark, spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    return out.select("page_id", F.explode("items").alias("item")).select("page_id", "item.*")
