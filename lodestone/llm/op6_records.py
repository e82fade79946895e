"""Token ids as length-delimited binary records, with an offset index beside each file.

A record is: 8 bytes length, 4 bytes masked checksum of those, the payload, 4 bytes masked checksum of the payload; all
little-endian. The checksum is zlib's crc32, masked by rotating it right by 15 bits and adding a constant, so that
checksums of data that hold checksums stay sound. The payload is a flag byte (1: the id is null), the id as a signed
64-bit integer, and the token ids at the width of the vocabulary (2 bytes up to 65,536 ids, else 4). The index has, for
each record: the flag (1 byte), document id, byte offset, ids before it in its file (8 bytes each), number of ids (4
bytes). ``read_index`` gives the entries of all files as rows, ``fetch`` takes records from them in any order by seeking.

Files are in ascending order of document id (null first, repeats by text), one for each range partition. A task writes
under a name of its own, so a lost or repeated task leaves at most an orphan file: only those in the manifest, made of
the tasks that counted, are read. Null and empty texts: the end id alone. Whole texts are encoded, however long. Empty
table: no files, no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, sliced

MASK = 0xA282EAD8
END_ID = 1
CACHE = 600_000
#: Latin letters, then signs that no rule of the splitter starts with.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?*&%$#|)\]]*)")
FRAME, PRE, INDEX = "<QI", "<Bq", "<BqQQI"
WROTE = "shard long, name string, docs long, ids long"
OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def unframe(f) -> bytes | None:
    """The next payload of an open file, None at its end; ValueError if it is damaged."""
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack(FRAME, head)[1]:
        raise ValueError("damaged length")
    n = struct.unpack(FRAME, head)[0]
    body = f.read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
        raise ValueError("damaged record")
    return body[:n]


class WordIds(dict):
    """Token ids of a space-delimited unit, packed; kept for the latest of them.

    The vocabulary's splitter drops white space, parts letters from signs, and never joins what stands on both sides of
    such a place; letters are read in lower case. So a text's ids are those of its units, one after the other, and a
    unit of Latin letters with plain signs behind them has the ids of its lower-case letters, then those of its signs.
    Words of letters are encoded many at a time: each is one word of the splitter, so the ids part again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "<H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<I"
        self.width = struct.calcsize(self.code)
        self.letters: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {"": b""}

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code[1]}", *ids)

    def add_letters(self, words: list[str]) -> None:
        for k in range(0, len(words), 500):
            part = words[k : k + 500]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, of, at = e.ids, e.word_ids, 0
            ends = [i for i in range(1, len(of)) if of[i] != of[i - 1]] + [len(of)]
            for w, end in zip(part, ends, strict=True):
                self.letters[w], at = self.packed(ids[at:end]), end

    def add(self, units: list[str]) -> None:
        plain, new = [], set()
        for u in units:
            if m := PLAIN.fullmatch(u):
                word, sign = m[1].lower(), m[2]
                plain.append((u, word, sign))
                if word not in self.letters:
                    new.add(word)
                if sign not in self.signs:
                    self.signs[sign] = self.packed(self.tokenizer.encode(sign, add_special_tokens=False).ids)
            else:
                self[u] = self.packed(self.tokenizer.encode(u, add_special_tokens=False).ids)
        self.add_letters(list(new))
        for u, word, sign in plain:
            self[u] = self.letters[word] + self.signs[sign]

    def of(self, text: str) -> bytes:
        units = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.__getitem__, units))
        except KeyError:
            pass
        if len(self.letters) > CACHE:
            self.letters.clear()
        if len(self) > CACHE or len(self.signs) > CACHE:
            self.clear()
            self.signs = {"": b""}
        self.add([u for u in set(units) if u not in self])
        return b"".join(map(self.__getitem__, units))


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _encoders[path] = WordIds(path)
    return _encoders[path]


def writer(folder: str, tokenizer: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, out, index = f"part-{shard:06d}-{uuid.uuid4().hex}", None, None
        docs = ids = at = 0
        end = struct.pack(enc.code, end_id)
        try:
            for batch in sliced(batches):
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    if out is None:
                        out, index = store.open_output_stream(f"{root}/{name}.rec", buffer_size=1 << 20), store.open_output_stream(f"{root}/{name}.idx", buffer_size=1 << 18)
                    data = enc.of(text or "") + end
                    n = len(data) // enc.width
                    record = frame(struct.pack(PRE, doc_id is None, doc_id or 0) + data)
                    out.write(record)
                    index.write(struct.pack(INDEX, doc_id is None, doc_id or 0, at, ids, n))
                    docs, ids, at = docs + 1, ids + n, at + len(record)
        finally:
            if out is not None:
                out.close()
                index.close()
        if docs:
            yield pa.RecordBatch.from_pylist([{"shard": shard, "name": name, "docs": docs, "ids": ids}], schema=pa.schema([("shard", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return run


def write_records(spark: SparkSession, docs: DataFrame, folder: str, *, tokenizer: str, end_id=END_ID, doc_id="doc_id", text="text") -> list[dict]:
    """Encode and write; returns the manifest (one entry a file: name, docs, ids, and the ids of all files before)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    wrote = sorted(rows.mapInArrow(writer(folder, tokenizer, end_id), WROTE).collect(), key=lambda r: r["shard"])  # a row a file
    manifest, before = [], 0
    for r in wrote:
        manifest.append({"name": r["name"], "docs": r["docs"], "ids": r["ids"], "start": before})
        before += r["ids"]
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"width": encoder(tokenizer).width, "files": manifest}).encode())
    return manifest


def read_records(spark: SparkSession, folder: str, manifest: list[dict], width: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read from the files and checked."""
    import numpy as np

    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])
        for batch in batches:
            for name, at in zip(batch["name"].to_pylist(), batch["start"].to_pylist(), strict=True):
                held = []
                with store.open_input_stream(f"{root}/{name}.rec", buffer_size=1 << 20) as f:
                    while (p := unframe(f)) is not None:
                        null, doc_id = struct.unpack_from(PRE, p)
                        ids = np.frombuffer(p, kind, offset=9)
                        held.append((None if null else doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], schema=schema)
                            held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], schema=schema)

    files = spark.createDataFrame([(m["name"], m["start"]) for m in manifest], "name string, start long")
    return files.repartition(max(1, len(manifest))).mapInArrow(run, OUT)


ENTRY = "name string, doc_id long, offset long, start long, n_tokens long"


def read_index(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """(name, doc_id, offset, start, n_tokens) of every record, from the index files alone; start counts over all files."""
    schema = pa.schema([("name", pa.string()), *((c, pa.int64()) for c in ("doc_id", "offset", "start", "n_tokens"))])

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, at in zip(batch["name"].to_pylist(), batch["start"].to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{name}.idx", buffer_size=1 << 18) as f:
                    while part := f.read(4096 * struct.calcsize(INDEX)):
                        rows = [(name, None if null else doc_id, offset, at + before, n) for null, doc_id, offset, before, n in struct.iter_unpack(INDEX, part)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.createDataFrame([(m["name"], m["start"]) for m in manifest], "name string, start long")
    return files.repartition(max(1, len(manifest))).mapInArrow(run, ENTRY)


def fetch(spark: SparkSession, folder: str, entries: DataFrame, width: int) -> DataFrame:
    """``entries`` of the index, in the order and partitions they come in, with their ids, read at their offsets."""
    import numpy as np

    kind = {2: "<u2", 4: "<u4"}[width]
    d = entries.select("name", "doc_id", "offset", "start", "n_tokens")

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        held: dict[str, object] = {}
        try:
            for batch in sliced(batches):
                ids = []
                for name, offset in zip(batch["name"].to_pylist(), batch["offset"].to_pylist(), strict=True):
                    if name not in held:
                        if len(held) >= 64:
                            held.pop(next(iter(held))).close()
                        held[name] = store.open_input_file(f"{root}/{name}.rec")
                    held[name].seek(offset)
                    ids.append(np.frombuffer(unframe(held[name]), kind, offset=struct.calcsize(PRE)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])
        finally:
            for f in held.values():
                f.close()

    return d.mapInArrow(run, ENTRY + ", ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, folder = public_tokenizers.path("word_bpe_49k.json"), fresh_path(spark, "records")
    manifest = write_records(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer=path)
    return read_records(spark, folder, manifest, encoder(path).width)
