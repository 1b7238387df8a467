"""Token-id files with Elias-Fano document boundaries (2).

``write_store`` encodes whole texts, orders documents by doc_id and writes
pairs of files into a shared folder: ``.ids``, the concatenated ids as
unsigned 16- or 32-bit little-endian integers, and ``.idx``, the document
boundaries and doc_ids as two Elias-Fano sequences.  A task starts a new pair
after ``docs_per_file`` documents, so neither the writer's state nor a
reader's task grows with the input.  File names hold a random part and count
only if the manifest, which Spark commits, names them: files of lost or
repeated tasks are never read.

``read_store`` reads the files back, one pair a task, slice by slice.

Defined cases: a null or empty text is just the end id; a null doc_id sorts
first and comes back null; rows with equal doc_id follow each other in an
order fixed by their text; an empty table gives an empty store; other
columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changeflow.llm.common import ChunkEncoder, filesystem, joined, kept_in_worker, text_slices
from changeflow.llm.elias_fano import EliasFano

END_ID = 2
_HEAD = struct.Struct("<4sBQ")     # magic, bytes an id, documents without id
_MAGIC = b"CFT1"
READ_IDS = 2 << 20                 # ids handled at once by a reader
MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long"


def library_encoder(tokenizer_path: str):
    """Chunk encoder over a file of the tokenizers library, with the library's
    defaults: no token is added, the string of an added token is its one id.
    An added token without white space lies within one chunk; a text that holds
    another is encoded whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path)
    vocab = tok.get_vocab(with_added_tokens=True)
    token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        token_bytes[i] = len(token)          # byte-level tokens have a character for each byte
    added = tok.get_added_tokens_decoder()
    for i, token in added.items():
        token_bytes[i] = len(token.content.encode())
    whole = [t.content for t in added.values() if t.lstrip or t.rstrip or any(c.isspace() for c in t.content)]
    return ChunkEncoder(joined(
        lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)], token_bytes), whole=whole)


def id_width(tokenizer_path: str, end_id: int) -> int:
    """Bytes an id needs: 2 where all ids are below 65536, else 4."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    largest = max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", ()))])
    return 2 if largest < 1 << 16 else 4


class _Files:
    """One pair of files while it is written."""

    def __init__(self, folder: str, width: int):
        self.fs, own = filesystem(folder)
        self.name = uuid.uuid4().hex
        self.base, self.width = f"{own}/{self.name}", width
        self.ids = self.fs.open_output_stream(f"{self.base}.ids")
        self.ends: list[np.ndarray] = []
        self.doc_ids: list[int] = []
        self.n_docs = self.n_null = self.n_tokens = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.ids.write(ids.astype(f"<u{self.width}").tobytes())
        self.ends.append(self.n_tokens + np.cumsum(lengths))
        self.n_tokens += int(lengths.sum())
        self.n_docs += len(doc_ids)
        self.n_null += doc_ids.count(None)
        self.doc_ids += [d for d in doc_ids if d is not None]

    def close(self, part: int, seq: int) -> tuple:
        self.ids.close()
        with self.fs.open_output_stream(f"{self.base}.idx") as f:
            f.write(_HEAD.pack(_MAGIC, self.width, self.n_null))
            f.write(EliasFano.build(np.concatenate(self.ends)).to_bytes())
            f.write(EliasFano.build(self.doc_ids).to_bytes())
        return part, seq, self.name, self.n_docs, self.n_tokens


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID,
                docs_per_file: int = 100_000) -> DataFrame:
    """Write the store into ``folder`` (shared by all executors) and return
    its manifest: one row a file pair, in order of (part, seq)."""
    spark = docs.sparkSession
    fs, own = filesystem(folder)
    fs.create_dir(f"{own}/files", recursive=True)
    files, width = f"{folder}/files", id_width(tokenizer_path, end_id)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
               .repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie"))

    def write(batches):
        from pyspark import TaskContext
        part, seq, out, encoder = TaskContext.get().partitionId(), 0, None, kept_in_worker(
            f"library {tokenizer_path}", lambda: library_encoder(tokenizer_path))
        rows: list[tuple] = []
        for batch in text_slices(batches):
            ids, lengths = encoder(batch.column("text"))
            ids = np.insert(ids, np.cumsum(lengths), end_id)
            lengths = lengths + 1
            out = out or _Files(files, width)
            out.add(batch.column("doc_id").to_pylist(), ids, lengths)
            if out.n_docs >= docs_per_file:
                rows.append(out.close(part, seq))
                out, seq = None, seq + 1
        if out:
            rows.append(out.close(part, seq))
        for row in rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "seq", "file", "n_docs", "n_tokens"), row))],
                                             pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()),
                                                        ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with the end
    id) and ids (binary, unsigned 32-bit little-endian), from the files."""
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    manifest = (spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
                .withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))))
    files = f"{folder}/files"

    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                yield from _read_pair(files, name, base)
    n = max(1, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").count())
    return (manifest.select("file", "base").repartition(n, "file")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary"))


def _read_pair(folder: str, name: str, base: int):
    fs, own = filesystem(folder)
    with fs.open_input_file(f"{own}/{name}.idx") as f:
        data = f.read()
    magic, width, n_null = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError(f"{name}: not a token index")
    ends, at = EliasFano.from_bytes(data, _HEAD.size)
    doc_ids, _ = EliasFano.from_bytes(data, at)
    with fs.open_input_file(f"{own}/{name}.ids") as f:
        first, start = 0, 0
        while first < ends.n:
            end = ends.slice(first, min(8192, ends.n - first))
            k = max(1, int(np.searchsorted(end, start + READ_IDS, "right")))
            end = end[:k]
            ids = np.frombuffer(f.read((int(end[-1]) - start) * width), f"<u{width}").astype("<u4")
            starts = np.concatenate([[start], end[:-1]])
            nulls = max(0, min(k, n_null - first))
            own_ids = doc_ids.slice(first + nulls - n_null, k - nulls) if k > nulls else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], 4 * (end - start)]).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([
                pa.array([None] * nulls + own_ids.tolist(), pa.int64()), pa.array(base + starts),
                pa.array(end - starts), binary], ["doc_id", "start", "n_tokens", "ids"])
            first, start = first + k, int(end[-1])


def digest(store: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return store.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
