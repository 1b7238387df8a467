"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.session import remove_paths, scratch_path

SLICE_BYTES = 4 << 20      # text handled at once by a Python worker
SMALL_SLICE = 2 << 20      # the same, in operators that hold large tables besides
BATCH_BYTES = 4 << 20      # rows that Spark hands to a Python worker at once


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


ALWAYS = "always"
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``stored`` writes within is removed at the end.  Results that are
    read later are written with ``keep=True``; they go with the scratch
    around this one, if there is one.  ``keep=ALWAYS`` is for what a returned
    frame reads."""
    paths: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), paths))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in paths:
            if os.path.basename(path).startswith(_BY_KEY):
                spark.sql(f"DROP TABLE IF EXISTS {os.path.basename(path)}")
        remove_paths(spark, paths)


def release_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark's cleaner then removes the
    shuffle files of finished writes, which else wait for the driver's heap to
    fill while executors' disks do."""
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame, name: str, keep: bool | str = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at
    files that every executor can read again."""
    path = new_path(df.sparkSession, name)
    around = () if keep == ALWAYS else _SCRATCH.get()[:-1] if keep else _SCRATCH.get()
    if around:
        around[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_BY_KEY = "by_key_"


def stored_by(df: DataFrame, column: str, keep: bool = False) -> DataFrame:
    """``stored`` as a table bucketed by ``column``, in as many buckets as a
    shuffle has partitions: joins on the column do not shuffle it again.
    ``df`` should come from a shuffle by the column, or from files that did:
    other rows would be written to as many files a task as there are buckets."""
    spark = df.sparkSession
    name = f"{_BY_KEY}{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    around = _SCRATCH.get()[:-1] if keep else _SCRATCH.get()
    if around:
        around[-1].append(path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, column).option("path", path).saveAsTable(name)
    return spark.table(name)


BIT_WORDS = 1 << 18       # rows that a bit filter has at most


def _bit(column: str) -> tuple:
    place = F.pmod(F.xxhash64(column), F.lit(64 * BIT_WORDS))
    return F.floor(place / 64).cast("int"), (place % 64).cast("int")


def rows_that_may_match(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be among that of ``keys``: a bit
    for each hash, 64 a row, so the side that is broadcast has ``BIT_WORDS``
    rows at most.  It spares a join's shuffle rows without a partner while the
    keys are few against the bits, and lets all rows pass when they are many."""
    word, bit = _bit(column)
    bits = (keys.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word")
            .agg(F.expr("bit_or(shiftleft(1L, __bit))").alias("__bits")))
    tagged = df.withColumns({"__w": word, "__b": bit}).join(F.broadcast(bits), F.col("__w") == F.col("__word"))
    return tagged.filter(F.expr("(__bits & shiftleft(1L, __b)) != 0")).drop("__w", "__b", "__word", "__bits")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared path and the path within it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def release_memory() -> None:
    """Return what this Python worker has freed to the system, so that a
    reused worker starts its next task small."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
    if trim:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand rows to Python workers in batches of about
    ``BATCH_BYTES``.  Its own bound is 64 MB; such a batch of texts stands in
    the executor's direct memory and once more in the worker, for each task.
    The setting stays in the session, as plans read it when they run; a lower
    one is left as it is."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def text_slices(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...] = ("text",),
                max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most about ``max_bytes`` of
    text, or one row."""
    release_memory()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                   for c in columns)
        block = np.cumsum(size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


# ASCII bytes that separate words, and A-Z lower-cased; other bytes unchanged.
_ALNUM = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32
               for c in range(256))
# A-Z lower-cased, nothing else changed.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of anything
    beyond ASCII."""
    return text.encode().translate(_ALNUM).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (bytes.split's white space is
    exactly U+0020 and U+0009 to U+000D)."""
    return text.encode().split() if text else []


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges [start, start + length)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


# White space other than single blanks and line ends between two characters.
_OTHER_SPACE = (r"\A[ \n]|[ \n]\z|[ \n][ \n]|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}"
                r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_ALONE = "\n\n"


class ChunkEncoder:
    """Encodes texts chunk by chunk with a memo of chunks.

    A single blank or line end between two other characters always starts a
    new match of the byte-level BPE pre-tokenizer's pattern, so a text's ids
    are the ids of its chunks in order.  Texts with other white space are cut
    at such blanks only.  ``encode`` maps a list of chunks, and whether each
    must be encoded alone, to (all ids, number of ids of each chunk).  Beyond
    ``max_chunks`` entries or ``max_chars`` characters the memo keeps the half
    of its entries that were used most.  A text that holds one of the strings
    ``whole`` is one chunk that must be encoded alone.

    A chunk's memo key is the chunk without its blank, or with its line end;
    after two line ends it is a chunk that must be encoded alone.
    """

    def __init__(self, encode, max_chunks: int = 300_000, max_chars: int = 16 << 20, whole: Iterable[str] = ()):
        self.encode, self.max_chunks, self.max_chars, self.whole = encode, max_chunks, max_chars, tuple(whole)
        self.pending: list[str] = []
        self.index = _Index(self.pending)
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)
        self.chars = 0

    def _trim(self) -> None:
        keys = list(self.index)
        size = np.fromiter(map(len, keys), np.int64, len(keys))
        by_use = np.argsort(-self.uses, kind="stable")[:self.max_chunks // 2]
        kept = np.sort(by_use[np.cumsum(size[by_use]) <= self.max_chars // 2])
        self.pending = []
        self.index = _Index(self.pending)
        self.index.update((keys[k], i) for i, k in enumerate(kept.tolist()))
        lengths = self.lengths[kept]
        self.ids = self.ids[ranges(self.starts[kept], lengths)]
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths
        self.uses, self.chars = self.uses[kept], int(size[kept].sum())

    @staticmethod
    def _chunk(key: str) -> str:
        return key[2:] if key.startswith(_ALONE) else key if key[:1] == "\n" else " " + key

    def _places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(memo places of all chunks in order, chunks of each text)."""
        texts = texts.cast(pa.large_string())
        present = pc.fill_null(pc.not_equal(texts, ""), False)
        odd = pc.and_(present, pc.fill_null(pc.match_substring_regex(texts, _OTHER_SPACE), False))
        for string in self.whole:
            odd = pc.or_(odd, pc.fill_null(pc.match_substring(texts, string), False))
        plain = pc.and_(present, pc.invert(odd))
        n_keys = np.zeros(len(texts), np.int64)
        start = np.zeros(len(texts), np.int64)
        own = pc.replace_substring(texts.filter(plain), "\n", " \n")
        lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(_ALONE, pa.large_string()), own, pa.scalar("", pa.large_string())), " ")
        coded = lists.flatten().dictionary_encode()
        memo = np.fromiter(map(self.index.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        places = [memo[coded.indices.to_numpy()]]
        rows = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
        n_keys[rows] = pc.list_value_length(lists).to_numpy()
        start[rows] = np.cumsum(n_keys[rows]) - n_keys[rows]
        at = len(places[0])
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            text = texts[i].as_py()
            first, *rest = [text] if any(s in text for s in self.whole) else _SINGLE.split(text)
            keys = [_ALONE + first, *(f"{_ALONE} {p}" for p in rest)]
            places.append(np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys)))
            start[i], n_keys[i] = at, len(keys)
            at += len(keys)
        if len(places) == 1:
            return places[0], n_keys
        return np.concatenate(places)[ranges(start, n_keys)], n_keys

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        at, n_keys = self._places(texts)
        if self.pending:
            chunks = [self._chunk(k) for k in self.pending]
            flat, lengths = self.encode(chunks, [k.startswith(_ALONE) for k in self.pending])
            self.chars += sum(map(len, chunks))
            self.pending.clear()
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, flat.astype(np.uint32)])
        self.uses = np.concatenate([self.uses, np.zeros(len(self.index) - len(self.uses), np.int64)])
        self.uses += np.bincount(at, minlength=len(self.uses))
        length = self.lengths[at]
        ids = self.ids[ranges(self.starts[at], length)]
        ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(n_keys)])]
        if len(self.index) > self.max_chunks or self.chars > self.max_chars:
            self._trim()
        return ids, np.diff(ends)


def joined(encode_all, token_bytes: np.ndarray, group: int = 50):
    """A chunk encoder over ``encode_all`` (list of texts -> list of id lists).

    Chunks that need not be alone are encoded as one text of up to ``group``
    chunks; the ids' byte lengths tell the chunks apart again.  Of a chunk
    encoded alone only the sum counts: its ids may leave out white space."""
    def encode(chunks: list[str], alone: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        texts: list[str] = []
        held: list[str] = []
        singles: list[int] = []
        for chunk, single in zip(chunks, alone):
            if single or len(held) == group:
                if held:
                    texts.append("".join(held))
                held = []
            if single:
                singles.append(len(texts))
                texts.append(chunk)
            else:
                held.append(chunk)
        if held:
            texts.append("".join(held))
        coded = [np.array(x, np.int64) for x in encode_all(texts)]
        ids = np.concatenate([np.zeros(0, np.int64), *coded])
        ends = np.cumsum(np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks)))
        size = token_bytes[ids]
        n = np.fromiter(map(len, coded), np.int64, len(coded))
        last = np.cumsum(n)[singles] - 1
        size[ranges(last + 1 - n[singles], n[singles])] = 0
        size[last] = [len(texts[i].encode()) for i in singles]
        covered = np.cumsum(size)
        last = np.searchsorted(covered, ends)
        if len(ends) and not (covered[last] == ends).all():
            raise ValueError("a token crosses the end of a chunk")
        return ids, np.diff(last + 1, prepend=0)
    return encode


_KEPT: dict[str, object] = {}


def kept_in_worker(name: str, make):
    """``make()``, kept by this Python worker for its later tasks until one
    asks for another: a worker holds one at a time."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def forget_kept() -> None:
    """Drop what ``kept_in_worker`` holds, before work of an operator that
    does not ask for it: a reused worker would keep another one's table."""
    _KEPT.clear()


class _Index(dict):
    """Numbers keys in order of appearance and notes the new ones."""

    def __init__(self, pending: list):
        self.pending = pending

    def __missing__(self, key):
        self[key] = n = len(self)
        self.pending.append(key)
        return n
