"""Token counts attributed to sections by offsets (9).

Whole documents are encoded once.  The ids' byte lengths give the span of
every token in the UTF-8 text; the spans are interval-joined to the
document's sections, two sorted lists of bounds of one document, and tokens
are counted per section.  A section is a maximal run up to and including a
match of ``separator`` (by default a line with its line end), so sections
tile the text.

A token that crosses section bounds belongs, by ``rule``, to the section of
its ``first`` byte, of its ``last`` byte, or to all of them in proportion to
their bytes (``split``).  Under each rule a document's counts sum to its
number of tokens.

Several text columns count as one document's fields: their texts are encoded
as one, joined by ``joiner``, and each field's sections are reported under
its name.

Defined cases: a null or empty text has no section and yields no row; a text
without a separator is one section; repeated rows yield their rows again;
an empty table yields none; other columns are ignored, and the key columns
named by ``keys`` are carried as they stand.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.llm.common import ChunkEncoder, joined, kept_in_worker, text_slices

RULES = ("first", "last", "split")
_ADDED = [("field", pa.string()), ("section", pa.int32()), ("char_start", pa.int64()),
          ("char_end", pa.int64()), ("n_tokens", pa.float64())]
_ADDED_SPARK = [T.StructField("field", T.StringType()), T.StructField("section", T.IntegerType()),
                T.StructField("char_start", T.LongType()), T.StructField("char_end", T.LongType()),
                T.StructField("n_tokens", T.DoubleType())]


def rank_encoder(ranks_path: str, pattern: str):
    """(chunk encoder, byte length of each id) of a rank file."""
    import base64

    import tiktoken
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return ChunkEncoder(joined(lambda texts: [coding.encode_ordinary(t) for t in texts], lengths)), lengths


def section_bounds(data: bytes, separator: re.Pattern) -> np.ndarray:
    """Byte bounds 0 = b0 < b1 < ... < bk = len(data) of the sections."""
    ends = [m.end() for m in separator.finditer(data) if m.end() > 0]
    if not ends or ends[-1] < len(data):
        ends.append(len(data))
    return np.unique(np.array([0, *ends]))


def share(token_starts: np.ndarray, token_ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section [bounds[i], bounds[i + 1]) under ``rule``; all
    three arrays ascend, and tokens and sections tile the same bytes."""
    if rule == "first":
        return np.diff(np.searchsorted(token_starts, bounds, "left")).astype(float)
    if rule == "last":
        return np.diff(np.searchsorted(token_ends, bounds, "right")).astype(float)
    # tokens before a bound, counting of a crossed token the part before it
    whole = np.searchsorted(token_ends, bounds, "right")
    crossed = np.minimum(whole, len(token_starts) - 1)
    part = np.clip((bounds - token_starts[crossed]) / (token_ends[crossed] - token_starts[crossed]), 0, 1)
    return np.diff(whole + np.where(whole < len(token_starts), part, 0))


def attribute(docs: DataFrame, ranks_path: str, pattern: str, fields: tuple[str, ...] = ("text",),
              keys: tuple[str, ...] = ("doc_id",), separator: str = r"\n", rule: str = "first",
              joiner: str = "\n") -> DataFrame:
    """One row per section: the keys, field, section (from 0 in its field),
    char_start and char_end in the field's text, n_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if set(keys) & {n for n, _ in _ADDED}:
        raise ValueError("a key has the name of a result column")
    cut = re.compile(separator.encode())
    source = docs.select(*keys, *(F.col(f).cast("string").alias(f"text_{i}") for i, f in enumerate(fields)))
    columns = tuple(f"text_{i}" for i in range(len(fields)))

    def count(batches):
        encoder, token_bytes = kept_in_worker(f"ranks {ranks_path} {pattern}", lambda: rank_encoder(ranks_path, pattern))
        for batch in text_slices(batches, columns):
            parts = [batch.column(c).to_pylist() for c in columns]
            texts, rows = [], []            # joined texts; per document its (field, bytes, start)
            for values in zip(*parts):
                at, own = 0, []
                present = [(f, v.encode()) for f, v in zip(fields, values) if v]
                for f, v in present:
                    own.append((f, v, at))
                    at += len(v) + len(joiner.encode())
                texts.append(joiner.join(v.decode() for _, v in present))
                rows.append(own)
            ids, lengths = encoder(pa.array(texts, pa.string()))
            ends = np.cumsum(token_bytes[ids])
            starts = ends - token_bytes[ids]
            last = np.cumsum(lengths)
            out: dict[str, list] = {n: [] for n, _ in _ADDED}
            of: list[np.ndarray] = []
            names: list[str] = []
            base = 0
            for i, own in enumerate(rows):
                a, b = int(last[i] - lengths[i]), int(last[i])
                ts, te = starts[a:b] - base, ends[a:b] - base
                for f, (name, data, at) in enumerate(own):
                    bounds = section_bounds(data, cut)
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])[bounds]
                    span = bounds + at
                    if f + 1 < len(own):    # the joiner counts to the section before it
                        span = span.copy()
                        span[-1] = own[f + 1][2]
                    of.append(np.full(len(bounds) - 1, i))
                    names += [name] * (len(bounds) - 1)
                    out["section"].append(np.arange(len(bounds) - 1, dtype=np.int32))
                    out["char_start"].append(chars[:-1])
                    out["char_end"].append(chars[1:])
                    out["n_tokens"].append(share(ts, te, span, rule))
                if own:
                    base += own[-1][2] + len(own[-1][1])
            if not of:
                continue
            which = pa.array(np.concatenate(of))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(which) for k in keys), pa.array(names, pa.string()),
                 *(pa.array(np.concatenate(out[n]), t) for n, t in _ADDED[1:])],
                names=[*keys, *(n for n, _ in _ADDED)])
    return source.mapInArrow(count, T.StructType([source.schema[k] for k in keys] + _ADDED_SPARK))
