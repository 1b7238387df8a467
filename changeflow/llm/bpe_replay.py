"""Byte-level BPE encoding and decoding by merge replay (5).

The texts that a task holds at once are cut into chunks and, by the
pre-tokenizer's pattern, into matches; each distinct match becomes one word of
a small corpus of byte tokens.  An inverted index maps the mergeable pairs, in
bands of ranks, to their positions in the words; the bands are replayed in
order.  Words never interact, so within a band every word's lowest pair is
merged at once, at all its places; a merge touches only its position and the
two neighbouring pairs, which are looked up and entered anew.  For the same
reason replaying the words of one slice of the corpus gives the ids that
replaying them all together would; no word has to move to another machine and
nothing grows with the corpus.  Matches seen before are taken from a bounded
memo.

Pairs are indexed by the rank of their joined bytes, the rule of rank files.
Where a merge would make a pair of lower rank than its own, the other places
of its word wait, which is the order in which a single word is encoded.

Defined cases: a null or empty text gives an empty id array and decodes to
empty bytes; a null id array decodes to empty bytes, an id outside the
vocabulary is an error; repeated rows repeat their results; an empty table
gives an empty result; other columns are kept, those with the result's names
are replaced.
"""

from __future__ import annotations

import base64
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.llm.common import SMALL_SLICE, ChunkEncoder, _Index, kept_in_worker, ranges, text_slices


BLOCK_WORDS = 200_000     # distinct words replayed together: bounds the linked lists
BANDS = 64                # parts of the inverted index, by rank
NO_RANK = np.iinfo(np.int32).max


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id; an empty entry where none has the id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.diff(values, prepend=-1) != 0]


class PairRanks:
    """The rank of every pair of tokens whose joined bytes are a token: a hash
    table with linear probing, looked up for many pairs at once."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int32)
        self.probes = 1
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] < 0
            at_free, first = np.unique(at[free], return_index=True)
            own = np.flatnonzero(free)[first]
            self.keys[at_free], self.ranks[at_free] = keys[own], ranks[own]
            left = np.ones(len(keys), bool)
            left[own] = False
            keys, ranks, at = keys[left], ranks[left], (at[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NO_RANK`` where it has none."""
        at = self._place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.ranks[at], NO_RANK)
        left = np.flatnonzero((held != keys) & (held >= 0))
        for _ in range(self.probes):
            if not len(left):
                break
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


class MergeReplay:
    """Encodes many words at once by replaying merges over all of them."""

    def __init__(self, tokens: list[bytes]):
        ids = {t: i for i, t in enumerate(tokens) if t}
        self.n = len(tokens)
        missing = [b for b in range(256) if bytes([b]) not in ids]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.byte = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        # every pair of tokens whose joined bytes are a token
        pairs = np.array([(ids[t[:k]], ids[t[k:]], i) for t, i in ids.items() for k in range(1, len(t))
                          if t[:k] in ids and t[k:] in ids], np.int64).reshape(-1, 3)
        self.rank = PairRanks(pairs[:, 0] * self.n + pairs[:, 1], pairs[:, 2].astype(np.int32))
        self.band = np.minimum(np.arange(self.n + 1).astype(np.float64) / max(self.n, 1), 1)
        self.band = (np.sqrt(self.band) * (BANDS - 1)).astype(np.uint8)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each);
        words are not empty."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        total = int(ends[-1])
        symbol = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        # linked symbols: the next and the previous one of the same word, -1 for none
        after = np.arange(1, total + 1)
        after[ends - 1] = -1
        before = np.arange(-1, total - 1)
        before[ends - sizes] = -1
        rank = np.full(total, NO_RANK, np.int32)      # of the pair that starts here
        index: list[list[np.ndarray]] = [[] for _ in range(BANDS)]

        def note(places: np.ndarray) -> int:
            """Look up the pairs that start at ``places`` and enter them; the
            lowest band entered."""
            follows = after[places]
            rank[places] = NO_RANK
            places, follows = places[follows >= 0], follows[follows >= 0]
            found = self.rank(symbol[places] * self.n + symbol[follows])
            held = found != NO_RANK
            places, found = places[held], found[held]
            rank[places] = found
            band = self.band[found]
            order = np.argsort(band, kind="stable")
            cuts = np.flatnonzero(np.diff(band[order])) + 1
            for own in np.split(places[order], cuts) if len(places) else ():
                index[self.band[rank[own[0]]]].append(own)
            return int(band.min()) if len(places) else BANDS

        def early(places: np.ndarray) -> np.ndarray:
            """Whether a merge at each place would make a pair that comes
            before its own."""
            made, left, right = rank[places], before[places], after[after[places]]
            out = self.rank(made * np.int64(self.n) + made) < made
            for side, keys in ((left, symbol[left] * self.n + made), (right, made * np.int64(self.n) + symbol[right])):
                out |= (side >= 0) & (self.rank(np.where(side >= 0, keys, 0)) < made)
            return out

        note(np.arange(total))
        at = 0
        while at < BANDS:
            if not index[at]:
                at += 1
                continue
            places = np.concatenate(index[at])
            index[at] = []
            own = rank[places]
            live = own != NO_RANK
            live[live] = self.band[own[live]] == at     # else merged away since it was noted
            places = _distinct(places[live])
            if not len(places):
                continue
            # each word's pair of lowest rank, at all its places
            own = rank[places]
            first = np.flatnonzero(np.diff(word[places], prepend=-1))
            lowest = own == np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(places))))
            index[at].append(places[~lowest])
            places = places[lowest]
            # from the left, each that does not overlap the one taken before
            overlaps = np.append(False, after[places[:-1]] == places[1:])
            start = np.maximum.accumulate(np.where(overlaps, 0, np.arange(len(places))))
            taken = (np.arange(len(places)) - start) % 2 == 0
            several = np.flatnonzero(word[places[1:]] == word[places[:-1]])
            if len(several):      # the leftmost alone, where its merge may make a pair that comes first
                many = np.isin(word[places], word[places[several]])
                alone = np.isin(word[places], word[places[many][early(places[many])]])
                taken &= ~alone | (np.diff(word[places], prepend=-1) != 0)
                index[at].append(places[alone & ~taken])
            places = places[taken]
            second = after[places]
            symbol[places] = rank[places]
            symbol[second], rank[second] = -1, NO_RANK
            follows = after[second]
            after[places] = follows
            inner = follows >= 0
            before[follows[inner]] = places[inner]
            ahead = before[places]
            at = min(at, note(_distinct(np.concatenate([places, ahead[ahead >= 0]]))))
        alive = symbol >= 0
        return symbol[alive], np.add.reduceat(alive, ends - sizes, dtype=np.int64)


class ReplayEncoder:
    """Chunks -> ids: distinct matches of the pattern are replayed together."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.replay, self.pattern = MergeReplay(tokens), regex.compile(pattern)

    def __call__(self, chunks: list[str], alone: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        words = list(map(self.pattern.findall, chunks))
        n_words = np.fromiter(map(len, words), np.int64, len(words))
        new: list[str] = []
        number = _Index(new)
        at = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(n_words.sum()))
        data = [w.encode() for w in new]
        blocks = [self.replay(data[i:i + BLOCK_WORDS]) for i in range(0, len(data), BLOCK_WORDS)] or [self.replay([])]
        flat, lengths = (np.concatenate([x[k] for x in blocks]) for k in (0, 1))
        starts = np.cumsum(lengths) - lengths
        ids = flat[ranges(starts[at], lengths[at])]
        sums = np.concatenate([[0], np.cumsum(lengths[at])])
        return ids, np.diff(sums[np.concatenate([[0], np.cumsum(n_words)])])


def _encode(batches, ranks_path: str, pattern: str, names: list[str]):
    encoder = kept_in_worker(f"replay {ranks_path} {pattern}",
                             lambda: ChunkEncoder(ReplayEncoder(read_ranks(ranks_path), pattern), 200_000, 8 << 20))
    for batch in text_slices(batches, max_bytes=SMALL_SLICE):
        ids, lengths = encoder(batch.column("text"))
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names)


def _decode(batches, ranks_path: str, ids: str, names: list[str]):
    tokens = read_ranks(ranks_path)
    size = np.array([len(t) for t in tokens], np.int64)
    start = np.cumsum(size) - size
    table = np.frombuffer(b"".join(tokens), np.uint8)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            own = part.column(ids)
            flat = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(size) or not size[flat].all()):
                raise ValueError("an id is not in the vocabulary")
            counts = pc.fill_null(own.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            data = table[ranges(start[flat], size[flat])]
            ends = np.concatenate([[0], np.cumsum(size[flat])])[np.concatenate([[0], np.cumsum(counts)])]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.Array.from_buffers(
                pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])], names)


def encode(docs: DataFrame, ranks_path: str, pattern: str, result: str = "ids") -> DataFrame:
    """``docs`` and an array<int> column of the ids of each whole text."""
    kept = docs.drop(result)
    names = [*kept.columns, result]
    return kept.mapInArrow(lambda batches: _encode(batches, ranks_path, pattern, names),
                           T.StructType([*kept.schema.fields, T.StructField(result, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", result: str = "decoded") -> DataFrame:
    """``encoded`` and a binary column of the bytes of each id array."""
    kept = encoded.drop(result)
    names = [*kept.columns, result]
    return kept.mapInArrow(lambda batches: _decode(batches, ranks_path, ids, names),
                           T.StructType([*kept.schema.fields, T.StructField(result, T.BinaryType())]))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``encode`` and then ``decode`` in one pass of one Python worker: the
    columns of ``docs``, ids, and decoded."""
    kept = docs.drop("ids", "decoded")
    coded = [*kept.columns, "ids"]
    return kept.mapInArrow(lambda batches: _decode(_encode(batches, ranks_path, pattern, coded), ranks_path, "ids", [*coded, "decoded"]),
                           T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                                         T.StructField("decoded", T.BinaryType())]))


def digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The registered query's columns: ids digested, decoded again, digested."""
    return round_trip(docs.select("doc_id", "text"), ranks_path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
