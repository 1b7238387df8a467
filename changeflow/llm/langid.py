"""Language identification by cross-parsing (8).

For each language a suffix automaton is built over a bounded sample of its
labelled running text: words lower-cased, one blank between them.  A text is
cross-parsed against an automaton: the longest match from the current place
is one phrase, the next phrase starts where it ended, whether within a word or
beyond it, and a byte that the automaton lacks is a phrase of its own.  A
text's cost in a language is its number of phrases times log2 of the training
text's length, over its number of bytes: the cross entropy estimate of Ziv and
Merhav, in bits a byte.  The cheapest language wins.  Every text is parsed
whole, all texts of a slice side by side (``cross_parse``).

Training: per language at most ``docs_per_lang`` whole rows, those with the
smallest hash of their id and text, as long as their texts have at most
``bytes_per_lang`` together; a text of more than a quarter of that is not
chosen unless there is none else, then the shortest is.  With many languages
each gets its share of ``TOTAL_BYTES``, which bounds a worker's automata
(built once a worker): about 60 bytes a state and two states a byte for Latin
letters.  The language, source and id of a row are no input of its prediction.

Defined cases: a null text or one without a letter is ``und`` with score 0;
so is every text if nothing could be learned; ties go to the first language
by name; null languages teach nothing; repeated rows repeat their results;
an empty table gives an empty result; other columns are kept, those with the
result's names are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.llm.common import SMALL_SLICE, kept_in_worker, scratch, stored, text_slices
from changeflow.llm.cross_parse import Automaton, Lanes

DOCS_PER_LANG = 400
BYTES_PER_LANG = 1 << 16
TOTAL_BYTES = 1 << 19
SPARE = 4
MAX_LANGS = 500           # more distinct values of lang are an error
MOST_BITS = 8.0           # bits a byte beyond which a text is of no learned language
LEAST_BYTES = 20          # of running text from which a text is judged so
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id's text leaves 1 modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def running(text: str | None) -> bytes:
    """The lower-cased words of ``text``, a blank before and after each;
    empty if it has no letter."""
    words = _LETTERS.findall(text.lower()) if text else []
    return f" {' '.join(words)} ".encode() if words else b""


def training_rows(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, bytes_per_lang: int = BYTES_PER_LANG) -> DataFrame:
    """(lang, text): the bounded sample, whole texts.

    Rows are chosen by hash: first by a threshold that leaves about ``SPARE``
    times the wanted number of each language, so that no task orders a whole
    language, then the smallest hashes while their texts fit.  Only the chosen
    rows' texts are fetched."""
    h = F.xxhash64("doc_id", "text")
    taught = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    labelled = stored(taught.select("lang", h.alias("h"), F.octet_length("text").cast("long").alias("size")).distinct(), "labelled")
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("size", "h")).alias("least"))
    n_langs = counts.limit(MAX_LANGS + 1).count()
    if n_langs > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    budget = min(bytes_per_lang, TOTAL_BYTES // max(n_langs, 1))
    by_hash = F.pmod("h", F.lit(1 << 30)) * F.col("n") < SPARE * docs_per_lang * (1 << 30)
    near = labelled.join(F.broadcast(counts), "lang").filter(by_hash | (F.col("h") == F.col("least.h")))     # counts: MAX_LANGS rows
    long = F.col("size") > budget // 4
    order = W.partitionBy("lang").orderBy(long, F.when(long, F.col("size")), "h")
    chosen = (near.withColumns({"k": F.row_number().over(order), "used": F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))})
              .filter((F.col("k") <= docs_per_lang) & ((F.col("used") <= budget) | (F.col("k") == 1))).select("lang", "h"))
    chosen = F.broadcast(stored(chosen, "chosen"))                  # MAX_LANGS * docs_per_lang rows
    return (taught.select("lang", "text", h.alias("h")).join(chosen, ["lang", "h"], "left_semi")
            .groupBy("lang", "h").agg(F.min("text").alias("text")))


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, bytes_per_lang: int = BYTES_PER_LANG) -> dict[str, bytes]:
    """Language -> its running training text, from which each worker builds
    an automaton: about ``TOTAL_BYTES`` of all languages, bounded."""
    with scratch(docs.sparkSession):
        rows = training_rows(docs, docs_per_lang, bytes_per_lang).orderBy("lang", "h").collect()
    samples: dict[str, bytes] = {}
    for r in rows:
        samples[r.lang] = samples.get(r.lang, b"") + running(r.text)
    return {lang: text for lang, text in samples.items() if text}


class Parser:
    """Costs of texts in every language."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        self.automata = [Automaton(samples[lang]) for lang in self.langs]
        self.bits = np.array([math.log2(max(2, len(samples[lang]))) for lang in self.langs])

    def costs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(bits a byte per text and language, bytes of running text)."""
        data = [running(t) for t in texts]
        lanes = Lanes(data)
        n = np.fromiter(map(len, data), np.int64, len(data))
        counts = np.stack([a.phrases(lanes) for a in self.automata], 1)
        return counts * self.bits / np.maximum(n, 1)[:, None], n


def predict(docs: DataFrame, samples: dict[str, str], fits: str | None = None) -> DataFrame:
    """``docs`` with lang_pred and score: 0 where the two cheapest languages
    cost the same, near 1 where the second costs far more.  ``fits`` names a
    further column: whether the text has letters and, from ``LEAST_BYTES`` on,
    costs at most ``MOST_BITS`` a byte in the cheapest language; without
    a learned language, whether it has letters."""
    added = ["lang_pred", "score", *([fits] if fits else [])]
    kept = docs.drop(*added)
    names = [*kept.columns, *added]
    shared = docs.sparkSession.sparkContext.broadcast(samples)    # bounded by fit()
    name = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()

    def run(batches):
        parser = kept_in_worker(f"automata {name}", lambda: Parser(shared.value))
        for batch in text_slices(batches, max_bytes=SMALL_SLICE):
            texts = batch.column("text").to_pylist()
            if parser.langs:
                cost, n = parser.costs(texts)
                order = np.argsort(cost, axis=1, kind="stable")
                best = np.take_along_axis(cost, order[:, :1], 1)[:, 0]
                second = (np.take_along_axis(cost, order[:, 1:2], 1)[:, 0] if len(parser.langs) > 1
                          else np.full(len(texts), np.inf))
                langs = [parser.langs[i] if k else UNDETERMINED for i, k in zip(order[:, 0], n)]
                with np.errstate(invalid="ignore", divide="ignore"):
                    score = np.where(n > 0, 1 - best / second, 0.0)
                score = np.clip(np.nan_to_num(score), 0, 1)
                fit_well = (n > 0) & ((n < LEAST_BYTES) | (best <= MOST_BITS))
            else:
                langs, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                fit_well = [bool(t and _LETTERS.search(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()),
                                              *([pa.array(fit_well, pa.bool_())] if fits else [])], names=names)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()),
                                              T.StructField("score", T.DoubleType()),
                                              *([T.StructField(fits, T.BooleanType())] if fits else [])]))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that may be of a learned language, columns unchanged:
    those without a letter go, and those that cost more than ``MOST_BITS`` a
    byte in every language.  Texts of fewer than ``LEAST_BYTES`` are too
    short to tell; if nothing could be learned, all with letters stay."""
    return predict(docs, fit(docs), "__fits").filter("__fits").select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return predict(docs.select("doc_id", "text"), fit(docs)).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
