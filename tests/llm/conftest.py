import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SF = "/root/testdata/sf0.001"


def prose(rng, n, vocabulary=400):
    """n invented words with some punctuation."""
    return " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randrange(vocabulary)) + rng.choice(["", "", "", ",", "."])
                    for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text) with nulls, empty and odd texts, copies, near copies,
    shared passages, a long text and repeated rows."""
    rng = random.Random(5)
    passage = prose(rng, 60)
    base = prose(rng, 150)
    near = base.split(" ")
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "Two words"), (6, "word"), (7, "  x　y \u0085 z"),
           (8, "tab\tnew\r\nline  double \x1c sep \x0b end "), (9, "naïve 日本語 \U0001F600 İstanbul Kelvin MIT LICENSE"),
           (10, "12345 !!! ..."), (11, base), (12, base), (12, base), (None, base), (13, " ".join(near[:70] + ["changed"] + near[71:])),
           (14, " ".join(near[:20] + ["other"] + near[21:])), (15, passage + " " + prose(rng, 30)), (16, prose(rng, 25) + " " + passage),
           (17, prose(rng, 10) + "\n" + passage + "\n" + prose(rng, 300)), (18, "a " * 90 + "b"), (19, "a " * 50),
           (20, "mit license mit license cc by cc by gnu general public license"), (21, prose(rng, 6000, 50_000)),
           (22, "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: GPL-3.0-or-later"), (23, "x" * 5000),
           (24, "it's we'll\n\n\n  they've 've'll  "), (4, "word again")]
    out += [(100 + i, " ".join(near[:5 + i] + [f"edit{i}"] + near[6 + i:])) for i in range(30)]
    return out


@pytest.fixture(scope="session")
def items(rows):
    """(item_id, text) of a benchmark, partly in the texts of ``rows``."""
    passage = rows[15][1].split(" ")
    return [(1, " ".join(passage[3:30])), (2, "Two, WORDS!"), (3, None), (4, ""), (5, "..."), (6, "nothing of this is in any text at all here"),
            (7, " ".join(passage[3:30])), (10, " ".join(passage[40:58]).upper()), (None, "word again")]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """``rows`` with further columns, some with names that results have."""
    full = [(d, t, "xx", f"s{i % 3}", None if t is None else len(t), "mine", 7) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, labels string, n_words long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    """The documents of the smallest scale, as (frame, rows)."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [(r.doc_id, r.text) for r in df.collect()]
