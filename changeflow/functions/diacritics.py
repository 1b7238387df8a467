"""Q7 diacritic folding without a Python UDF.

The folding table is *derived by rule* from the Unicode database at import
time: for every Basic Multilingual Plane character whose canonical
decomposition minus non-spacing marks (category ``Mn``) is a single different
character, map it to that character; every ``Mn`` character is removed.  The
result feeds Spark's ``translate`` (characters without a counterpart are
deleted), so the whole normalisation runs JVM-side in codegen.

Characters whose decomposition yields more than one base character (Hangul
syllables, a few ligature-like letters) are left as they are; ``exact=True``
selects an Arrow-batched pandas UDF that applies full NFD instead.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@functools.lru_cache(maxsize=1)
def folding_table() -> tuple[str, str]:
    """Return (matching, replacement) strings for ``translate``."""
    src: list[str] = []
    dst: list[str] = []
    removed: list[str] = []
    for cp in range(0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        if unicodedata.category(ch) == "Mn":
            removed.append(ch)
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch)
                       if unicodedata.category(c) != "Mn")
        if base != ch and len(base) == 1:
            src.append(ch)
            dst.append(base)
    # translate(): characters past the end of the replacement are deleted
    return "".join(src) + "".join(removed), "".join(dst)


def strip_diacritics(c: Column | str, replacements: Mapping[str, str] | None = None,
                     exact: bool = False) -> Column:
    """Apply custom literal replacements in order, then fold diacritics."""
    out = F.col(c) if isinstance(c, str) else c
    for old, new in (replacements or {}).items():
        out = F.replace(out, F.lit(old), F.lit(new))
    if exact:
        return _nfd_strip_udf(out)
    matching, replace = folding_table()
    return F.translate(out, matching, replace)


def _nfd_strip(s):
    def one(v):
        if v is None:
            return None
        return "".join(ch for ch in unicodedata.normalize("NFD", v)
                       if unicodedata.category(ch) != "Mn")
    return s.map(one)


_nfd_strip_udf = F.pandas_udf(_nfd_strip, StringType())
