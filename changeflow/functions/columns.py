"""Column builders used by mappings, change feeds and checks.

All functions return ``pyspark.sql.Column`` objects built from JVM-side
functions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def qualified(name: str) -> Column:
    """Column for a possibly dotted name (``alias.col``) or a plain name."""
    return F.col(name)


def as_text(c: ColumnOrName) -> Column:
    return _col(c).cast("string")


# ---------------------------------------------------------------- P3 / P4 / P5

def json_object(cols: Sequence[ColumnOrName], names: Sequence[str] | None = None) -> Column:
    """JSON object text from columns; null members are written as null."""
    names = list(names) if names is not None else [c if isinstance(c, str) else None for c in cols]
    fields = []
    for c, n in zip(cols, names):
        if n is None:
            raise ValueError("json_object needs a name for every Column expression")
        fields.append(_col(c).alias(n.split(".")[-1]))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def json_array(cols: Sequence[ColumnOrName]) -> Column:
    """JSON array text from columns (values coerced to a common type)."""
    return F.to_json(F.array(*[_col(c) for c in cols]))


def concat_keep_nulls(cols: Sequence[ColumnOrName], separator: str = ", ") -> Column:
    """P5: join parts with ``separator``; a null part becomes empty text and
    its separator is kept (unlike ``concat_ws``, which skips it, and unlike
    ``concat``, which turns the whole result null)."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(separator))
        parts.append(F.coalesce(as_text(c), F.lit("")))
    return F.concat(*parts)


_PLACEHOLDER = re.compile(r"\{col(\d+)\}")


def fill_template(template: str, sources: Sequence[str]) -> str:
    """Replace ``{col1}``, ``{col2}`` ... by the source column names."""
    def repl(m: re.Match) -> str:
        i = int(m.group(1))
        if not 1 <= i <= len(sources):
            raise ValueError(f"placeholder {{col{i}}} has no source column")
        return "`" + sources[i - 1].replace("`", "``") + "`"
    return _PLACEHOLDER.sub(repl, template)


# ---------------------------------------------------------------- P15 / P17

# Change-capture operation codes and their meaning.
OP_DELETE = 1
OP_INSERT = 2
OP_UPDATE_BEFORE = 3
OP_UPDATE_AFTER = 4


def decode_operation(op: ColumnOrName) -> Column:
    """1 -> DELETE, 2 -> INSERT, 3 and 4 -> UPDATE, anything else -> INSERT."""
    op = _col(op)
    return (F.when(op == OP_DELETE, F.lit("DELETE"))
             .when(op.isin(OP_UPDATE_BEFORE, OP_UPDATE_AFTER), F.lit("UPDATE"))
             .otherwise(F.lit("INSERT")))


def record_id(keys: Sequence[ColumnOrName]) -> Column:
    """Key values as text joined by ``|`` (a null part is empty text)."""
    return F.concat_ws("|", *[F.coalesce(as_text(k), F.lit("")) for k in keys])


# ---------------------------------------------------------------- Q8 / Q9 / Q11

def normalize_case(c: ColumnOrName) -> Column:
    return F.lower(_col(c))


def normalize_whitespace(c: ColumnOrName, trim: bool = True, collapse: bool = True) -> Column:
    out = _col(c)
    if trim:
        # strip every whitespace character at both ends, not only spaces
        out = F.regexp_replace(out, r"^\s+|\s+$", "")
    if collapse:
        out = F.regexp_replace(out, r"\s+", " ")
    return out


def null_safe_differs(a: ColumnOrName, b: ColumnOrName) -> Column:
    return ~_col(a).eqNullSafe(_col(b))


def any_changed(pairs: Iterable[tuple[ColumnOrName, ColumnOrName]]) -> Column:
    """true when any (old, new) pair differs, nulls compared as values."""
    cond = None
    for a, b in pairs:
        d = null_safe_differs(a, b)
        cond = d if cond is None else (cond | d)
    if cond is None:
        raise ValueError("on-change detector needs at least one field")
    return cond


def present(items: Sequence[tuple[Column, Column]], element_type: str | None = None) -> Column:
    """Array of the values whose condition holds, in order.

    Built with ``concat`` of one- or zero-element arrays rather than a
    ``filter`` lambda, so the whole expression stays in generated code."""
    parts = []
    for cond, value in items:
        empty = F.array().cast(f"array<{element_type}>") if element_type else F.array()
        parts.append(F.when(cond, F.array(value)).otherwise(empty))
    if not parts:
        return F.array().cast(f"array<{element_type or 'string'}>")
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def epoch_micros(c: ColumnOrName, dtype=None) -> Column:
    """Microseconds since 1970-01-01 of a timestamp.

    A ``TIMESTAMP_NTZ`` is converted field by field (date, hour, minute,
    second), so the result does not depend on the session time zone and stays
    monotonic where a zone repeats or skips an hour; a zoned timestamp uses
    ``unix_micros``."""
    from pyspark.sql.types import TimestampNTZType
    c = _col(c)
    if isinstance(dtype, TimestampNTZType):
        return (F.unix_date(F.to_date(c)).cast("long") * F.lit(86_400_000_000)
                + F.hour(c).cast("long") * F.lit(3_600_000_000)
                + F.minute(c).cast("long") * F.lit(60_000_000)
                + (F.date_part(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("long"))
    return F.unix_micros(c.cast("timestamp"))
