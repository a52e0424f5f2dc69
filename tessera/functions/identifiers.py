"""Identifier and code expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the lexeme of a native code.
NATIVE_CODE = r"^(?:V\d{2,4}(?:\.\d{1,2})?|E\d{3,4}(?:\.\d{1,2})?|\d{3,5}(?:\.\d{1,2})?)$"
# Fixed value: what counts as white space at the ends of a text.
_EDGE_SPACE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_ID_TYPES = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def stripped(column: Column) -> Column:
    """Without white space at either end, as Unicode has it."""
    return F.btrim(column.cast("string"), F.lit(_EDGE_SPACE))


def is_native_code(column: Column) -> Column:
    return F.coalesce(F.regexp_like(column, F.lit(NATIVE_CODE)) & ~F.endswith(column, F.lit("\n")), F.lit(False))


def parse_native_icd9(raw: str) -> str:
    """raw without surrounding white space, if that is a native code."""
    code = raw.strip()
    if not re.fullmatch(NATIVE_CODE, code, re.ASCII):
        raise ValueError(f"invalid native ICD-9 code: {code!r}")
    return code


def native_code(column: Column) -> Column:
    """parse_native_icd9 for a column; null where that would raise."""
    code = stripped(column)
    return F.when(is_native_code(code), code)


def require_id_type(df: DataFrame, name: str) -> None:
    """Identifiers are strings or whole numbers; a column has one type, so the schema tells."""
    kind = df.schema[name].dataType
    whole = isinstance(kind, T.DecimalType) and kind.scale == 0
    if not (isinstance(kind, _ID_TYPES) or whole):
        raise ValueError(f"{name}: identifiers must be str or int, not {kind.simpleString()}")


def is_canonical(column: Column) -> Column:
    """Not null, not empty, no surrounding white space."""
    text = column.cast("string")
    return F.coalesce((F.length(text) > 0) & (stripped(text) == text), F.lit(False))
