"""Label lists that are stored as text: decoding and key forms, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A quoted item of a list in Python notation.
_PYTHON_ITEM = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
#: The characters that count as white space.
WHITE_SPACE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """``text`` without white space at both ends, Unicode spaces included; linear in its length."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def _python_item(item: Column) -> Column:
    """The string that a quoted item of Python notation stands for."""
    body = F.substring(item, F.lit(2), F.length(item) - 2)
    escaped = F.regexp_replace(F.regexp_replace(body, r"\\x([0-9a-fA-F]{2})", r"\\u00$1"), r"\\'", "'")
    quoted = F.concat(F.lit('["'), F.regexp_replace(escaped, r'(?<!\\)"', r'\\"'), F.lit('"]'))
    return F.when(body.contains("\\"), F.coalesce(F.from_json(quoted, "array<string>")[0], body)).otherwise(body)


def decode_labels(value: Column) -> Column:
    """The labels of a serialized list, stripped at both ends, empty ones left out.

    Accepted notations: a JSON array, a JSON object with that array under ``concepts``, a Python list,
    and bare labels joined by ``;``, else by ``|``, else by ``,``. Null, empty text, an empty list and
    an object without the array give an empty array. Text that begins like a list but is none is
    taken as bare labels. Repeated labels stay repeated.
    """
    return bound(strip(F.coalesce(value, F.lit(""))), _decoded)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _decoded(text: Column) -> Column:
    head = F.substring(text, 1, 1)
    array = F.from_json(text, "array<string>")
    held = F.from_json(F.get_json_object(text, "$.concepts"), "array<string>")
    listed = F.transform(F.regexp_extract_all(text, F.lit(_PYTHON_ITEM), F.lit(0)), _python_item)
    bare = (
        F.when(text.contains(";"), F.split(text, ";", -1))
        .when(text.contains("|"), F.split(text, r"\|", -1))
        .otherwise(F.split(text, ",", -1))
    )
    python_list = text.rlike(r"^\[\s*(?:'|\"|\])") & text.rlike(r"\]$")
    items = (
        F.when(head == "[", F.coalesce(array, F.when(python_list, listed), bare))
        .when(head == "{", F.coalesce(held, F.when(text.rlike(r"\}$"), F.array().cast("array<string>")), bare))
        .otherwise(bare)
    )
    return F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != ""))


def letters_digits(text: Column) -> Column:
    """``text`` in lower case with only its letters and digits kept."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")
