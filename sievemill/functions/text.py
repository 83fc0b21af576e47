"""Text: the two normalisers, stems, canonical JSON text, literals, and distances.

The curation side keeps case and punctuation (``collapsed``); the evaluation side compares compatibility forms without
white space (``compact``). They are never mixed. Spark has no Unicode normalisation, so texts beyond ASCII go through an
Arrow UDF; ASCII texts, on which both forms are the identity, stay in the JVM.
"""

from __future__ import annotations

import ast
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: File name endings of images, and labels that mark a line as not to be judged (fixed values).
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "webp", "tif", "tiff")
DONT_CARE = ("###", "*")


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKC", t).split()))


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


#: What Python's split() takes as white space within ASCII.
_ASCII_SPACE = r"[\t-\r\x1c-\x1f ]+"


def collapsed(text: Column) -> Column:
    """NFC, runs of Unicode white space as one space, trimmed. Null stays null."""
    return F.when(_ascii(text), F.trim(F.regexp_replace(text, _ASCII_SPACE, " "))).otherwise(_nfc(text))


@F.pandas_udf(ArrayType(StringType()))
def _nfc_list(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: None if x is None else [None if t is None else " ".join(unicodedata.normalize("NFC", t).split()) for t in x])


def collapsed_list(texts: Column) -> Column:
    """``collapsed`` of each text of an array: lambdas can't call an Arrow UDF, so the whole array goes through one where any text is beyond ASCII."""
    plain = F.forall(texts, lambda t: t.isNull() | _ascii(t))
    return F.when(plain, F.transform(texts, lambda t: F.trim(F.regexp_replace(t, _ASCII_SPACE, " ")))).otherwise(_nfc_list(texts))


def compact(text: Column, ignore_case: bool = False) -> Column:
    """NFKC without any white space, lower-cased on demand. Null stays null."""
    out = F.when(_ascii(text), F.regexp_replace(text, _ASCII_SPACE, "")).otherwise(_nfkc(text))
    return F.lower(out) if ignore_case else out


def file_name(path: Column) -> Column:
    """What follows the last slash, backslashes counting as slashes."""
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def stem(path: Column) -> Column:
    """The file name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]*$", "")


def image_stem(path: Column, strip: tuple[str, ...] = ()) -> Column:
    """The file name without a known image extension, so that dotted stems survive; then without the longest ending of ``strip`` that leaves something."""
    name = F.regexp_replace(file_name(path), rf"(?i)\.({'|'.join(IMAGE_SUFFIXES)})$", "")
    out = name
    for ending in sorted(strip, key=len):  # the longest comes to stand first
        out = F.when(F.endswith(name, F.lit(ending)) & (F.length(name) > len(ending)), F.substring(name, 1, F.length(name) - len(ending))).otherwise(out)
    return out


def json_string(text: Column) -> Column:
    """A text as a JSON string with characters beyond ASCII as they are. Null gives null."""
    raw = F.to_json(F.struct(text.alias("v")))
    return F.substring(raw, F.lit(6), F.length(raw) - 6)


def json_list(*texts: Column) -> Column:
    """Texts as a JSON list with ", " between them."""
    return F.concat(F.lit("["), F.concat_ws(", ", *[json_string(t) for t in texts]), F.lit("]"))


@F.pandas_udf(StringType())
def literal_json(texts: pd.Series) -> pd.Series:
    """A JSON document or, failing that, a Python literal, as canonical JSON with sorted keys; null for neither."""

    def read(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            value = json.loads(text)
        except ValueError:
            try:
                value = ast.literal_eval(text)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                return None
        try:
            return json.dumps(value, ensure_ascii=False, sort_keys=True, allow_nan=False)
        except (TypeError, ValueError):
            return None

    return texts.map(read)


def edit_distance(a: Column, b: Column) -> Column:
    """Unit costs over code points; null counts as the empty text."""
    return F.levenshtein(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def blank(text: Column) -> Column:
    """Whether a text is null or has nothing but white space."""
    return text.isNull() | (F.length(F.regexp_replace(text, r"(?U)\s+", "")) == 0)


def split_limited(text: Column, separator: str, fields: int) -> Column:
    """At most ``fields`` parts; the last keeps further separators."""
    return F.split(text, separator, fields)


def html_escaped(text: Column) -> Column:
    """Text for HTML, quotes included (F7). The ampersand goes first."""
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out
