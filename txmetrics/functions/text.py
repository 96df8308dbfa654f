"""Text expressions. All of them stay in the JVM except Unicode normalisation."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 29 code points that count as whitespace.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Cell texts that a CSV scan reads as missing.
NULL_TOKENS = (
    "", "NA", "N/A", "n/a", "nan", "NaN", "-nan", "-NaN", "null", "NULL", "None", "<NA>",
    "#N/A", "#NA", "#N/A N/A", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
)

UNICODE_FORMS = ("NFC", "NFD", "NFKC", "NFKD")

# Image extensions and their MIME types.
MIME_TYPES = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".gif": "image/gif",
    ".webp": "image/webp",
    ".heic": "image/heic",
    ".heif": "image/heif",
    ".bmp": "image/bmp",
    ".ico": "image/vnd.microsoft.icon",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".pdf": "application/pdf",
}

# Image formats that a kind of service takes without conversion.
NATIVE_SUFFIXES = {
    "vision": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".ico", ".tif", ".tiff", ".pdf"),
    "language": (".jpg", ".jpeg", ".png", ".gif", ".webp", ".heic", ".heif"),
}

TSHEG, SHAD, ZERO_WIDTH_SPACE = "\u0f0b", "\u0f0d", "\u200b"


def strip(text: Column) -> Column:
    """Drop leading and trailing Unicode whitespace (``trim`` alone drops only spaces)."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))


def collapse_whitespace(text: Column) -> Column:
    """Strip, and turn every inner run of whitespace into one space."""
    others = WHITESPACE_CHARS.replace(" ", "")
    spaces = F.translate(text, others, " " * len(others))
    return F.btrim(F.regexp_replace(spaces, "  +", " "))


def is_blank(value: Column) -> Column:
    """True for null, empty and whitespace-only values."""
    return F.coalesce(strip(value.cast("string")) == "", F.lit(True))


def null_tokens(value: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """Null for cells that spell a missing value; compared before any stripping."""
    return F.when(~value.isin(*tokens), value)


@F.arrow_udf(T.StringType())
def _normalise_nfc(texts: pa.Array) -> pa.Array:
    return _normalised(texts, "NFC")


@F.arrow_udf(T.StringType())
def _normalise_nfd(texts: pa.Array) -> pa.Array:
    return _normalised(texts, "NFD")


@F.arrow_udf(T.StringType())
def _normalise_nfkc(texts: pa.Array) -> pa.Array:
    return _normalised(texts, "NFKC")


@F.arrow_udf(T.StringType())
def _normalise_nfkd(texts: pa.Array) -> pa.Array:
    return _normalised(texts, "NFKD")


def _normalised(texts: pa.Array, form: str) -> pa.Array:
    return pa.array(
        [None if t is None else unicodedata.normalize(form, t) for t in texts.to_pylist()],
        pa.string(),
    )


_NORMALISERS = dict(zip(UNICODE_FORMS, (_normalise_nfc, _normalise_nfd, _normalise_nfkc, _normalise_nfkd)))


def unicode_normalise(text: Column, form: str | None) -> Column:
    """Apply a Unicode normalisation form.

    ASCII text is the same in every form, so only rows with longer code points are sent to
    the Python worker; the others pass through as they are.
    """
    if form is None:
        return text
    if form not in _NORMALISERS:
        raise ValueError(f"unknown Unicode form {form!r}, expected one of {UNICODE_FORMS}")
    wide = F.when(F.length(text) != F.octet_length(text), text)
    return F.coalesce(_NORMALISERS[form](wide), text)


def clean_script(text: Column) -> Column:
    """Opt-in clean-up for Tibetan script.

    Removes zero-width spaces, collapses repeated syllable marks and drops the mark before a
    clause end. It changes what an error rate measures, so no job applies it by default.
    """
    text = F.replace(text, F.lit(ZERO_WIDTH_SPACE), F.lit(""))
    text = F.regexp_replace(text, TSHEG + "{2,}", TSHEG)
    return F.replace(text, F.lit(TSHEG + SHAD), F.lit(SHAD))


def normalise(
    text: Column,
    *,
    whitespace: bool = False,
    unicode_form: str | None = None,
    script: bool = False,
) -> Column:
    """Null becomes empty text; then Unicode form, script clean-up and whitespace, in that order."""
    text = unicode_normalise(F.coalesce(text, F.lit("")), unicode_form)
    if script:
        text = clean_script(text)
    return collapse_whitespace(text) if whitespace else text


def file_name(path: Column) -> Column:
    """Last component of a path."""
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    """Name of the directory that holds the file."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def stem(name: Column) -> Column:
    """File name without its last suffix; a leading dot is part of the name."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+\z", "")


def suffix(name: Column) -> Column:
    """Lower-cased last suffix with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(name, r"(?s)(?<=.)(\.[^.]+)\z", 1))


def mime_type(name: Column) -> Column:
    """MIME type by extension."""
    table = F.create_map(*[F.lit(part) for pair in MIME_TYPES.items() for part in pair])
    return F.coalesce(F.try_element_at(table, suffix(name)), F.lit("application/octet-stream"))


def is_native(name: Column, service: str) -> Column:
    """Whether a service takes the file as it is; others need the bytes converted first."""
    return suffix(name).isin(*NATIVE_SUFFIXES[service])


def safe_name(value: Column) -> Column:
    """Group value as a file name: stripped, with slashes, backslashes and spaces as ``_``."""
    return F.translate(strip(value.cast("string")), "/\\ ", "___")


def decode_uri(path: Column) -> Column:
    """Plain path from the percent-encoded form that file metadata columns carry."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
