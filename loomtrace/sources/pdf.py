"""Text and invoice fields of PDF files.

Files are read whole (``binaryFile``), one a row. Their streams are inflated and their text operators followed
in batches of a task; fields are found by column functions. Defined results: a file that is no PDF, that has
no stream which can be read, or that shows no text is a row with ``reject_reason``; streams that are damaged
are passed over; fields that a text lacks are null; Spark's reader passes over files without a byte.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace import constants as C

_STRING = rb"\((?:\\.|[^\\()])*\)"
#: A text operator with what it shows: one string, or an array of strings and distances.
_SHOWN = re.compile(rb"(" + _STRING + rb")\s*(?:Tj|'|\")|\[((?:\s*(?:" + _STRING + rb"|-?[\d.]+))*)\s*\]\s*TJ", re.S)
_ESCAPED = re.compile(rb"\\(\d{1,3}|.)", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
TEXTS = "path string, text string, reject_reason string"


def streams(data: bytes) -> Iterator[bytes]:
    """The contents of a file's streams, inflated where they are compressed; damaged ones as far as they can be read."""
    at = data.find(b"stream")
    while at >= 0:
        begin = at + len(b"stream")
        begin += 2 if data[begin : begin + 2] == b"\r\n" else 1
        end = data.find(b"endstream", begin)
        if end < 0:
            return
        body = data[begin:end]
        if body[:1] == b"\x78":
            try:
                yield zlib.decompressobj().decompress(body)
            except zlib.error:
                pass
        else:
            yield body
        at = data.find(b"stream", end + len(b"endstream"))


def _string(raw: bytes) -> bytes:
    def plain(m: re.Match) -> bytes:
        return bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _PLAIN.get(m[1], m[1])

    return _ESCAPED.sub(plain, raw[1:-1])


def shown_text(data: bytes) -> str:
    """What the text operators of a file show, one line each."""
    lines = []
    for body in streams(data):
        for m in _SHOWN.finditer(body):
            parts = [m[1]] if m[1] is not None else re.findall(_STRING, m[2], re.S)
            lines.append(b"".join(map(_string, parts)).decode("latin-1"))
    return "\n".join(lines)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all PDF files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path).select("path", "content")


def texts(files: DataFrame) -> DataFrame:
    """(path, text, reject_reason) of (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                data = bytes(content) if content is not None else b""
                text = shown_text(data) if data.lstrip()[:5] == b"%PDF-" else None
                out.append((path, text or None, "not a PDF file" if text is None else None if text else "no text can be read"))
            yield pd.DataFrame(out, columns=["path", "text", "reject_reason"])

    return files.select("path", "content").mapInPandas(run, TEXTS)


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def titled(text: Column) -> Column:
    """Every run of letters with a capital first."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), lambda x: F.initcap(x)), "")


def invoices(found: DataFrame, *kept: str) -> DataFrame:
    """Number, ISO date, amount in minor units and vendor of texts (path, text): the last total, and the first line in capitals.

    Columns of the texts that are ``kept`` stand beside them.
    """
    text = F.col("text")
    date = _found(text, C.INVOICE_DATE)
    turned = F.concat_ws("-", *(F.get(F.split(date, "[/-]"), i) for i in (2, 1, 0)))
    amount = F.regexp_replace(F.get(F.reverse(F.regexp_extract_all(text, F.lit(C.INVOICE_AMOUNT), F.lit(1))), 0), ",", "")
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x))
    capital = F.get(F.filter(lines, lambda x: (F.length(x) > 8) & (F.upper(x) == x) & (F.lower(x) != x)), 0)
    return found.select(
        "path", _found(text, C.INVOICE_NUMBER).alias("invoice_no"), F.when(date.rlike(r"^\d{4}-"), date).when(date.isNotNull(), turned).alias("invoice_date"),
        F.bround(amount.try_cast("double") * 100).cast("long").alias("amount"), titled(capital).alias("vendor"), *kept,
    )
