"""Bytes of web pages as text."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
META = re.compile(rb"<meta[^>]+charset=[\"']?([\w-]+)", re.I)


def _known(charset: str | None) -> str | None:
    try:
        return codecs.lookup(charset).name if charset else None
    except LookupError:
        return None


def detected(content: bytes) -> str | None:
    """The charset that a byte order mark, valid UTF-8 or the page itself tells; else windows-1252, which any bytes can be."""
    for mark, name in BOMS:
        if content.startswith(mark):
            return name
    try:
        content.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        m = META.search(content, 0, 4096)
        return _known(m.group(1).decode("ascii", "replace")) if m else "cp1252"


def decode(content: bytes | None, header: str | None) -> str | None:
    """Text in the charset of the header, else the detected one, else UTF-8; what can't be read becomes a replacement character."""
    if content is None:
        return None
    return bytes(content).decode(_known(header) or detected(bytes(content)) or "utf-8", errors="replace")


@F.pandas_udf(StringType())
def page_text(content: pd.Series, header: pd.Series) -> pd.Series:
    return pd.Series([decode(c, h) for c, h in zip(content, header)], dtype=object)
