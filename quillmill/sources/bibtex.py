"""BibTeX files as entries, read through Spark's file systems."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

STANDARD = {"article", "book", "booklet", "conference", "inbook", "incollection", "inproceedings", "manual", "mastersthesis", "misc", "phdthesis", "proceedings", "techreport", "unpublished"}
MONTHS = {m[:3].lower(): m for m in "January February March April May June July August September October November December".split()}
ACCENTS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "v": "\u030c", "c": "\u0327", "u": "\u0306", "H": "\u030b", "k": "\u0328", "r": "\u030a"}
SYMBOLS = {"aa": "å", "AA": "Å", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "i": "ı"}


class BibtexError(ValueError):
    pass


def to_unicode(s: str) -> str:
    """LaTeX accents and symbols as characters, braces dropped."""
    s = re.sub(r"\\(aa|AA|ss|ae|AE|oe|OE|[oOlLi])(?![A-Za-z])\s*(?:\{\})?", lambda m: SYMBOLS[m.group(1)], s)
    s = re.sub(r"\\([`'^\"~=.]|[vcuHkr](?![A-Za-z]))\s*\{?\s*([A-Za-zı])\}?", lambda m: unicodedata.normalize("NFC", m.group(2).replace("ı", "i") + ACCENTS[m.group(1)]), s)
    return re.sub(r"\\([%&_#$])", r"\1", s).replace("{", "").replace("}", "")


class _Reader:
    def __init__(self, text: str):
        self.s, self.i, self.strings = text, 0, dict(MONTHS)

    def space(self) -> None:
        while self.i < len(self.s) and self.s[self.i].isspace():
            self.i += 1

    def name(self) -> str:
        m = re.compile(r"[^\s\"#%'(),={}]+").match(self.s, self.i)
        if not m:
            raise BibtexError(f"a name is expected at character {self.i}")
        self.i = m.end()
        return m.group()

    def braced(self, close: str) -> str:
        """Up to the brace or quote that closes, nested braces included."""
        start, depth = self.i, 0
        while self.i < len(self.s):
            c = self.s[self.i]
            if c == "\\":
                self.i += 1
            elif depth == 0 and c == close:
                self.i += 1
                return self.s[start : self.i - 1]
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if depth < 0:
                    raise BibtexError(f"a brace too many at character {self.i}")
            self.i += 1
        raise BibtexError(f"what opens at character {start} isn't closed")

    def value(self) -> str:
        parts = []
        while True:
            self.space()
            c = self.s[self.i : self.i + 1]
            if c in ("{", '"') and c:
                self.i += 1
                parts.append(self.braced("}" if c == "{" else '"'))
            else:
                w = self.name()
                parts.append(w if w.isdigit() else self.strings.get(w.lower(), w))
            self.space()
            if self.s[self.i : self.i + 1] != "#":
                return "".join(parts)
            self.i += 1

    def entries(self) -> Iterator[tuple[str, str, dict[str, str]]]:
        while (at := self.s.find("@", self.i)) >= 0:
            self.i = at + 1
            self.space()
            kind = self.name().lower()
            self.space()
            opening = self.s[self.i : self.i + 1]
            if opening not in ("{", "(") or not opening:
                raise BibtexError(f"a brace is expected at character {self.i}")
            self.i += 1
            if kind in ("comment", "preamble"):
                self.braced("}" if opening == "{" else ")")
                continue
            self.space()
            if kind == "string":
                k = self.name().lower()
                self.space()
                self.i += 1
                self.strings[k] = self.value()
                self.space()
                self.i += 1
                continue
            m = re.compile(r"[^,}]*").match(self.s, self.i)
            key, self.i = m.group().strip(), m.end()
            fields: dict[str, str] = {}
            while True:
                self.space()
                if self.s[self.i : self.i + 1] == ",":
                    self.i += 1
                    self.space()
                if self.s[self.i : self.i + 1] in ("}", ")"):
                    self.i += 1
                    break
                if self.i >= len(self.s):
                    raise BibtexError(f"the entry {key} isn't closed")
                f = self.name().lower()
                self.space()
                if self.s[self.i : self.i + 1] != "=":
                    raise BibtexError(f"= is expected at character {self.i}")
                self.i += 1
                fields.setdefault(f, self.value())
            yield kind, key, fields


def parse(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(entry type, key, fields) of each entry, in order; raises BibtexError where the text is broken."""
    return list(_Reader(text).entries())


def entries_of(files: DataFrame, unicode: bool = False, nonstandard: bool = True) -> DataFrame:
    """src, pos, entry_type, id, fields, error of files (path, content): one row for each entry; a file that can't be read gives one row with an error.

    unicode: LaTeX accents as characters; nonstandard: keep entry types that aren't standard.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                src = path.rsplit("/", 1)[-1]
                try:
                    found = parse(bytes(content).decode("utf-8-sig"))
                except (BibtexError, UnicodeDecodeError) as e:
                    rows.append((src, None, None, None, None, str(e)))
                    continue
                kept = [x for x in found if nonstandard or x[0] in STANDARD]
                rows += [(src, pos, kind, key, {k: to_unicode(v) if unicode else v for k, v in fields.items()}, None) for pos, (kind, key, fields) in enumerate(kept)]
            yield pd.DataFrame(rows, columns=["src", "pos", "entry_type", "id", "fields", "error"]).astype({"pos": "Int64"})

    return files.select("path", "content").mapInPandas(run, "src string, pos long, entry_type string, id string, fields map<string,string>, error string")


def read(spark: SparkSession, path: str, unicode: bool = False, nonstandard: bool = True) -> DataFrame:
    """The entries of a .bib file or of all in a folder and below, on any file system that Spark reads. A task reads files of several megabytes together."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bib").load(path)
    return entries_of(files, unicode, nonstandard)
