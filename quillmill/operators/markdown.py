"""Markdown read as blocks that can be spoken: a CommonMark subset parsed line by line in an Arrow-batched UDF.

Read: ATX and setext headings, paragraphs with lazy continuation, lists, quotes, fences, indented code, HTML blocks, pipe tables, footnote
definitions; inline code, emphasis, links, images, breaks, autolinks, escapes, entities. Code, tables, HTML and images become a cue each.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillmill.functions.text import OMISSION_CUES, dedupe_adjacent, pack_chunks

FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*)|$)")
DIVIDER = re.compile(r" {0,3}\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
HTML_START = re.compile(r" {0,3}<(?:/?(?:address|article|aside|blockquote|body|button|caption|center|col|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|option|p|param|pre|script|section|style|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|track|ul)(?:[\s/>]|$)|!--|\?|![A-Z])", re.I)
FOOTNOTE = re.compile(r"\[\^[^\]]+\]:")
LINK = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\](?:\(\s*(?:<[^>\n]*>|(?:[^()\s\\]|\\.|\([^()\s]*\))*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\))")
TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
STRONG = re.compile(r"(?<![\w*])(\*{1,3})(?=\S)(.+?)(?<=\S)\1(?![\w*])|(?<![\w_])(_{1,3})(?=\S)(.+?)(?<=\S)\3(?![\w_])|(?<!\\)(\*{1,3})(?=\S)([^*]+?)(?<=\S)\5", re.S)


def inline(text: str, cues: dict[str, str]) -> tuple[str, list[str]]:
    """(what is spoken of a line of text, cues of its images)."""
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x00{len(kept) - 1}\x00"

    found: list[str] = []
    text = re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: keep(m.group(2).replace("\n", " ").strip() if m.group(2).strip() else m.group(2)), text, flags=re.S)
    text = re.sub(r"<((?:https?|ftp|mailto):[^\s<>]*)>", lambda m: keep(m.group(1)), text)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(m.group(1)), text)

    def link(m: re.Match) -> str:
        if m.group(1):
            found.append(cues["image"])
            return ""
        return TAG.sub("", LINK.sub(link, m.group(2)))

    text = LINK.sub(link, text)
    text = re.sub(r"(?:  +|\\)\n", ". ", text)
    while (new := STRONG.sub(lambda m: m.group(2) or m.group(4) or m.group(6), text)) != text:
        text = new
    text = html.unescape(text)
    while "\x00" in text:
        new = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m.group(1))], text)
        if new == text:
            break
        text = new
    return re.sub(r"\s+", " ", text).strip(), found


def _footnotes(lines: list[str], cues: dict[str, str]) -> list[str]:
    out, inside = [], False
    for x in lines:
        if FOOTNOTE.match(x):
            out.append(cues["footnote"])
            inside = True
        elif not (inside and (x.startswith(("    ", "\t")) or not x.strip())):
            inside = False
            out.append(x)
    return out


def _blocks(lines: list[str], cues: dict[str, str], out: list[str], depth: int = 0) -> None:
    i, n, para = 0, len(lines), []

    def close() -> None:
        if para:
            text, found = inline("\n".join(para), cues)
            text = re.sub(r"\s+", " ", re.sub(r"\[\^[^\]]+\]", "", text)).strip()
            if text:
                out.append(text)
            out.extend(found)
            para.clear()

    while i < n:
        x = lines[i]
        if not x.strip():
            close()
            i += 1
        elif m := FENCE.match(x):
            if m.group(1)[0] == "`" and "`" in m.group(2):
                para.append(x.strip())
                i += 1
                continue
            close()
            mark, i = m.group(1), i + 1
            while i < n and not re.match(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[i]):
                i += 1
            out.append(cues["code"])
            i += 1
        elif not para and (x.startswith("    ") or x.startswith("\t")):
            while i < n and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                i += 1
            out.append(cues["code"])
        elif m := HEADING.match(x):
            close()
            para.append(m.group(1) or "")
            close()
            i += 1
        elif para and SETEXT.match(x):
            close()
            i += 1
        elif RULE.match(x):
            close()
            i += 1
        elif HTML_START.match(x):
            close()
            if x.lstrip().startswith("<!--"):
                while i < n and "-->" not in lines[i]:
                    i += 1
                i += 1
            else:
                while i < n and lines[i].strip():
                    i += 1
            out.append(cues["html"])
        elif "|" in x and i + 1 < n and "-" in lines[i + 1] and DIVIDER.match(lines[i + 1]) and ("|" in lines[i + 1] or x.strip().startswith("|")):
            close()
            i += 2
            while i < n and lines[i].strip() and not HEADING.match(lines[i]) and not FENCE.match(lines[i]):
                i += 1
            out.append(cues["table"])
        elif re.match(r" {0,3}>", x) and depth < 20:
            close()
            inner = []
            while i < n and lines[i].strip() and (re.match(r" {0,3}>", lines[i]) or not (FENCE.match(lines[i]) or HEADING.match(lines[i]) or ITEM.match(lines[i]) or RULE.match(lines[i]))):
                inner.append(re.sub(r"^ {0,3}> ?", "", lines[i]))
                i += 1
            _blocks(inner, cues, out, depth + 1)
        elif (m := ITEM.match(x)) and depth < 20 and not (para and (not (m.group(4) or "").strip() or (m.group(2)[0].isdigit() and not m.group(2).startswith("1")))):
            close()
            pad = len(m.group(3) or " ")
            width = len(m.group(1)) + len(m.group(2)) + (pad if pad <= 4 else 1)
            inner, i, gap = [m.group(4) or ""], i + 1, False
            while i < n:
                y = lines[i]
                if not y.strip():
                    gap = True
                    inner.append("")
                elif len(y) - len(y.lstrip(" ")) >= width:
                    inner.append(y[width:])
                    gap = False
                elif gap or ITEM.match(y) or FENCE.match(y) or HEADING.match(y) or RULE.match(y) or re.match(r" {0,3}>", y):
                    break
                else:
                    inner.append(y.strip())
                i += 1
            _blocks(inner, cues, out, depth + 1)
        else:
            line = x.lstrip()
            para.append(line if line.endswith("  ") else line.rstrip())
            i += 1
    close()


def speakable(markdown: str | None, lang: str | None) -> list[str]:
    """Blocks of a text, with cues in its language (English where it is none of the known)."""
    cues = OMISSION_CUES.get((lang or "").lower(), OMISSION_CUES["en"])
    out: list[str] = []
    lines = re.split(r"\r\n|[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]", markdown or "")
    _blocks([x.expandtabs(4) for x in _footnotes(lines, cues)], cues, out)
    return out


@F.pandas_udf(ArrayType(StringType()))
def speakable_blocks(markdown: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([speakable(m, la) for m, la in zip(markdown, lang)])


def narration_chunks(docs: DataFrame, key: str, markdown: str, lang: Column, limit: int = 900) -> DataFrame:
    """key, chunk_no, chunk: chunks to narrate of Markdown texts: blocks, without repeats, split and packed. One pass of Python; no shuffle."""
    b = docs.select(key, F.col(markdown).alias("_text"), lang.alias("_lang")).select(key, speakable_blocks("_text", "_lang").alias("_blocks"))
    c = b.select(key, pack_chunks(dedupe_adjacent(F.col("_blocks")), F.lit(limit)).alias("_chunks"))
    # outer, else a filter on the array's size is put below, which computes all of it once more
    return c.select(key, F.posexplode_outer("_chunks").alias("chunk_no", "chunk")).where("chunk_no is not null")
