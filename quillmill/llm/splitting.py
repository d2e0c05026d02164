"""Problem 1: cut oversized texts into pieces under a limit, at natural boundaries, with an overlap between neighbours.

Agglomerative merging. A text starts as atoms: its sentences; of an atom that is too long its clauses, of those its phrases,
words, parts of words, and at last slices that don't part a character from its combining marks. Neighbouring pairs wait in a
heap by the strength of the boundary between them; the weakest is merged first, then the shorter pair, then the earlier one,
as long as the pair and the overlap before it fit. What is left are the pieces, ending at the strongest boundaries.

Lengths are Unicode code points after white space (blank, tab, newline) has been collapsed and trimmed. Only texts over the
limit go to Python; the others come out whole without leaving the JVM.

Nulls: a null text gives no piece, a blank one neither; a null or non-positive limit means the default, a null or negative
overlap 0. An overlap that would leave no room is lowered to the limit less 2. A null array or an empty table gives no rows.
Repeated rows give repeated pieces; other columns aren't carried on.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX = 900

#: Strength of a boundary, and what ends there: from the strongest to the weakest.
LEVELS = (
    (6, re.compile(r"[.!?…。！？][\"'”’»)\]]*( )(?=[\"'“‘«(\[¿¡—–-]*[^\W\d_a-zß-öø-ÿ])")),
    (5, re.compile(r"[;:][\"'”’»)\]]*( )|( )(?=[—–] )")),
    (4, re.compile(r"[,)\]”»][\"'”’»)\]]*( )|( )(?=[(\[“«])")),
    (3, re.compile(r"( )")),
    (2, re.compile(r"(?<=[-‐/_.,;:?&=、。])()(?=\w)|(?<=[぀-ヿ㐀-鿿가-힯])()")),
)
KINDS = {6: "sentence", 5: "clause", 4: "phrase", 3: "word", 2: "part", 1: "slice", 0: "end"}
ABBREVIATION = re.compile(r"(?:\b\w|\.\w|\b(?:approx|etc|vs|cf|fig|no|vol|pp|dr|mr|mrs|prof|sr|sra|ex|aprox))\.$", re.I)


def _bound(text: str, at: int) -> bool:
    """Whether a cut before text[at] leaves marks, joiners and flags with their character."""
    c, before = text[at], text[at - 1]
    return not (unicodedata.combining(c) or c in "‍︎️" or before == "‍" or "\U0001f3fb" <= c <= "\U0001f3ff")


def _atoms(text: str, lo: int, hi: int, cap: int, level: int, out: list[tuple[int, int, int]]) -> None:
    """Adds (start, end, strength of the boundary at its end) of each atom in text[lo:hi]; the last atom's strength is set by the caller."""
    if hi - lo <= cap:
        out.append((lo, hi, 0))
        return
    if level == len(LEVELS):
        while hi - lo > cap:
            at = lo + cap
            while at > lo + 1 and not _bound(text, at):
                at -= 1
            if at == lo + 1 and not _bound(text, at):
                at = lo + cap
            out.append((lo, at, 1))
            lo = at
        out.append((lo, hi, 0))
        return
    strength, pattern = LEVELS[level]
    start = lo
    for m in pattern.finditer(text, lo, hi):
        g = next(k for k in range(1, (m.re.groups or 0) + 1) if m.start(k) >= 0)
        if strength == 6 and ABBREVIATION.search(text, max(lo, m.start() - 8), m.start(g)):
            continue
        end, after = m.span(g)
        if start < end and after < hi:
            _atoms(text, start, end, cap, level + 1, out)
            out[-1] = (*out[-1][:2], strength)
            start = after
    _atoms(text, start, hi, cap, level + 1, out)


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start of the overlap, start, end, kind of boundary at its end) of each piece of a collapsed text."""
    overlap = max(0, min(overlap, limit - 2))
    if len(text) <= limit:
        return [(0, 0, len(text), KINDS[0])] if text else []
    atoms: list[tuple[int, int, int]] = []
    room = limit - overlap - bool(overlap)
    _atoms(text, 0, len(text), room, 0, atoms)
    n = len(atoms)
    start, end, strength = ([a[k] for a in atoms] for k in range(3))
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    size = lambda i, j: end[j] - start[i]
    heap = [(strength[i], size(i, i + 1), i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, length, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or right[i] != j or size(i, j) != length:
            continue  # one of the two has grown; the grown pair has its own entry
        if length > (limit if left[i] < 0 else room):
            continue  # pairs only grow, so it never fits
        end[i], strength[i], right[i], alive[j] = end[j], strength[j], right[j], False
        if right[i] < n:
            left[right[i]] = i
            heapq.heappush(heap, (strength[i], size(i, right[i]), i, right[i]))
        if left[i] >= 0:
            heapq.heappush(heap, (strength[left[i]], size(left[i], i), left[i], i))
    out, i, before = [], 0, (0, 0)
    while i < n:
        first = start[i] if i == 0 else max(before[0], before[1] - overlap) if overlap else start[i]
        out.append((first, start[i], end[i], KINDS[strength[i] if right[i] < n else 0]))
        before = (first, end[i])
        i = right[i]
    return out


def collapsed(c: Column) -> Column:
    """White space collapsed to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[ \t\n]+", " "))


def split_texts(df: DataFrame, keys: list[str], text: str = "text", limit: str | None = None, overlap: str | None = None, default: int = DEFAULT_MAX) -> DataFrame:
    """Pieces of each text: the keys, text_chars, max_chars, n_pieces, piece_no, start, overlap_chars, n_chars, boundary, piece."""
    top = F.coalesce(F.when(F.col(limit) > 0, F.col(limit)), F.lit(default)) if limit else F.lit(default)
    shared = F.greatest(F.coalesce(F.col(overlap), F.lit(0)), F.lit(0)) if overlap else F.lit(0)
    t = df.select(*keys, collapsed(F.col(text)).alias("_qm_text"), top.cast("int").alias("max_chars"), shared.cast("int").alias("_qm_overlap"))
    t = t.withColumn("text_chars", F.length("_qm_text")).where("text_chars > 0")
    whole = t.where("text_chars <= max_chars").select(
        *keys, "text_chars", "max_chars", F.lit(1).alias("n_pieces"), F.lit(0).alias("piece_no"), F.lit(0).alias("start"), F.lit(0).alias("overlap_chars"), F.col("text_chars").alias("n_chars"), F.lit("end").alias("boundary"), F.col("_qm_text").alias("piece")
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*keys, "text_chars", "max_chars", "n_pieces", "piece_no", "start", "overlap_chars", "n_chars", "boundary", "piece"]
        for b in batches:
            rows = []
            for *key, s, most, share, chars in b.itertuples(index=False, name=None):
                pieces = split_text(s, most, share)
                ends = [0, *(p[2] for p in pieces)]  # what is repeated lies between a piece's start and the end of the one before
                rows += [(*key, chars, most, len(pieces), k, own, max(0, ends[k] - first), hi - first, kind, s[first:hi]) for k, (first, own, hi, kind) in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=names)

    long = t.where("text_chars > max_chars").select(*keys, "_qm_text", "max_chars", "_qm_overlap", "text_chars")
    return whole.unionByName(long.mapInPandas(cut, whole.schema))


def split_blocks(df: DataFrame, default: int = DEFAULT_MAX) -> DataFrame:
    """Pieces of each block of a block list; block_no counts from 0, nulls included."""
    flat = df.select("doc", F.col("max_chars").alias("_qm_max"), F.col("overlap_chars").alias("_qm_share"), F.posexplode("blocks").alias("block_no", "_qm_block"))
    return split_texts(flat, ["doc", "block_no"], "_qm_block", "_qm_max", "_qm_share", default)
