"""Pages of PDF files: how many there are, and a file with only some of them.

Pruning adds an update to the file in which the page tree lists the chosen pages only; nothing is rewritten. Read are files with plain
objects and a flat page tree; files with object streams, encryption or nested trees give an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as T

OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj\b", re.S)
KIDS = re.compile(rb"/Kids\s*\[([^\]]*)\]")


def _tree(content: bytes) -> tuple[int, int, bytes, list[bytes]]:
    """(number, generation, body) of the page tree and its pages' references."""
    if not content.startswith(b"%PDF-"):
        raise ValueError("not a PDF")
    if b"/ObjStm" in content or b"/Encrypt" in content:
        raise ValueError("compressed or encrypted objects can't be read")
    trees = {m[1]: m for m in OBJECT.finditer(content) if re.search(rb"/Type\s*/Pages\b", m[3])}  # later objects replace earlier ones
    if len(trees) != 1:
        raise ValueError("the page tree isn't flat" if trees else "no page tree")
    m = next(iter(trees.values()))
    kids = KIDS.search(m[3])
    if not kids:
        raise ValueError("the page tree has no pages")
    return int(m[1]), int(m[2]), m[3].strip(), re.findall(rb"\d+\s+\d+\s+R", kids[1])


def page_count(content: bytes) -> int:
    return len(_tree(content)[3])


def pruned(content: bytes, pages: list[int]) -> bytes:
    """The file with the given pages (from 0) only."""
    number, generation, body, kids = _tree(content)
    body = KIDS.sub(b"/Kids [" + b" ".join(kids[i] for i in pages) + b"]", body, count=1)
    body = re.sub(rb"/Count\s+\d+", b"/Count %d" % len(pages), body, count=1)
    trailer = re.findall(rb"trailer\s*<<(.*?)>>\s*startxref\s+(\d+)", content, re.S)
    if not trailer:
        raise ValueError("no trailer")
    rest, before = trailer[-1]
    out = content if content.endswith(b"\n") else content + b"\n"
    at = len(out)
    out += b"%d %d obj\n%s\nendobj\n" % (number, generation, body)
    table = len(out)
    rest = re.sub(rb"/Prev\s+\d+", b"", rest).strip()
    return out + b"xref\n%d 1\n%010d %05d n \ntrailer\n<< %s /Prev %s >>\nstartxref\n%d\n%%%%EOF\n" % (number, at, generation, rest, before, table)


def chosen_pages(files: DataFrame, content: str = "content", pages: str = "pages") -> DataFrame:
    """Adds n_pages, skipped, pruned, error. A null list of pages takes all; pages out of bounds are skipped; none left is an error."""
    out = "n_pages int"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for c in b[content]:
                try:
                    rows.append((page_count(bytes(c)), None))
                except (ValueError, TypeError) as e:
                    rows.append((None, str(e)))
            yield b.assign(n_pages=pd.array([r[0] for r in rows], "Int32"), error=[r[1] for r in rows])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    counted = files.mapInPandas(count, f"{schema}, {out}, error string")
    choice = T.page_choice(F.col(pages), F.col("n_pages"))
    counted = counted.withColumn("_c", F.when(F.col(pages).isNotNull() & F.col("error").isNull(), choice)).withColumn("error", F.coalesce("error", "_c.error")).withColumn("skipped", F.col("_c.skipped")).withColumn("_kept", F.col("_c.kept")).drop("_c")

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = [bytes(c) if k is None else pruned(bytes(c), list(k)) for c, k in zip(b[content], b["_kept"])]
            yield b.drop(columns="_kept").assign(pruned=kept)

    good = counted.where("error is null").mapInPandas(prune, f"{schema}, {out}, error string, skipped array<int>, pruned binary")
    return good.unionByName(counted.where("error is not null").drop("_kept").withColumn("pruned", F.lit(None).cast("binary")))
