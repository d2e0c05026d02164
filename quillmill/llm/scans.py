"""Problem 3: continuous paragraphs from the recognised lines of scanned pages.

Two averaged perceptrons, trained on samples of the data itself whose size is a parameter:

* Furniture. A line at the head or foot of a page is running head, foot or page number, judged by its place, its look, its
  likeness to the outer lines of the scan's other pages, and whether its number keeps in step with the page number.
  Training labels: lines that recur letter for letter on three pages, or count along with the pages, against lines from within.
* Characters. For each character the editor weighs keep, replace, delete, insert, merge with the next, split in two, and
  at a line's end join. Training pairs are rare words and the frequent word that one such edit leads to, and line ends of which
  only one reading, joined or hyphenated, is a word of the corpus.

Word counts cover all lines of all pages, and every kind of word is judged, whatever its frequency. A misread word is one that the editor
would make into a word RATIO times as frequent, by an edit that several rare words bear out or that reads marks, or into one ANY_RATIO
times as frequent by any edit (frequent words may be near others by nature, as than and the). Whether a line's end is joined is the editor's
decision, which sees the counts of both readings. The most frequent words that are read rightly (a bounded number) go to the workers, so that
only other words are joined with the counts.

Nulls: null or empty content has no lines; a null scan or page_no makes a page a scan of its own without neighbours. Repeated rows
count as pages. An empty table gives no rows.
"""

from __future__ import annotations

import re
import statistics
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.perceptron import Perceptron
from quillmill.session import cut

#: Bounds of what is read on the driver: frequent words, and the samples that the perceptrons are fitted to.
FREQUENT, RARE_SAMPLE, LINE_SAMPLE, HYPHEN_SAMPLE = 50_000, 4_000, 12_000, 4_000
#: How much more frequent the word meant must be than the word read.
RATIO = 8.0
#: The same for an edit that isn't borne out by other words.
ANY_RATIO = 40.0
#: Rare words that must show an edit before it puts a frequent word right.
BORNE = 2

#: Different lines of a scan in a block; all blocks of a scan meet each other. Columns of letter pairs that are multiplied at once.
LINES, COLUMNS = 1_000, 4_096

HYPHENS = "-‐¬\xad"
EDGE = ".,;:?!…“”„\"'‘’()[]{}«»—–*_"
NUMBERISH = str.maketrans("lIi|!oOQsSbBgqzZ", "1111100055889922")
PARTED = re.compile(r"((?:[^\s\-‐¬\xad]+-)*[^\s\-‐¬\xad]*[\w@~|!])([\-‐¬\xad])$")
FIGURES = re.compile(r"[\d\s.,:/()–-]+")
ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")


def tokens_of(line: str) -> list[str]:
    return [t for w in line.split() if (t := w.strip(EDGE))]


def numbers_of(line: str) -> list[int]:
    """Numbers that a line, or a part of it set apart by blanks, is; misread digits and Roman numerals included."""
    out = []
    for part in re.split(r"\s{2,}", line.strip()):
        words = re.findall(r"[^\s\[\](),./–-]+", part)
        if len(part) > 14 or len(words) > 3:
            continue
        for w in words[-2:]:
            t, low = w.translate(NUMBERISH), w.lower()
            if t.isdigit() and len(t) < 6:
                out.append(int(t))
            if ROMAN.fullmatch(low):
                v = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c] for c in low]
                out.append(sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0])))
    return out


def skeleton(line: str) -> str:
    return re.sub(r"\d+", "9", re.sub(r"[^\w\d]+", " ", line.lower())).strip()


def zone_lines(content: str) -> list[tuple[int, str, int, str]]:
    """(line_no, zone, place from that end, text) of the lines a head or foot can be: the two outermost at either end."""
    full = [(i + 1, x) for i, x in enumerate(content.split("\n")) if x.strip()]
    top = full[:2] if len(full) > 3 else full[: (len(full) + 1) // 2]
    bottom = full[-2:] if len(full) > 3 else full[(len(full) + 1) // 2 :]
    return [(n, "top", k, x) for k, (n, x) in enumerate(top)] + [(n, "bottom", k, x) for k, (n, x) in enumerate(reversed(bottom))]


def line_features(line: str, zone: str, place: int, blank_in: bool, width: float, words_again: float, same_again: int, counted: int) -> list[str]:
    """What the furniture perceptron sees of a line."""
    s = line.strip()
    letters = [c for c in s if c.isalpha()]
    n_num = sum(c.isdigit() for c in s)
    numbered = "num" if numbers_of(s) else "none"
    again = "0" if words_again < 0.4 else "1" if words_again < 0.6 else "2" if words_again < 0.75 else "3"
    shape = "figures" if n_num and n_num * 2 >= len(s.replace(" ", "")) else "short" if len(s) <= 8 else "words"
    ended = "end" if s[-1] in ".?!;,:”" else "open"
    start = "lower" if s[:1].islower() else "upper"
    caps = "caps" if letters and sum(c.isupper() for c in letters) > 0.8 * len(letters) else "mixed"
    step = f"step{min(counted, 2)}"
    seen = f"same{min(same_again, 2)}"
    long = "long" if len(s) > 0.85 * width else "part"
    at = f"{zone}{place}"
    section = "section" if re.match(r"\d+\.\s+\S", s) else ""
    return ["bias", at, f"again{again}", f"{at}|again{again}", shape, f"{at}|{shape}|{step}|{numbered}", f"{step}|{numbered}", f"{step}|{shape}|{numbered}", seen, f"{ended}|{start}|{again}", f"{caps}|{again}", f"blank{blank_in}|{at}|{shape}", f"{long}|{again}", f"{shape}|{again}", f"{at}|{ended}|{start}|{long}|{section}", f"{ended}|{start}|{long}|{again}"]


def furniture_model(sample: list[tuple]) -> Perceptron:
    """Trained on lines whose label is plain: letter for letter on three pages, or counting along, against inner lines."""
    examples = []
    for line, zone, place, blank_in, width, again, same, counted, inner in sample:
        if inner:
            label = "text"
        elif same >= 2 or (counted >= 2 and len(line.strip()) <= 12):
            label = "furniture"
        else:
            continue
        f = line_features(line, zone, place, blank_in, width, again, same, counted)
        examples.append((f, label, ["furniture", "text"]))
        if label == "furniture":  # heads that aren't read alike are heads all the same
            f = line_features(line, zone, place, blank_in, width, min(again, 0.85), 0, counted)
            examples.append((f, label, ["furniture", "text"]))
    return Perceptron().train(examples)


def _around(w: str, i: int) -> list[str]:
    p, c, n = (w[i - 1] if i else "^"), w[i], (w[i + 1] if i + 1 < len(w) else "$")
    pp, nn = (w[i - 2] if i > 1 else "^"), (w[i + 2] if i + 2 < len(w) else "$")
    return ["c" + c, "p" + p + c, "n" + c + n, "b" + p + c + n, "q" + pp + p + c, "m" + c + n + nn]


def alignment(read: str, meant: str) -> tuple[int, str] | None:
    """(position, operation) of the one edit from `read` to `meant`, if there is one."""
    p = 0
    while p < min(len(read), len(meant)) and read[p] == meant[p]:
        p += 1
    s = 0
    while s < min(len(read), len(meant)) - p and read[-1 - s] == meant[-1 - s]:
        s += 1
    a, b = read[p : len(read) - s], meant[p : len(meant) - s]
    if len(a) == 1 and len(b) == 1:
        return p, "replace:" + b
    if len(a) == 1 and not b:
        return p, "delete"
    if not a and len(b) == 1:
        return (p, "insert:" + b) if p < len(read) else (p - 1, "append:" + b) if read else None
    if len(a) == 2 and len(b) == 1:
        return p, "merge:" + b
    if len(a) == 1 and len(b) == 2:
        return p, "split:" + b
    return None


def applied(w: str, i: int, op: str) -> str:
    kind, _, c = op.partition(":")
    return {
        "keep": w, "replace": w[:i] + c + w[i + 1 :], "delete": w[:i] + w[i + 1 :], "insert": w[:i] + c + w[i:], "append": w[: i + 1] + c + w[i + 1 :], "merge": w[:i] + c + w[i + 2 :], "split": w[:i] + c + w[i + 1 :]
    }[kind]


def edit_of(w: str, i: int, op: str) -> tuple[str, str]:
    """The characters that an operation at a place reads, and the operation."""
    return w[i : i + 2] if op.startswith("merge") else w[i], op


class Editor:
    """The character perceptron with the operations known for each character, and the edits borne out: characters read, operation."""

    def __init__(self, model: Perceptron, ops: dict[str, list[str]], borne: set[tuple[str, str]]):
        self.model, self.ops, self.borne = model, ops, borne

    def is_borne(self, w: str, i: int, op: str) -> bool:
        """Whether other words show the edit, or what is read is marks: those don't stand within printed words by nature."""
        edit = edit_of(w, i, op)
        return edit in self.borne or not any(map(str.isalnum, edit[0]))

    def proposals(self, w: str, width: int = 4) -> dict[str, bool]:
        """Words the editor would make of w, and whether their edits are borne out: each single edit among the best few of its place, and all best edits together."""
        out: dict[str, bool] = {}
        whole, shift, all_borne = w, 0, True
        for i in range(len(w)):
            f = _around(w, i)
            allowed = self.ops.get(w[i], self.ops["*"])
            ranked = sorted(((self.model.score(f, o), o) for o in allowed), reverse=True)
            for _, o in ranked[: width + 1]:
                if o != "keep":
                    x = applied(w, i, o)
                    out[x] = out.get(x, False) or self.is_borne(w, i, o)
            if ranked and ranked[0][1] != "keep" and i + shift < len(whole):
                before = len(whole)
                whole = applied(whole, i + shift, ranked[0][1])
                shift += len(whole) - before
                all_borne = all_borne and self.is_borne(w, i, ranked[0][1])
        out[whole] = out.get(whole, False) or all_borne
        out.pop(w, None)
        return {x: b for x, b in out.items() if x}

    def joins(self, a: str, mark: str, b: str, counts: tuple[int, int, int] = (0, 0, 0)) -> bool:
        f = join_features(a, mark, b, counts)
        return self.model.score(f, "join") >= self.model.score(f, "keep")


def join_features(a: str, mark: str, b: str, counts: tuple[int, int, int] = (0, 0, 0)) -> list[str]:
    """What the editor sees of a line's end; counts: how often the word occurs joined, with the hyphen, and what stands before it with another."""
    joined, hyphened, before = counts
    seen = "joined" if joined > hyphened else "hyphened" if hyphened > joined else "both" if joined else "before" if before else "none"
    case = "figures" if a[-1:].isdigit() or b[:1].isdigit() else "upper" if b[:1].isupper() and not a.isupper() else "lower" if b else "lost"
    return ["J", "Jm" + mark, "Ja" + a[-3:].lower(), "Jb" + b[:3].lower(), "JB" + b.lower(), f"Jl{min(len(a), 9)}", f"Jr{min(len(b), 9)}", "Jc" + case, "Jn" + seen, f"Jn{seen}|{mark}", f"Jn{seen}|{case}|{mark}"]


def editor_model(rare: list[tuple[str, int]], frequent: dict[str, int], ends: list[tuple]) -> Editor:
    """Pairs each rare word with the most frequent word one edit away, and fits the editor to the edits; ends are (before, mark, after, label) of line ends, and counts if there are."""
    by_hole: dict[str, list[str]] = defaultdict(list)  # a frequent word without any one or two neighbouring letters
    for v in frequent:
        for i in range(len(v)):
            by_hole[f"{v[:i]}*{v[i + 1 :]}"].append(v)
            by_hole[f"{v[:i]}*{v[i:]}"].append(v)
            if i + 2 <= len(v):
                by_hole[f"{v[:i]}*{v[i + 2 :]}"].append(v)
        by_hole[f"{v}*"].append(v)
    examples, ops, seen = [], defaultdict(Counter), Counter()
    for w, n in rare:
        holes = {f"{w[:i]}*{w[i + k :]}" for i in range(len(w) + 1) for k in (0, 1, 2) if i + k <= len(w)}
        near = [(frequent[v], v) for h in holes for v in by_hole.get(h, ()) if frequent[v] >= RATIO * n]
        found = max(((c, v, a) for c, v in near if (a := alignment(w, v))), default=None)
        if found:
            i, op = found[2]
            examples.append((w, i, op))
            ops[w[i]][op] += 1
            seen[edit_of(w, i, op)] += 1
    known = {c: ["keep", *[o for o, k in x.most_common(24)]] for c, x in ops.items()}
    known["*"] = ["keep", "delete"]
    rows = []
    for w, i, op in examples:
        for j in range(len(w)):
            if j == i or j % 3 == len(w) % 3:  # all edits, a third of what is kept
                allowed = known.get(w[j], known["*"])
                label = op if j == i else "keep"
                if label in allowed:
                    rows.append((_around(w, j), label, allowed))
    for a, m, b, joined, *counts in ends:
        # with what the counts tell and without, as for words that nobody has seen whole
        for c in {(0, 0, 0), *((0, 0, c[2]) for c in counts), *counts}:
            rows.append((join_features(a, m, b, c), "join" if joined else "keep", ["join", "keep"]))
        for c in {(0, 0, c[2]) for c in counts}:  # and as if the rest were lost
            rows.append((join_features(a, m, "", c), "join" if joined else "keep", ["join", "keep"]))
    return Editor(Perceptron().train(rows), known, {e for e, k in seen.items() if k >= BORNE})


def _readable() -> Column:
    """Whether content has a character other than white space."""
    return F.coalesce(F.col("content"), F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]")


def _keyed(pages: DataFrame) -> DataFrame:
    """Pages with a null scan or page_no as scans of their own, named by a zero character and the page_id."""
    lone = F.col("scan").isNull() | F.col("page_no").isNull()
    return pages.withColumns({"scan": F.when(lone, F.concat(F.lit("\x00"), F.col("page_id").cast("string"))).otherwise(F.col("scan")), "page_no": F.coalesce("page_no", F.lit(1))})


def _page_rows(pages: DataFrame) -> DataFrame:
    p = _keyed(pages).select("page_id", "scan", "page_no", F.coalesce("content", F.lit("")).alias("content"))
    return p.where(_readable())


def _zone_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for page, scan, no, content in b[["page_id", "scan", "page_no", "content"]].itertuples(index=False, name=None):
            lines = content.split("\n")
            width = float(statistics.median(len(x) for x in lines if x.strip()))
            for n, zone, place, x in zone_lines(content):
                inward = lines[n] if zone == "top" and n < len(lines) else lines[n - 2] if zone == "bottom" and n > 1 else "x"
                rows.append((page, scan, no, n, zone, place, x, not inward.strip(), width, skeleton(x), [v - no for v in numbers_of(x)], False))
            inner = [(i + 1, x) for i, x in enumerate(lines) if x.strip()][2:-2]
            for n, x in inner[:: max(1, len(inner) // 4)]:  # some lines of the text, as the perceptron's other class
                zone = "top" if n % 2 else "bottom"
                rows.append((page, scan, no, n, zone, n % 2, x, False, width, skeleton(x), [v - no for v in numbers_of(x)], True))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ZONE.split(", ")])


ZONE = "page_id long, scan string, page_no int, line_no int, zone string, place int, line string, blank_in boolean, width double, skeleton string, offsets array<int>, inner boolean"


def _pairs(s: str) -> set[str]:
    return {x + y for x, y in zip(s, s[1:])}


def likeliest(lines: list[str], outer: list[str]) -> np.ndarray:
    """For each line Dice's coefficient of the pairs of neighbouring letters with the likeliest other of the outer lines; 0 if there is none."""
    ids: dict[str, int] = {}
    right = [[ids.setdefault(p, len(ids)) for p in _pairs(s)] for s in outer]
    left = [(len(x), [ids[p] for p in x if p in ids]) for x in map(_pairs, lines)]

    def columns(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.fromiter((k for x in rows for k in x), np.int64)

    (row_a, col_a), (row_b, col_b) = columns([x for _, x in left]), columns(right)
    common = np.zeros((len(lines), len(outer)), np.float32)
    for at in range(0, len(ids), COLUMNS):
        a, b = np.zeros((len(lines), min(COLUMNS, len(ids) - at)), np.float32), np.zeros((len(outer), min(COLUMNS, len(ids) - at)), np.float32)
        for m, row, col in ((a, row_a, col_a), (b, row_b, col_b)):
            here = (col >= at) & (col < at + COLUMNS)
            m[row[here], col[here] - at] = 1
        common += a @ b.T
    sizes = np.array([n for n, _ in left], np.float64)[:, None] + np.array([len(x) for x in right], np.float64)[None, :]
    like = 2 * common.astype(np.float64) / np.maximum(1.0, sizes)
    place = {s: k for k, s in enumerate(outer)}
    own = [(i, place[s]) for i, s in enumerate(lines) if s in place]
    if own:
        like[tuple(zip(*own))] = 0.0
    return like.max(axis=1, initial=0.0)


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Likeness of the lines of a block to the outer lines of another block of the same scan and end."""
    for b in batches:
        for scan, zone, lines, outer in b[["scan", "zone", "lines", "outer"]].itertuples(index=False, name=None):
            yield pd.DataFrame({"scan": scan, "zone": zone, "skeleton": lines, "again": likeliest(list(lines), list(outer))})


def likenesses(z: DataFrame) -> DataFrame:
    """(scan, zone, skeleton, again): how like a line is to the likeliest other outer line of its scan and end. All outer lines are compared."""
    kinds = z.where("length(skeleton) > 3").groupBy("scan", "zone", "skeleton").agg(F.max(~F.col("inner")).alias("outer"))
    blocks = kinds.groupBy("scan", "zone").agg(F.ceil(F.count(F.lit(1)) / LINES).alias("blocks"))
    kinds = kinds.join(blocks, ["scan", "zone"]).withColumn("block", F.pmod(F.xxhash64("skeleton"), F.col("blocks")))
    kinds = cut(kinds.groupBy("scan", "zone", "blocks", "block").agg(F.collect_list("skeleton").alias("lines"), F.collect_list(F.when(F.col("outer"), F.col("skeleton"))).alias("outer")))
    # by the other block, so that a scan with many pages is spread over many tasks
    met = kinds.select("scan", "zone", "lines", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).join(kinds.select("scan", "zone", "block", "outer").where("size(outer) > 0"), ["scan", "zone", "block"])
    return met.mapInPandas(_alike, "scan string, zone string, skeleton string, again double").groupBy("scan", "zone", "skeleton").agg(F.max("again").alias("again"))


def furniture(pages: DataFrame) -> DataFrame:
    """(page_id, line_no) of running heads and feet and page numbers. pages as from _page_rows."""
    z = cut(pages.mapInPandas(_zone_rows, ZONE))  # at most eight short lines a page
    outer = z.where("not inner")
    own = F.when(F.col("inner"), 0).otherwise(1)
    same = outer.groupBy("scan", "zone", "skeleton").agg(F.count_distinct("page_no").alias("same"))
    step = outer.select("scan", "page_no", F.explode("offsets").alias("offset")).groupBy("scan", "offset").agg(F.count_distinct("page_no").alias("counted"))
    steps = z.select("page_id", "line_no", "scan", F.explode("offsets").alias("offset")).join(step, ["scan", "offset"]).groupBy("page_id", "line_no").agg(F.max("counted").alias("counted"))
    # a line read alike on several pages is its own likeliest
    again = F.when(F.length("skeleton") <= 3, 0.0).when(F.col("same") > 1, 1.0).otherwise(F.coalesce("again", F.lit(0.0)))
    z = z.join(same, ["scan", "zone", "skeleton"], "left").join(likenesses(z), ["scan", "zone", "skeleton"], "left").join(steps, ["page_id", "line_no"], "left")
    z = cut(z.select("page_id", "line_no", "line", "zone", "place", "blank_in", "width", again.alias("again"), (F.coalesce("same", F.lit(0)) - own).cast("int").alias("same"), (F.coalesce("counted", F.lit(0)) - F.when(F.col("counted").isNull(), 0).otherwise(own)).cast("int").alias("counted"), "inner"))
    sample = [tuple(r)[2:] for r in z.orderBy(F.xxhash64("page_id", "line_no")).limit(LINE_SAMPLE).collect()]
    model = furniture_model(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for line, zone, place, blank, width, again, same_, counted in b[["line", "zone", "place", "blank_in", "width", "again", "same", "counted"]].itertuples(index=False, name=None):
                f = line_features(line, zone, place, blank, width, again, same_, counted)
                keep.append(model.score(f, "furniture") > model.score(f, "text"))
            yield b.loc[keep, ["page_id", "line_no"]]

    return z.where("not inner").mapInPandas(run, "page_id long, line_no int").distinct()


def _text_lines(content: str, away: set[int]) -> list[tuple[int, str]]:
    return [(i + 1, x.rstrip()) for i, x in enumerate(content.split("\n")) if x.strip() and i + 1 not in away]


def _hyphened(line: str) -> tuple[str, str] | None:
    """(part of a word, mark) at the end of a line."""
    m = PARTED.search(line) if line[-1:] in HYPHENS else None
    return (m.group(1).lstrip(EDGE), m.group(2)) if m else None


#: White space spelt out, as the JVM is slow to look classes up, and a hyphened part of a word at a line's end.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
SPACE = f"[{BLANKS}]+"
END = r"(?U)[\w@~|!][\-‐¬\xad]$"


def _with_lines(p: DataFrame, *columns: str) -> DataFrame:
    """The columns, and lines: array of (line_no, line, whether it ends inside a word) of a page's text, without what is away, blank lines and white space at the ends."""
    away = F.coalesce("away", F.array().cast("array<int>"))
    ends = lambda x: F.right(x, F.lit(1)).isin(*HYPHENS) & x.rlike(END)
    trimmed = F.transform(F.split("content", "\n"), lambda x, i: F.struct((i + 1).alias("n"), F.btrim(x, F.lit(BLANKS)).alias("x")))
    lines = F.filter(trimmed, lambda x: (x["x"] != "") & ~F.array_contains(away, x["n"]))
    return p.select(*columns, F.transform(lines, lambda x: F.struct(x["n"].alias("n"), x["x"].alias("x"), ends(x["x"]).alias("cut"))).alias("lines"))


def _but_last(words: Column) -> Column:
    return F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))


def _token_counts(p: DataFrame) -> DataFrame:
    """(t, n) of what stands between white space; parts of words at line ends and after them are left out."""

    def whole(line: Column, i: Column) -> Column:
        words = F.split(line["x"], SPACE)
        words = F.when(line["cut"], _but_last(words)).otherwise(words)
        return F.when((i > 0) & F.coalesce(F.get("lines", i - 1)["cut"], F.lit(False)), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)

    return _with_lines(p).select(F.explode(F.flatten(F.transform("lines", whole))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))


def _word_of(t: str) -> Column:
    return F.lower(F.btrim(F.col(t), F.lit(EDGE)))


def _word_counts(tokens: DataFrame) -> DataFrame:
    """(word, n) of whole words, and of what stands before a word's hyphen."""
    counted = tokens.select(_word_of("t").alias("word"), "n").where("word <> ''")
    inner = F.contains(F.expr("substring(word, 2, length(word) - 2)"), F.lit("-"))
    part = F.expr("substring(word, 1, locate('-', word, 2))")
    both = F.when(inner, F.array("word", part)).otherwise(F.array("word"))
    return counted.select(F.explode(both).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))


def _occurrences(p: DataFrame, sure: DataFrame) -> DataFrame:
    """(page_id, line_no, kind, a, word) of words that aren't surely right; kind 'word0' for the first of a line. sure: t as it stands between white space."""
    at = _with_lines(p, "page_id").select("page_id", F.explode("lines").alias("l"))
    words = F.split("l.x", SPACE)
    t = at.select("page_id", F.col("l.n").alias("line_no"), F.posexplode(F.when(F.col("l.cut"), _but_last(words)).otherwise(words)).alias("k", "t"))
    t = t.join(F.broadcast(sure), "t", "left_anti")  # at most FREQUENT words
    t = t.select("page_id", "line_no", "k", F.btrim("t", F.lit(EDGE)).alias("a"), _word_of("t").alias("word")).where("word <> ''")
    t = t.where(~F.col("a").rlike(r"(?U)^[\d\s.,:/()–-]+$"))
    return t.select("page_id", "line_no", F.when(F.col("k") == 0, "word0").otherwise("word").alias("kind"), "a", "word")


CANDIDATES = "page_id long, line_no int, kind string, a string, mark string, b string, next_line int, scan string, page_no int"


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Line ends with a hyphen, with the first word of the next line of text, and the first words of each page's text."""
    for batch in batches:
        rows = []
        for page, scan, no, content, away in batch[["page_id", "scan", "page_no", "content", "away"]].itertuples(index=False, name=None):
            lines = _text_lines(content, set(away if away is not None else ()))
            ends = [(k, end) for k, (_, x) in enumerate(lines) if (end := _hyphened(x))]
            first = next(((n, x) for n, x in lines if not FIGURES.fullmatch(x)), None)
            if first:
                rows.append((page, first[0], "first", (tokens_of(first[1]) or [""])[0], "", "", None, scan, no))
            for k, (part, mark) in ends:
                if FIGURES.fullmatch(lines[k][1]):
                    continue
                m, nxt = next(((n, x) for n, x in lines[k + 1 :] if not FIGURES.fullmatch(x)), (None, ""))
                rows.append((page, lines[k][0], "end", part, mark, (tokens_of(nxt) or [""])[0], m, scan, no))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in CANDIDATES.split(", ")]).astype({"next_line": "Int32"})


def repair(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, fixes). found: page_id, line_no, kind; fixes: page_id, line_no, a (as read), fix (as meant, or null), kind word or end."""
    p = _page_rows(pages)
    away = cut(furniture(p))
    lists = away.groupBy("page_id").agg(F.collect_list("line_no").alias("away"))  # four lines a page at most
    p = p.join(lists, "page_id", "left")
    tokens = cut(_token_counts(p))
    words = cut(_word_counts(tokens))
    total = words.agg(F.sum("n")).first()[0] or 0
    # a word that makes up a hundred-thousandth of the text is no accident
    usual = max(5.0, total * 1e-5)  # only tells which words the editor is fitted to
    frequent = {r.word: r.n for r in words.where(F.col("n") >= usual).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()}
    c = cut(p.mapInPandas(_candidates, CANDIDATES))

    first = c.where("kind = 'first'").select("scan", (F.col("page_no") - 1).alias("page_no"), F.col("a").alias("b_next"), F.col("page_id").alias("next_page"), F.col("line_no").alias("line_next"))
    first = first.groupBy("scan", "page_no").agg(F.min_by(F.struct("b_next", "next_page", "line_next"), "next_page").alias("f"))
    ends = c.where("kind = 'end'").join(first, ["scan", "page_no"], "left")
    ends = ends.withColumn("b", F.when(F.col("next_line").isNull(), F.coalesce("f.b_next", F.lit(""))).otherwise(F.col("b"))).withColumn("b_page", F.when(F.col("next_line").isNull(), F.col("f.next_page")).otherwise(F.col("page_id"))).withColumn("b_line", F.coalesce("next_line", "f.line_next"))
    ends = ends.select("page_id", "line_no", "a", "mark", "b", "b_page", "b_line").withColumn("joined", F.lower(F.concat("a", "b"))).withColumn("hyphened", F.lower(F.concat("a", F.lit("-"), "b"))).withColumn("before", F.lower(F.concat("a", F.lit("-"))))
    for k in ("joined", "hyphened", "before"):
        ends = ends.join(words.select(F.col("word").alias(k), F.col("n").alias(f"n_{k}")), k, "left")
    ends = cut(ends.na.fill(0, ["n_joined", "n_hyphened", "n_before"]))

    hyphens = ends.where("(n_joined > 0) <> (n_hyphened > 0) and b <> ''").orderBy(F.xxhash64("page_id", "line_no")).limit(HYPHEN_SAMPLE)
    hyphens = [(r.a, r.mark, r.b, r.n_joined > 0, (r.n_joined, r.n_hyphened, r.n_before)) for r in hyphens.select("a", "mark", "b", "n_joined", "n_hyphened", "n_before").collect()]
    marked = F.col("word").rlike(r"\p{L}[^\p{L}\p{N}\-‐'’]+\p{L}")  # however often they occur
    rare = words.where(((F.col("n") < usual) | marked) & (F.length("word") > 2) & F.col("word").rlike(r"\p{L}")).orderBy(F.xxhash64("word")).limit(RARE_SAMPLE)
    editor = editor_model([(r.word, r.n) for r in rare.collect()], frequent, hyphens)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            columns = b[["a", "mark", "b", "n_joined", "n_hyphened", "n_before"]].itertuples(index=False, name=None)
            cut_ = [editor.joins(a, mark, nxt, counts) for a, mark, nxt, *counts in columns]
            yield b[["page_id", "line_no", "a", "b", "b_page", "b_line", "joined", "n_joined"]].assign(is_split=cut_)

    parted = cut(ends.mapInPandas(told, "page_id long, line_no int, a string, b string, b_page long, b_line int, joined string, n_joined long, is_split boolean"))

    def proposals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, x, borne) for w in b["word"] for x, borne in ({w: False} | editor.proposals(w)).items()]
            yield pd.DataFrame(rows, columns=["word", "meant", "borne"])

    def judged(kinds: DataFrame) -> DataFrame:
        """(word, fix) of the misread ones: a far more frequent word by an edit that is borne out, or a still more frequent one by any edit."""
        counted = kinds.mapInPandas(proposals, "word string, meant string, borne boolean").join(words.select(F.col("word").alias("meant"), "n"), "meant", "left").na.fill(0, ["n"])
        other = F.when(F.col("meant") != F.col("word"), F.struct("n", "meant"))
        j = counted.groupBy("word").agg(F.max(F.when(F.col("meant") == F.col("word"), F.col("n"))).alias("n"), F.max(other).alias("any"), F.max(F.when(F.col("borne"), other)).alias("sure"))
        j = j.withColumn("n", F.coalesce("n", F.lit(0)))
        far = lambda c, ratio: F.coalesce(F.col(f"{c}.n") >= F.greatest(ratio * F.col("n"), F.lit(2.0)), F.lit(False))
        fix = F.when(far("any", ANY_RATIO), F.col("any.meant")).when(far("sure", RATIO), F.col("sure.meant"))
        return j.withColumn("fix", fix).where(F.col("fix").isNotNull() & ((F.length("word") > 2) | F.col("word").rlike(r"[^\p{L}]"))).select("word", "fix")

    # the most frequent words that are read rightly go to the workers, so that only the others are joined
    usually = words.orderBy(F.desc("n"), "word").limit(FREQUENT)
    right = cut(usually.select("word").join(judged(usually.select("word").repartition(pages.sparkSession.sparkContext.defaultParallelism)).select("word"), "word", "left_anti"))
    as_written = tokens.withColumn("word", _word_of("t")).join(right, "word", "left_semi").orderBy(F.desc("n"), "t").limit(FREQUENT).select("t")
    odd = cut(_occurrences(p, cut(as_written)))
    # a line's first word may be the rest of the last one before
    over = ends.select(F.col("b_page").alias("page_id"), F.col("b_line").alias("line_no")).distinct()
    alone = odd.where("kind = 'word0'").join(over, ["page_id", "line_no"], "left_anti").select(*odd.columns).unionByName(odd.where("kind = 'word'"))
    odd = alone.select("page_id", "line_no", "a", "word", F.lit(0).alias("head"), F.lit(None).cast("long").alias("b_page"), F.lit(None).cast("int").alias("b_line"))
    both = parted.where("is_split and b <> ''").select("page_id", "line_no", "a", F.col("joined").alias("word"), F.length("a").alias("head"), "b_page", "b_line")
    odd = odd.unionByName(both)
    misread = judged(odd.select("word").distinct())
    wrong = odd.join(misread, "word")
    # in a word over two lines the first letter that differs tells the line
    same = F.expr("aggregate(sequence(1, greatest(1, least(length(word), length(fix)))), 0, (s, i) -> if(s = i - 1 and substring(word, i, 1) = substring(fix, i, 1), i, s))")
    second = (F.col("head") > 0) & F.col("fix").isNotNull() & (same >= F.col("head"))
    wrong = cut(wrong.withColumn("p", F.when(second, F.col("b_page")).otherwise(F.col("page_id"))).withColumn("l", F.when(second, F.col("b_line")).otherwise(F.col("line_no"))).select("page_id", "line_no", "a", "fix", "head", "p", "l"))
    found = away.select("page_id", "line_no", F.lit("furniture").alias("kind"))
    found = found.unionByName(parted.where("is_split").select("page_id", "line_no", F.lit("split").alias("kind")))
    found = found.unionByName(wrong.select(F.col("p").alias("page_id"), F.col("l").alias("line_no"), F.lit("misread").alias("kind"))).distinct()
    fixes = wrong.select("page_id", "line_no", "a", "fix", F.when(F.col("head") > 0, "end").otherwise("word").alias("kind"))
    fixes = fixes.unionByName(parted.where("is_split and b <> ''").select("page_id", "line_no", "a", F.lower("joined").alias("fix"), F.lit("join").alias("kind")))
    return found, fixes


def paragraphs(pages: DataFrame) -> DataFrame:
    """scan, paragraph, text: the continuous text of each scan, without furniture, words put right and joined.

    Of pages scanned twice the surer one that isn't blank is read. A page with a null scan or page_no is a scan of its own. Paragraphs end at blank lines, and go on over a page's end if the text does.
    """
    once = Window.partitionBy("scan", "page_no").orderBy(_readable().desc(), F.desc_nulls_last("mean_conf"), F.desc_nulls_last("scanned_at"), "page_id")
    best = _keyed(pages).withColumn("_k", F.row_number().over(once)).where("_k = 1").drop("_k")
    found, fixes = repair(best)
    away = found.where("kind = 'furniture'").groupBy("page_id").agg(F.collect_list("line_no").alias("away"))
    right = fixes.groupBy("page_id").agg(F.collect_list(F.struct("line_no", "a", "fix", "kind")).alias("fixes"))
    p = _page_rows(best).join(away, "page_id", "left").join(right, "page_id", "left")

    def cased(read: str, meant: str) -> str:
        return meant.upper() if read.isupper() and len(read) > 1 else meant[:1].upper() + meant[1:] if read[:1].isupper() else meant

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for scan, no, content, gone, fixed in b[["scan", "page_no", "content", "away", "fixes"]].itertuples(index=False, name=None):
                gone = set(gone if gone is not None else ())
                by_line = defaultdict(list)
                for f in fixed if fixed is not None else ():
                    by_line[f["line_no"]].append(f)
                parts, text, drop, blank = [], "", False, False
                for n, x in enumerate(content.split("\n"), 1):
                    if n in gone:
                        continue
                    if not x.strip():
                        blank = bool(text) and not drop
                        continue
                    if blank:
                        parts.append(text)
                        text, blank = "", False
                    x = x.strip()
                    if drop:
                        x = x.partition(" ")[2]
                        drop = False
                    join = next((f for f in by_line[n] if f["kind"] == "join"), None)
                    end = next((f for f in by_line[n] if f["kind"] == "end" and f["fix"]), None)
                    for f in by_line[n]:
                        if f["kind"] == "word" and f["fix"]:
                            x = x.replace(f["a"], cased(f["a"], f["fix"]), 1)
                    if join:
                        x = x[: x.rfind(join["a"])] + cased(join["a"], (end or join)["fix"])
                        drop = True
                    text = f"{text} {x}".strip()
                if text:
                    parts.append(text)
                rows += [(scan, no, k, x, x[-1] in ".?!”:", x[:1].islower()) for k, x in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["scan", "page_no", "k", "text", "closed", "goes_on"])

    parts = cut(p.mapInPandas(build, "scan string, page_no int, k int, text string, closed boolean, goes_on boolean"))
    order = Window.partitionBy("scan").orderBy("page_no", "k")
    slim = parts.select("scan", "page_no", "k", "closed", "goes_on")
    starts = (F.col("k") > 0) | F.coalesce(F.lag("closed").over(order), F.lit(True)) & ~F.col("goes_on")
    slim = slim.withColumn("s", starts.cast("int")).withColumn("paragraph", F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("s", "closed", "goes_on")
    whole = parts.join(slim, ["scan", "page_no", "k"]).groupBy("scan", "paragraph").agg(F.array_sort(F.collect_list(F.struct("page_no", "k", "text"))).alias("t"))
    return whole.select("scan", F.col("paragraph").cast("int").alias("paragraph"), F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))
