"""Problem 8: texts that were cut off, and how often each source cuts.

Hazards. For each source and each of three measures (characters, UTF-8 bytes, characters before a mark such as `[...]`) the
discrete hazard of ending at length L is the number of texts of that length over the number of texts at least as long. Window
functions set it against the pooled hazard of the lengths around it; a Chernoff bound of the Poisson tail gives a p-value, and
Benjamini-Hochberg steps within each source and measure keep the false discoveries at ALPHA. Those lengths are limits.

Endings. How complete an ending looks is read from its last line: closed table rows, fences, links and tags, sentence marks,
and, for lines that need no mark (headings, list items, notes, signatures), how often the corpus ends a line of that kind after the
same last words. These counts cover all lines of all documents but the last ones.

A text is cut at a limit at which most endings are incomplete if its own is anything but an ended sentence. Texts that stop elsewhere (in
mid-transfer) form classes of their own, told apart by `evidence`: those with a mark in place of the rest, and those whose ending is
incomplete by itself. Dots at the end count only at a limit, in a paragraph of their own, or after a torn word: authors write them
too. Every copy of a cut text is cut.

Shuffled are counts and one slim row for each document, never texts. Nulls: a null or blank text isn't cut; a null source is
a source of its own (null). Repeated rows come out as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.session import cut

ALPHA = 0.01
#: Lengths on either side that a length is compared with.
AROUND = 60
#: An ending less likely than this to be an end is incomplete.
INCOMPLETE = 0.2
#: Share of all closing signatures or addresses from which one counts as recurring.
RECURS = 0.02

MARK = re.compile(r"(?:\n\n| )?(\[(?:\.\.\.|…)\]|\((?:\.\.\.|…)\)|\[(?:truncated|cut|cut off|more|continued|truncado|cortado)\]|<(?:truncated|snip)>|\.\.\.|…)\s*$", re.I)
#: Characters that the longest mark has at most, with what belongs to it.
MARK_CHARS = 24
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
ENDED = re.compile(r"[.!?。！？][\"'”’»)\]*_`~]*$")
SHORTENED = re.compile(r"(?:\b(?:e\.g|i\.e|p\.\s?ex|approx|aprox|cf|vs|fig|no|vol|pp)\.|\b(?:approx\.|aprox\.|em|by|in|v)\s*\d+\.)$", re.I)
KINDS = (
    ("list", re.compile(r"\s*(?:[-*+•]|\d+[.)])(?:\s|$)")),
    ("heading", re.compile(r"#{1,6}(?:\s|$)")),
    ("sign", re.compile(r"[—–]\s*\S|[—–]$")),
    ("url", re.compile(r"(?:https?|ftp)[:/]|https?$|www\.")),
)


def _kind(line: str) -> str:
    return next((k for k, p in KINDS if p.match(line)), "note")


def _shape(url: str) -> str:
    return re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", "a", url.strip()))


def _lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip()]


def _plain(line: str) -> bool:
    return _kind(line) == "note" and line.lstrip()[:1] not in "|`<![>" and not re.fullmatch(r"\s*[-*_=]{2,}\s*", line)


def ending(text: str) -> tuple[str, float | None, str, str]:
    """(kind, how likely the last line is whole or None if the counts must tell, the last word but one, the last word)."""
    lines = _lines(text)
    if not lines:
        return "blank", 1.0, "", ""
    last = lines[-1].rstrip()
    body = last.strip()
    words = [w.lower() for w in WORD.findall(body)]
    w1, w2 = (["", "", *words])[-2:]
    if sum(x.lstrip().startswith("```") for x in lines) % 2:
        return "code", 0.0, w1, w2
    if body.startswith("```"):
        return "code", 1.0 if body == "```" else 0.0, w1, w2
    if body.startswith("|"):
        rows = []
        for x in reversed(lines):
            if not x.lstrip().startswith("|"):
                break
            rows.append(x.strip())
        whole = body.endswith("|") and len(body) > 1 and body.count("|") == rows[-1].count("|") and len(rows) > 2
        return "table", 0.97 if whole else 0.0, w1, w2
    if re.fullmatch(r"(?:-{3,}|\*{3,}|_{3,}|={3,})", body):
        return "rule", 0.97, w1, w2
    if re.fullmatch(r"[-*_=#+`>!\[(<]+", body):
        return "rule", 0.0, w1, w2
    if len(lines) > 1 and (re.fullmatch(r"\[[^\]]*\]", body) or body.startswith("<!--")):
        before = ending("\n".join(lines[:-1]))  # a remark stands after a whole text or in place of a missing rest
        if before[1] == 0.0 and before[0] in ("prose", "note"):
            return "remark", 0.0, w1, w2
    if re.fullmatch(r"!?\[[^\]]*\]\([^()\s]*\)", body) or re.fullmatch(r"\[[^\]]*\]", body):
        return "link", 0.97, w1, w2
    if body.startswith("![") or re.match(r"\[(?![\d:^])[^\]]*$", body):
        return "link", 0.0, w1, w2
    if body.startswith("<"):
        return "tag", 0.97 if body.endswith(">") and body.count("<") == body.count(">") and len(re.findall(r"<\w", body)) <= len(re.findall(r"</|/>|<br", body)) else 0.0, w1, w2
    kind = _kind(body)
    if kind == "url" and " " not in body:
        return "url", None, "", _shape(body)
    if ENDED.search(body) and not (kind == "list" and re.fullmatch(r"\d+[.)]", body)):
        if body.count("(") > body.count(")") or SHORTENED.search(body):
            return "prose", 0.0, w1, w2
        return "prose", 1.0, w1, w2
    if kind == "list" and re.fullmatch(r"(?:[-*+•]|\d+[.)])", body):
        return kind, 0.0, w1, w2
    if body[-1] in ",;:([{“‘«-–—/&=":
        return kind, 0.0, w1, w2
    if kind == "note":
        others = [x for x in lines[:-1] if _plain(x)]
        ended = sum(bool(ENDED.search(x.rstrip())) for x in others)
        if others and 2 * ended >= len(others):
            return "prose", 0.0, w1, w2
    if body.count("(") > body.count(")") or body.count("[") > body.count("]") or body.count("“") > body.count("”"):
        return kind, 0.0, w1, w2
    return kind, None, w1, w2


def _marked(text: str) -> tuple[str, str, str]:
    """(what stands before a mark at the end, the kind of the mark or nothing, the mark)"""
    end = len(text.rstrip())
    tail = max(0, end - MARK_CHARS)
    m = MARK.search(text[tail:end])
    if not m:
        return text, "", ""
    kind = "own" if m.group(0).startswith("\n\n") else "dots" if m.group(1) in ("...", "…") else "bracket"
    return text[: tail + m.start()], kind, m.group(1)


def _count_lines(lines: list[str], words_of_any: Counter, seen: Counter, ends: Counter) -> None:
    """Words of the lines, and those of lines that need no mark at their end: by kind, alone and with the word before."""
    fenced = False
    for line in lines:
        s = line.strip()
        if s.startswith("```"):
            fenced = not fenced
            continue
        words = WORD.findall(s.lower())
        words_of_any.update(words)
        if fenced:
            continue
        kind = _kind(s)
        if kind == "url" and " " not in s:
            seen["url", None, _shape(s)] += 1
            ends["url", None, _shape(s)] += 1
        elif words and not ENDED.search(s) and (kind != "note" or _plain(line)):
            seen.update([(kind, None, w) for w in words])
            seen.update([(kind, v, w) for v, w in zip(["", *words], words)])
            ends[kind, None, words[-1]] += 1
            ends[kind, words[-2] if len(words) > 1 else "", words[-1]] += 1


FEATURES = (("chars", pa.int64()), ("bytes", pa.int64()), ("before_mark", pa.int64()), ("mark", pa.string()), ("kind", pa.string()), ("whole", pa.float64()), ("w1", pa.string()), ("w2", pa.string()), ("torn", pa.string()))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch a slim row for each document, and the counts of its lines but the last: (kind, w1, w2), seen and ending a line.

    Counts have no document. w1 is null for a word by itself; kind '*' counts words of any line.
    """
    for b in batches:
        texts = b.column("text").to_pylist()
        rows, seen, ends, any_word = [], Counter(), Counter(), Counter()
        for text in texts:
            base, mark, _ = _marked(text)
            kind, whole, w1, w2 = ending(base)
            torn = (WORD.findall(base[-80:]) or [""])[-1].lower() if mark else ""
            rows.append((len(text), len(text.encode("utf-8", "surrogatepass")), len(base) if mark else None, mark, kind, whole, w1, w2, torn))
            _count_lines(_lines(base)[:-1], any_word, seen, ends)
        columns = list(zip(*rows)) or [()] * len(FEATURES)
        names = ["doc", "source", "copy", *[n for n, _ in FEATURES], "seen", "ended"]
        none = lambda n, t: pa.nulls(n, t)
        n = len(rows)
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("source"), b.column("copy"), *[pa.array(c, t) for c, (_, t) in zip(columns, FEATURES)], none(n, pa.int64()), none(n, pa.int64())], names=names)
        counts = [(*k, n, ends.get(k, 0)) for k, n in seen.items()] + [("*", None, w, n, 0) for w, n in any_word.items()]
        n = len(counts)
        kind, w1, w2, often, ended = zip(*counts) if counts else ((),) * 5
        given = {"kind": pa.array(kind, pa.string()), "w1": pa.array(w1, pa.string()), "w2": pa.array(w2, pa.string())}
        yield pa.RecordBatch.from_arrays([none(n, b.schema.field(c).type) for c in ("doc", "source", "copy")] + [given.get(f, none(n, t)) for f, t in FEATURES] + [pa.array(often, pa.int64()), pa.array(ended, pa.int64())], names=names)


def limits(lengths: DataFrame, alpha: float = ALPHA, around: int = AROUND) -> DataFrame:
    """Lengths at which a source ends texts far more often than at those around: source, measure, length, n, expected, p.

    `lengths` has source, measure, length; it is counted first, so a large source is no large window.
    """
    n = lengths.where("length is not null").groupBy("source", "measure", "length").agg(F.count(F.lit(1)).alias("n"))
    longer = Window.partitionBy("source", "measure").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = n.withColumn("at_risk", F.sum("n").over(longer))
    near = Window.partitionBy("source", "measure").orderBy("length").rangeBetween(-around, around)
    # the hazard around: texts that ended at other lengths nearby, over the lengths nearby times those at risk here
    h = h.withColumn("_others", F.sum("n").over(near) - F.col("n")).withColumn("_risk", F.avg("at_risk").over(near))
    h = h.withColumn("expected", F.col("at_risk") * (F.col("_others") + 0.5) / (F.lit(2.0 * around) * F.greatest("_risk", F.lit(1))))
    h = h.withColumn("p", F.when(F.col("n") > F.col("expected"), F.exp(F.col("n") - F.col("expected") - F.col("n") * F.log(F.col("n") / F.col("expected")))).otherwise(1.0))
    by_p = Window.partitionBy("source", "measure").orderBy("p", "length")
    whole = Window.partitionBy("source", "measure")
    h = h.withColumn("_k", F.row_number().over(by_p)).withColumn("_m", F.count(F.lit(1)).over(whole))
    h = h.withColumn("_last", F.max(F.when(F.col("p") <= F.col("_k") * alpha / F.col("_m"), F.col("_k"))).over(whole))
    return h.where("_k <= _last").select("source", "measure", "length", "n", "expected", "p")


#: What shows that a text was cut, the strongest first.
EVIDENCE = ("limit", "mark", "ending", "copy")


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", alpha: float = ALPHA) -> DataFrame:
    """doc_id, source, is_cut, evidence, at_limit (the measure of the limit it ends at, or null), kind of ending, likelihood that the ending is whole.

    evidence: 'limit' for an incomplete ending at a significant length; 'mark' for a mark in place of the rest and 'ending' for an ending that
    can't be one, both at no such length; 'copy' for a repeat of a cut text; null for whole ones.
    """
    slim = docs.select(F.col(doc_id).alias("doc"), F.col(source).alias("source"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    types = {c: slim.schema[c].dataType.simpleString() for c in ("doc", "source")}
    schema = f"doc {types['doc']}, source {types['source']}, copy string, chars long, bytes long, before_mark long, mark string, kind string, whole double, w1 string, w2 string, torn string, seen long, ended long"
    read = cut(slim.withColumn("copy", F.md5("text")).mapInArrow(_read, schema))  # the texts are read once
    f = read.where("seen is null").drop("seen", "ended")
    counts = cut(read.where("seen is not null").groupBy("kind", "w1", "w2").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended")))

    measures = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in ("chars", "bytes", "before_mark")]))
    # a text that is repeated is one text: repeats have the same length anyway
    long = f.select("source", "copy", "chars", "bytes", "before_mark").distinct().select("source", measures.alias("m")).select("source", "m.measure", "m.length")
    found = limits(long.where("length > 0"), alpha)

    one = counts.where("w1 is null and kind <> '*'").select("kind", "w2", F.col("seen").alias("n1"), F.col("ended").alias("e1"))
    two = counts.where("w1 is not null").select("kind", "w1", "w2", F.col("seen").alias("n2"), F.col("ended").alias("e2"))
    known = counts.where("kind = '*'").select(F.col("w2").alias("torn"), F.col("seen").alias("torn_seen"))
    open_ = f.where("whole is null").select("kind", "w1", "w2").distinct()
    p1 = F.coalesce(F.col("e1") / F.col("n1"), F.lit(0.0)) * F.when(F.coalesce("n1", F.lit(0)) >= 2, 1.0).otherwise(0.0)
    p2 = (F.coalesce("e2", F.lit(0)) + 2 * p1) / (F.coalesce("n2", F.lit(0)) + 2)
    # signatures and addresses stand at the end only: there the endings of all documents tell, of which whole ones recur
    closing = f.where("whole is null and kind in ('sign', 'url')").groupBy("kind", "w1", "w2").agg(F.count_distinct("copy").alias("n"))
    of_kind = closing.groupBy("kind").agg(F.sum("n").alias("of_kind"))  # two rows
    closing = closing.join(of_kind, "kind").select("kind", "w1", "w2", (F.col("n") / F.col("of_kind")).alias("recurs"))
    words = known.select(F.col("torn").alias("w2"), F.col("torn_seen").alias("w2_seen"))
    told = open_.join(two, ["kind", "w1", "w2"], "left").join(one, ["kind", "w2"], "left").join(closing, ["kind", "w1", "w2"], "left").join(words, "w2", "left")
    often = F.coalesce(F.col("recurs") >= RECURS, F.lit(False))
    sign = F.when(often, 1.0).when(F.col("w2_seen") >= 2, 0.5).otherwise(0.0)
    url = F.when(often, 1.0).otherwise(p1)
    told = told.select("kind", "w1", "w2", F.least(F.when(F.col("kind") == "url", url).when(F.col("kind") == "sign", F.greatest(sign, p2)).otherwise(p2), F.lit(0.97)).alias("told"))
    f = f.join(told, ["kind", "w1", "w2"], "left").join(known, "torn", "left")
    f = f.withColumn("whole", F.coalesce("whole", "told", F.lit(0.0)))

    # a limit cuts texts if most of the endings there are incomplete; else texts merely happen to have that length
    open_ends = f.select("source", "whole", "mark", measures.alias("m")).select("source", F.col("m.measure").alias("measure"), F.col("m.length").alias("length"), ((F.col("whole") < 0.5) | (F.col("mark") == "bracket")).cast("double").alias("open"))
    share = open_ends.where("length is not null").groupBy("source", "measure", "length").agg(F.avg("open").alias("open"))
    found = cut(found.join(share, [found.source.eqNullSafe(share.source), found.measure == share.measure, found.length == share.length]).select(found.source, found.measure, found.length, "open").where("open >= 0.5"))
    at = None
    for m in ("chars", "bytes", "before_mark"):
        one_m = found.where(F.col("measure") == m).select(F.col("source").alias("_s"), F.col("length").alias("_l"), F.lit(m).alias(f"at_{m}"))
        f = f.join(one_m, F.col("source").eqNullSafe(F.col("_s")) & (F.col(m) == F.col("_l")), "left").drop("_s", "_l")
    at = F.coalesce("at_before_mark", "at_chars", "at_bytes")
    torn = (F.col("torn") != "") & (F.coalesce("torn_seen", F.lit(0)) < 2)
    no, yes = F.lit(None).cast("string"), lambda what, c: F.when(c, what)
    limit = F.col("whole") < 1.0
    own = (
        F.when(F.col("kind") == "blank", no)
        .when(F.col("mark").isin("bracket", "own"), F.when(at.isNotNull(), "limit").otherwise("mark"))
        .when(F.col("mark") == "dots", F.when(F.col("at_before_mark").isNotNull() | F.col("at_chars").isNotNull(), "limit").when(torn, "mark"))
        .when(at.isNotNull(), yes("limit", limit))
        .otherwise(yes("ending", F.col("whole") < INCOMPLETE))
    )
    f = cut(f.select("doc", "source", "copy", "kind", "whole", at.alias("at_limit"), own.alias("own")))
    copies = f.where("own is not null").select("copy").distinct().withColumn("copy_cut", F.lit(True))
    f = f.join(copies, "copy", "left").withColumn("evidence", F.coalesce("own", F.when(F.col("copy_cut"), "copy")))
    return f.select(F.col("doc").alias(doc_id), F.col("source").alias(source), F.col("evidence").isNotNull().alias("is_cut"), "evidence", "at_limit", "kind", "whole")


def rates(detected: DataFrame, source: str = "source") -> DataFrame:
    """Documents, cut documents and their rate for each source; of the cut ones how many show which evidence."""
    g = detected.groupBy(source).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("is_cut").alias("n_cut"), *[F.count_if(F.coalesce(F.col("evidence") == e, F.lit(False))).alias(f"n_by_{e}") for e in EVIDENCE])
    return g.withColumn("cut_rate", F.col("n_cut") / F.col("n_docs")).withColumn("limit_rate", F.col("n_by_limit") / F.col("n_docs"))
