"""Problem 5: link the spellings of one person or organisation.

1. Spellings are counted, then read into forms: folded family name and given names, or the words of an organisation. Where
   nothing marks the family name, the corpus tells which word is a given name (those that many families share).
2. Metric-space partitioning. The distance of two names is the sum of the edit distances of Damerau and Levenshtein of their words, family
   name and given names alike; it is a metric on names of as many words. Names within radius 1 differ in one word, by one edit, so the
   words are partitioned. The pivots are strings of one repeated letter, long enough that the distance to a pivot is a word's length less the
   count of that letter; a word's cell is the vector of its distances, that is its letters in order. By the triangle inequality a word
   within the radius has a vector that differs in at most one letter more or less on each side, so each word is put into its own cell
   and replicated into the cells on its boundary, one for each letter left out. Within a cell the metric itself is computed. Any pair within
   the radius meets in some cell; cells hold words of the same letters only, however many names there are. A radius of 0 switches it off.
3. What a name may be short for. Each form announces all its shorter forms (initials, later names left out) under keys, with their cost;
   of each key only the cheapest and most frequent form is kept, so a common surname costs no pairs. A form asks under its own key, and under those
   with one word misspelt or a nickname put right. Each form is attached to the cheapest answer; the trees are the entities. So an
   initial that fits two people doesn't merge them.
4. Nicknames are learned: where records of one title and year have, at the same place among the authors, the same family name with two
   different given names, and that in two publications or more, the rarer name is taken for a nickname of the other.

Only distinct spellings are shuffled after the first count, and (title, place, form) once. Nulls: records without authors have no spellings;
blank ones are dropped; records without a title teach no nicknames. Repeated rows add to the counts. An empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.components import components
from quillmill.session import cut

#: Between names: the word "and" between white space and outside braces (nested once).
SEPARATOR = r"(?U)\s+and\s+(?![^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\})"
#: Families that must share a word before it counts as a common given name.
COMMON = 3

# Letters that don't decompose.
LETTERS = {"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}
LATEX = {"aa": "a", "o": "o", "l": "l", "ss": "ss", "ae": "ae", "oe": "oe", "i": "i", "j": "j"}
PARTICLES = {"van", "der", "den", "von", "zu", "zur", "de", "da", "do", "dos", "das", "del", "di", "du", "la", "le", "ten", "ter"}
SKIPPED = {"the", "of", "for", "and", "de", "da", "do", "e", "in", "on", "at"}
#: How much more often a word must occur for another that several people bear to be a misspelling of it.
RATIO = 8
#: Publications that must show a nickname.
SHOWN = 2
#: Given names of which any may be an initial in a shorter form; of those after them either all or none.
FREE = 4


def fold(s: str) -> str:
    """Lower case without accents, LaTeX accents resolved, braces dropped."""
    s = re.sub(r"\{?\\(aa|AA|ss|ae|AE|oe|OE|[oOlLij])(?![A-Za-z])\s*(?:\{\})?\}?", lambda m: LATEX[m.group(1).lower()], s)
    s = re.sub(r"\{?\\(?:[`'^\"~=.]|[vcuHkrdbt](?![A-Za-z]))\s*\{?([A-Za-z])\}?\}?", r"\1", s)
    s = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
    return "".join(LETTERS.get(c, c) for c in s).replace("{", "").replace("}", "")


def edit1(a: str, b: str) -> bool:
    """Whether the distance of Damerau and Levenshtein is at most 1."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def read(name: str) -> tuple[str, list[str], list[str]]:
    """(kind, family, given) of a spelling; kind 'open' has its words in `given` until the corpus tells the order."""
    s = name.strip()
    if s.startswith("{") and s.endswith("}") and " " in s:
        body = re.sub(r"\([^)]*\)", " ", s)
        return "org", [], [w for w in re.findall(r"[^\W_]+\.?", fold(body)) if w.rstrip(".") not in SKIPPED]
    s = re.sub(r"\.(?=[^\W\d_])", ". ", s)
    given = lambda t: [w for x in t.split() for w in ([x.replace(".", "")] if "-" in x else x.split(".")) if w and w not in PARTICLES]
    if "," in s:
        family, _, rest = s.partition(",")
        rest = rest.rpartition(",")[2]
        caps = _initials(rest.strip(), family)
        return "person", fold(family).split(), caps or given(fold(rest))
    raw = s.split()
    if len(raw) > 1 and (caps := _initials(raw[-1], raw[0])) and not raw[-1].endswith("."):
        return "person", fold(" ".join(raw[:-1])).split(), caps
    f = fold(s).split()
    if len(f) == 1:
        return "person", f, []
    at = next((i for i, w in enumerate(f) if w in PARTICLES), None)
    if at:
        return "person", f[at:], given(" ".join(f[:at]))
    if "." in f[0] and len(f) > 1:
        n = next((i for i, w in enumerate(f) if "." not in w), len(f) - 1)
        return "person", f[n:], given(" ".join(f[:n]))
    dots = [i for i, w in enumerate(f) if "." in w]
    if dots and at is None:
        return ("person", f[:1], given(" ".join(f[1:]))) if dots[-1] == len(f) - 1 else ("person", f[-1:], given(" ".join(f[:-1])))
    if at == 0:
        n = next((i for i, w in enumerate(f) if w not in PARTICLES), len(f) - 1)
        return "person", f[: n + 1], given(" ".join(f[n + 1 :]))
    return "open", [], f


def _initials(s: str, beside: str) -> list[str]:
    """Initials written together in capitals, as KO or J-L; beside a name all in capitals, IVO and BEN are names."""
    if beside.isupper() and len(s) > 2 and "-" not in s:
        return []
    if s.isupper() and re.fullmatch(r"(?:[^\W\d_](?:-[^\W\d_])*){1,3}", s):
        return re.findall(r"[^\W\d_](?:-[^\W\d_])*", fold(s))
    return []


def _initial(t: str) -> bool:
    return len(t.replace("-", "")) <= (2 if "-" in t else 1)


def _short(word: str) -> list[str]:
    """The initials that a given name can be shortened to."""
    if _initial(word):
        return [word[0]] if "-" in word else []
    parts = word.split("-")
    return [word[0]] if len(parts) == 1 else ["-".join(p[0] for p in parts if p), word[0]]


def shorter(words: list[str]) -> dict[str, int]:
    """What a person's given names can be written as, with the cost: one for each initial and each name left out at the end."""
    out: dict[str, int] = {}
    free = [[(w, 0), *((i, 1) for i in _short(w))] for w in words[:FREE]]
    for n in range(1, min(FREE, len(words)) + 1):
        for some in product(*free[:n]):
            key, cost = " ".join(w for w, _ in some), sum(c for _, c in some) + len(words) - n
            out[key] = min(cost, out.get(key, cost))
    for n in range(FREE + 1, len(words) + 1):
        rest = words[FREE:n]
        tails = [(rest, 0), ([(_short(w) or [w])[0] for w in rest], sum(bool(_short(w)) for w in rest))]
        for some in product(*free):
            for tail, c in tails:
                key, cost = " ".join([*(w for w, _ in some), *tail]), sum(x for _, x in some) + c + len(words) - n
                out[key] = min(cost, out.get(key, cost))
    return out


def _word(a: str, b: str) -> int | None:
    if a == b or a.rstrip(".") == b.rstrip("."):
        return 0
    for x, y in ((a, b), (b, a)):
        if x.endswith(".") and x[0] == y[0]:
            it = iter(y)
            if all(c in it for c in x[:-1]):
                return 1
    return 3 if min(len(a), len(b)) > 4 and not a.endswith(".") and not b.endswith(".") and edit1(a, b) else None


def same_organisation(a: list[str], b: list[str], radius: int = 1) -> int | None:
    """The cost of taking two organisations for one: their words match one to one, in any order, at most one of them misspelt."""
    if len(a) != len(b):
        return None
    left, cost, typos = list(b), 0, 0
    for x in a:
        best = min(((c, k) for k, y in enumerate(left) if (c := _word(x, y)) is not None), default=None)
        if best is None:
            return None
        cost += best[0]
        typos += best[0] == 3
        left.pop(best[1])
    return cost if typos <= radius else None


def says(kind: str, words: list[str], common: set[str]) -> float:
    """How much a form says: known names more than unknown ones, those more than initials."""
    if kind == "org":
        return float(sum(1 if w.endswith(".") else 2 for w in words))
    return sum(1.0 if _initial(w) else 2.0 if w in common else 1.6 for w in words)


def spellings(entries: DataFrame, fields: str = "fields") -> DataFrame:
    """(name, n): the distinct spellings in author fields and how often each occurs."""
    hits = F.filter(F.map_entries(fields), lambda x: (F.lower(F.trim(x["key"])) == "author") & x["value"].isNotNull())
    names = entries.select(F.explode(F.flatten(F.transform(hits, lambda x: F.split(x["value"], SEPARATOR)))).alias("name"))
    names = names.select(F.regexp_replace("name", r"(?U)^\s+|\s+$", "").alias("name")).where("name <> ''")
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for role, word in b[["role", "word"]].itertuples(index=False, name=None):
            s = "".join(sorted(word))
            rows += [(role, word, role + x) for x in {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}]
        yield pd.DataFrame(rows, columns=["role", "word", "cell"])


def near_words(words: DataFrame) -> DataFrame:
    """(role, a, b), a < b: distinct words of one role at distance 1. words has role, word, each pair once."""
    cells = words.select("role", "word").mapInPandas(_cells, "role string, word string, cell string").select("role", F.col("word").alias("a"), F.xxhash64("cell").alias("cell"))
    met = cells.join(cells.select("cell", F.col("role").alias("_r"), F.col("a").alias("b")), "cell").where("a < b and role = _r").select("role", "a", "b").distinct()

    def radius(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[edit1(x, y) for x, y in zip(b["a"], b["b"])]]

    return met.mapInPandas(radius, "role string, a string, b string")


def nicknames(authors: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(word, meant): given names that stand for another. authors: publication, place, family, word, g (families that the word occurs with), of records."""
    full = authors.where("length(word) > 1").select("publication", "place", "family", "word", "g").distinct()
    best = full.groupBy("publication", "place", "family").agg(F.max(F.struct("g", "word")).alias("m"), F.count_distinct("word").alias("k")).where("k > 1")
    pairs = full.join(best, ["publication", "place", "family"]).where("word <> m.word").select("publication", "word", F.col("m.word").alias("meant"))
    return pairs.groupBy("word", "meant").agg(F.count_distinct("publication").alias("n")).where(F.col("n") >= shown).select("word", "meant")


ASKED = "form_id long, says double, n long, kind string, words array<string>, side string, cost int, key string"


def _ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each form announces (side 'key') and asks for (side 'ask')."""
    for b in batches:
        rows = []
        for form, n, kind, family, words, said, lexicon in b.itertuples(index=False, name=None):
            words, known = list(words), {(x["role"], x["word"]): x for x in (lexicon if lexicon is not None else ())}
            near = lambda role, w: [] if (role, w) not in known else list(known[role, w]["near"])
            own = (form, said, n, kind, words)
            if kind == "org":
                count = lambda w: known["org", w]["g"] if ("org", w) in known else 0
                pattern = "".join(sorted(w[0] for w in words))

                def keys(ws: list[str]) -> list[str]:
                    whole = sorted((w for w in ws if not w.endswith(".")), key=lambda w: (count(w), w))
                    return [f"{pattern}|{w}" for w in whole[:2]] or [f"{pattern}|"]

                rows += [(*own, "key", 0, k) for k in keys(words)] + [(*own, "ask", 0, k) for k in keys(words)]
                for k, w in enumerate(words):
                    rows += [(*own, "ask", 3, x) for v in near("org", w) for x in keys([*words[:k], v, *words[k + 1 :]])]
                continue
            if not words:
                rows += [(*own, side, 0, f"{family}||") for side in ("key", "ask")] + [(*own, "ask", 3, f"{f}||") for f in near("family", family)]
                continue
            rows += [(*own, "key", c, f"{family}|{k}") for k, c in shorter(words).items()]
            asked = {f"{family}|{' '.join(words)}": 0}

            def ask(f: str, ws: list[str], cost: int) -> None:
                k = f"{f}|{' '.join(ws)}"
                asked[k] = min(cost, asked.get(k, cost))

            meant = [[] if ("given", w) not in known else list(known["given", w]["meant"]) for w in words]
            variants = [(words, 0)] + [([*words[:k], v, *words[k + 1 :]], 1) for k in range(len(words)) for v in meant[k]]
            for ws, c in variants:
                ask(family, ws, c)
                if not all(map(_initial, words)):  # initials are too little to tell a misspelt family by
                    for f in near("family", family):
                        ask(f, ws, c + 3)
            for k, w in enumerate(words):
                for v in near("given", w):
                    ask(family, [*words[:k], v, *words[k + 1 :]], 3)
            rows += [(*own, "ask", c, k) for k, c in asked.items()]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ASKED.split(", ")]).astype({"form_id": "int64", "n": "int64", "cost": "int32"})


def _forms(entries: DataFrame, fields: str) -> tuple[DataFrame, DataFrame]:
    """(name, n, kind, family, words) of each spelling, (word, g): given names and how many families have them."""
    names = cut(spellings(entries, fields))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = [read(x) for x in b["name"]]
            yield b.assign(kind=[x[0] for x in r], family=[" ".join(w for w in x[1] if w not in PARTICLES) or " ".join(x[1]) for x in r], words=[x[2] for x in r])

    forms = cut(names.mapInPandas(first, "name string, n long, kind string, family string, words array<string>"))
    givens = cut(forms.where("kind = 'person'").select("family", F.explode("words").alias("word")).where("length(word) > 1").groupBy("word").agg(F.count_distinct("family").alias("g")))
    ends = forms.where("kind = 'open'").select("name", F.get("words", F.lit(0)).alias("w1"), F.get("words", F.size("words") - 1).alias("w2"))
    for w, g in (("w1", "g1"), ("w2", "g2")):
        ends = ends.join(givens.select(F.col("word").alias(w), F.col("g").alias(g)), w, "left")
    told = forms.join(ends.select("name", (F.coalesce("g1", F.lit(0)) >= F.coalesce("g2", F.lit(0))).alias("given_first")), "name", "left")
    n = F.size("words")
    opened = F.col("kind") == "open"
    family = F.when(opened & F.col("given_first"), F.get("words", n - 1)).when(opened, F.get("words", F.lit(0))).otherwise(F.col("family"))
    words = F.when(opened & F.col("given_first"), F.slice("words", 1, F.greatest(n - 1, F.lit(0)))).when(opened, F.slice("words", 2, F.greatest(n - 1, F.lit(0)))).when(F.col("kind") == "org", F.sort_array("words")).otherwise(F.col("words"))
    return told.select("name", "n", F.when(opened, "person").otherwise(F.col("kind")).alias("kind"), F.coalesce(family, F.lit("")).alias("family"), words.alias("words")), givens


def entities(entries: DataFrame, fields: str = "fields", radius: int = 1, shown: int = SHOWN) -> DataFrame:
    """(name, n, entity) of every spelling. radius: edits by which names of one person may differ, 0 or 1; shown: publications that must show a nickname."""
    if radius not in (0, 1):
        raise ValueError("radius must be 0 or 1: of two edits in a name that is all there is to tell people apart by")
    told, givens = _forms(entries, fields)
    spelt = cut(told.withColumn("form_id", F.xxhash64("kind", "family", F.array_join("words", " "))))
    forms = spelt.groupBy("form_id").agg(F.sum("n").alias("n"), F.first("kind").alias("kind"), F.first("family").alias("family"), F.first("words").alias("words"))

    # the words of all forms: how common they are, what is near, what they mean
    parts = F.when(F.col("kind") == "org", F.transform("words", lambda w: F.struct(F.lit("org").alias("role"), w.alias("word")))).otherwise(
        F.concat(F.array(F.struct(F.lit("family").alias("role"), F.col("family").alias("word"))), F.transform("words", lambda w: F.struct(F.lit("given").alias("role"), w.alias("word"))))
    )
    exploded = forms.select("form_id", "n", "family", F.get("words", F.lit(0)).alias("w1"), F.explode(F.array_distinct(parts)).alias("p")).select("form_id", "n", "family", "w1", "p.role", "p.word")
    common = givens.where(F.col("g") >= COMMON)
    bearers = exploded.where("role = 'family'").join(common.select(F.col("word").alias("w1")), "w1", "left_semi").groupBy("word").agg(F.count_distinct("w1").alias("bearers"))
    lexicon = exploded.where("word <> ''").groupBy("role", "word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"))
    lexicon = lexicon.join(givens.withColumn("role", F.lit("given")), ["role", "word"], "left").join(bearers.withColumn("role", F.lit("family")), ["role", "word"], "left")
    # how sure it is that a word is itself and no misspelling: common given names, families of several people
    settled = F.when(F.col("role") == "given", F.coalesce("g", F.lit(0)) >= COMMON).when(F.col("role") == "family", F.coalesce("bearers", F.lit(0)) > 1).otherwise(F.lit(False))
    lexicon = cut(lexicon.select("role", "word", "n", F.coalesce("g", "forms").alias("g"), settled.alias("settled")))
    spell = lexicon.where("length(word) > 1 and word not like '%.'") if radius else lexicon.limit(0)
    near = near_words(spell)
    near = near.unionByName(near.select("role", F.col("b").alias("a"), F.col("a").alias("b")))
    # a settled word is no misspelling, unless another is so much more frequent: misspellings of common names recur
    a, b = (lexicon.select("role", F.col("word").alias(x), F.col("n").alias(f"n_{x}"), F.col("settled").alias(f"settled_{x}")) for x in "ab")
    near = near.join(a, ["role", "a"]).join(b, ["role", "b"]).where(~F.col("settled_a") | (F.col("n_b") >= RATIO * F.col("n_a"))).select("role", "a", "b")
    near = near.groupBy("role", F.col("a").alias("word")).agg(F.collect_list("b").alias("near"))

    title = F.filter(F.map_entries(fields), lambda x: F.lower(F.trim(x["key"])).isin("title", "year") & x["value"].isNotNull())
    folded = F.transform(title, lambda x: F.struct(F.lower(F.trim(x["key"])).alias("k"), F.lower(F.regexp_replace(x["value"], r"[^\p{L}\p{N}]+", "")).alias("v")))
    hits = F.filter(F.map_entries(fields), lambda x: (F.lower(F.trim(x["key"])) == "author") & x["value"].isNotNull())
    listed = entries.select(F.xxhash64(F.to_json(F.array_sort(folded))).alias("publication"), F.size(folded).alias("_t"), F.posexplode(F.flatten(F.transform(hits, lambda x: F.split(x["value"], SEPARATOR)))).alias("place", "name")).where("_t > 1")
    listed = listed.select("publication", "place", F.regexp_replace("name", r"(?U)^\s+|\s+$", "").alias("name")).distinct()
    people = spelt.where("kind = 'person' and size(words) > 0").select("name", "family", F.get("words", F.lit(0)).alias("word")).where("length(word) > 1")
    taught = nicknames(listed.join(people, "name").join(givens, "word"), shown)
    # a nickname isn't a misspelling of what it means; that is for the metric
    taught = cut(taught).mapInPandas(lambda it: (b.loc[[not edit1(x, y) for x, y in zip(b["word"], b["meant"])]] for b in it), "word string, meant string")
    taught = taught.groupBy("word").agg(F.collect_list("meant").alias("meant")).withColumn("role", F.lit("given"))

    none = F.array().cast("array<string>")
    lexicon = lexicon.join(near, ["role", "word"], "left").join(taught, ["role", "word"], "left")
    of_form = exploded.select("form_id", "role", "word").join(lexicon, ["role", "word"]).groupBy("form_id").agg(F.collect_list(F.struct("role", "word", "g", "settled", F.coalesce("near", none).alias("near"), F.coalesce("meant", none).alias("meant"))).alias("lexicon"))

    def said(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = [{x["word"] for x in (le if le is not None else ()) if x["role"] == "given" and x["settled"]} for le in b["lexicon"]]
            yield b.assign(says=[says(k, list(w), c) for k, w, c in zip(b["kind"], b["words"], known)])

    table = forms.join(of_form, "form_id", "left")
    lex_type = table.schema["lexicon"].dataType.simpleString()
    table = table.mapInPandas(said, f"form_id long, n long, kind string, family string, words array<string>, lexicon {lex_type}, says double").select("form_id", "n", "kind", "family", "words", "says", "lexicon")
    rows = cut(table.mapInPandas(_ask, ASKED).withColumn("key", F.xxhash64("kind", "key")))
    asks, keys = rows.where("side = 'ask'"), rows.where("side = 'key'")

    # people: of each key the form of that very name, and the cheapest and most frequent one that is longer
    offer = F.struct("cost", (-F.col("n")).alias("n"), "form_id", "says")
    best = keys.where("kind = 'person'").groupBy("key").agg(F.min(F.when(F.col("cost") == 0, offer)).alias("same"), F.min(F.when(F.col("cost") > 0, offer)).alias("longer"))
    met = asks.where("kind = 'person'").join(best, "key").select("form_id", "says", "n", "cost", F.explode(F.array("same", "longer")).alias("o")).where("o is not null and o.form_id <> form_id")
    met = met.where(F.struct(F.col("o.says"), (-F.col("o.n")).alias("n"), F.col("o.form_id").alias("f")) > F.struct("says", F.col("n"), F.col("form_id").alias("f")))
    links = met.select(F.col("form_id").alias("child"), F.col("o.form_id").alias("parent"), (F.col("cost") + F.col("o.cost")).alias("cost"), (-F.col("o.n")).alias("n"))

    # organisations with the same initials that share one of their two rarest words are compared word for word
    org = asks.where("kind = 'org'").join(keys.where("kind = 'org'").select("key", F.col("form_id").alias("parent"), F.col("says").alias("says_b"), F.col("n").alias("n_b"), F.col("words").alias("words_b")), "key")
    org = org.where(F.struct(F.col("says_b").alias("s"), F.col("n_b").alias("n"), F.col("parent").alias("f")) > F.struct(F.col("says").alias("s"), "n", F.col("form_id").alias("f")))
    org = org.select(F.col("form_id").alias("child"), "parent", "words", "words_b", "n_b").dropDuplicates(["child", "parent"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cost = [same_organisation(list(x), list(y), radius) for x, y in zip(b["words"], b["words_b"])]
            keep = [c is not None for c in cost]
            yield pd.DataFrame({"child": b["child"][keep], "parent": b["parent"][keep], "cost": [c for c in cost if c is not None], "n": b["n_b"][keep]}).astype("int64")

    links = links.select("child", "parent", F.col("cost").cast("long").alias("cost"), "n").unionByName(org.mapInPandas(compare, "child long, parent long, cost long, n long"))
    tree = links.groupBy("child").agg(F.min(F.struct("cost", (-F.col("n")).alias("n"), "parent")).alias("b")).select(F.col("child").alias("a"), F.col("b.parent").alias("b"))
    labels = components(tree).withColumnRenamed("node", "form_id")
    return spelt.select("name", "n", "form_id").join(labels, "form_id", "left").select("name", "n", F.coalesce("label", "form_id").alias("entity"))


def name_pairs(linked: DataFrame) -> DataFrame:
    """All pairs of spellings of one entity, the smaller (by code point) first."""
    a = linked.select("entity", F.col("name").alias("name_a"))
    return a.join(linked.select("entity", F.col("name").alias("name_b")), "entity").where("name_a < name_b").select("name_a", "name_b")
