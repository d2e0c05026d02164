"""Problem 2: one entry for each publication, with id, abstract and doi taken from the records that hold the best values.

1. Publications. Records whose titles agree letter for letter, in year and part, form a class. Classes are compared when two of
   the three runs of words that their titles begin with agree (a misspelt word spoils one run only); they are linked when their
   titles are a few letters apart, or one lacks the subtitle and they share an author's name. Shared keys or DOIs link nothing.
2. Latent two-sided quality. For each publication, field and value, the sources that give the value vote for it, the
   publication's sources that give another vote against it, and so do the other publications that have the same value.
   Expectation-maximisation infers each source's sensitivity and false-positive rate and each value's probability of being
   true; several values of a field may be true at once.
3. Survivors. An abstract that recurs in other publications is usable only if it is judged true: that is what tells a remark that there
   is none from an abstract, no list of remarks does. Among usable values: the abstract with most letters and digits, then the most trusted source, the latest edit, the
   smallest entry_id. That order is fixed by this project's data; the probabilities and the further true values come beside it.

All statistics are kept as counts by pattern of voters; source quality is joined, not collected. Groups are reduced with
partial aggregation, so a publication or source with a third of all records isn't gathered anywhere.

Nulls: records without a title are publications of their own; null src, trust_rank and modified_at come last; a null field
isn't usable. Repeated rows count as records. An empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators.components import components
from quillmill.operators.prefilter import keep_possible
from quillmill.session import cut, settle

#: The fields of which values survive; elsewhere a field is its place here.
FIELDS = ("id", "doi", "abstract")
#: Expectation-maximisation ends when no rate changes by more than this in a round; a warning says so if it hasn't by then.
TOLERANCE, MOST_ROUNDS = 0.01, 60
#: Sources whose rates are held on the driver at most; those of more are joined.
MOST_DRIVEN = 100_000
#: Usual sensitivity and false-positive rate, and the strength (in votes) with which they hold as priors.
SENSITIVITY, FALSE_POSITIVE, STRENGTH = 0.6, 0.05, 10.0

DOI_PREFIX = r"(?i)^\s*(?:(?:https?\s*:\s*//\s*)?(?:dx\.|www\.)?doi\.[a-z]+/|(?:urn|info)?\s*:?\s*doi\s*[:/]?\s*)*\s*"
DOI = r"^10\.\d{4,9}(?:\.\d+)*/\S+$"

_ACCENTED = [chr(c) for c in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(c))) > 1]
ACCENTED, BARE = "".join(_ACCENTED), "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


def lower_names(fields: str = "fields") -> Column:
    """The names of a record's fields, folded, in the order of its values."""
    return F.transform(F.map_keys(fields), lambda k: F.lower(F.trim(k)))


def field(name: str, names: str = "_names", fields: str = "fields") -> Column:
    """The value of the first field of that name; null if there is none."""
    return F.get(F.map_values(fields), (F.array_position(names, name) - 1).cast("int"))


def bare(c: Column) -> Column:
    """Lower case without markup, accents, braces and LaTeX commands."""
    return F.translate(F.lower(F.regexp_replace(c, r"<[^>]*>|\\[A-Za-z]+ ?|\\.|[{}’']", "")), ACCENTED.lower(), BARE.lower())


def words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(bare(c), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")


def titled(records: DataFrame) -> DataFrame:
    """Adds year4, part, letters, n_main and title_words to records with title and year. n_main counts the words before the subtitle."""
    t = records.withColumn("_w", F.coalesce(words(F.col("title")), F.array().cast("array<string>")))
    t = t.withColumn("_n", F.size("_w"))
    # the last word but one is looked at before anything is searched
    numbered = (F.col("_n") > 2) & F.get("_w", F.col("_n") - 2).isin("part", "parte", "pt", "vol", "volume") & F.get("_w", F.col("_n") - 1).rlike(r"^(?:\d+|[ivxlc]+)$")
    t = t.withColumn("part", F.when(numbered, F.get("_w", F.col("_n") - 1)).otherwise("")).withColumn("title_words", F.when(numbered, F.slice("_w", 1, F.col("_n") - 2)).otherwise(F.col("_w")))
    main = F.regexp_extract("title", r"(?s)^(.{16,}?)(?:[:?!]|\.\s)", 1)
    t = t.withColumn("n_main", F.when(main == "", F.size("title_words")).otherwise(F.least(F.size(words(main)), F.size("title_words"))))
    return t.withColumn("year4", F.regexp_extract(F.coalesce("year", F.lit("")), r"(\d{4})", 1)).withColumn("letters", F.array_join("title_words", "")).drop("_w", "_n")


def slim_records(entries: DataFrame) -> DataFrame:
    """What the steps need of each record, all of it numbers but the source: no text is shuffled.

    class_key stands for title, year and part. Titles a misspelt word apart share one of the keys of which each leaves out a
    third of the words; a title and the one without its subtitle share the key of what stands before the subtitle; of equal
    DOIs those meet whose first or second half of that part agrees.
    """
    r = entries.withColumn("_names", lower_names()).select("entry_id", "src", "id", "modified_at", *[field(f).alias(f) for f in ("title", "year", "doi", "abstract")])
    r = titled(r)
    plain_doi = F.lower(F.trim(F.regexp_replace("doi", DOI_PREFIX, "")))
    r = r.withColumn("v_doi", F.when(plain_doi.rlike(DOI), F.xxhash64(plain_doi)))
    untagged = F.when(F.contains("abstract", F.lit("<")) | F.contains("abstract", F.lit("&")), F.regexp_replace("abstract", r"<[^>]*>|&#?\w+;", " ")).otherwise(F.col("abstract"))
    r = r.withColumn("_t", F.lower(F.regexp_replace(untagged, r"[^\p{L}\p{N}]+", "")))
    n, main = F.size("title_words"), F.col("n_main")
    third = F.ceil(n / 3).cast("int")
    runs = [F.array_join(F.slice("title_words", third * k + 1, third), " ") for k in range(3)]
    half = F.ceil(main / 2).cast("int")
    head, tail = F.array_join(F.slice("title_words", 1, half), " "), F.array_join(F.slice("title_words", half + 1, F.greatest(main - half, F.lit(1))), " ")
    keys = [F.when(n >= 3, F.xxhash64("year4", "part", F.lit(k), *[runs[j] for j in range(3) if j != k])) for k in range(3)]
    keys += [F.when(main >= 4, F.xxhash64("year4", "part", F.lit(3), F.array_join(F.slice("title_words", 1, F.greatest(main, F.lit(1))), "")))]
    keys += [F.when((main >= 4) & F.col("v_doi").isNotNull(), F.xxhash64("year4", "part", F.lit(4 + k), "v_doi", x)) for k, x in enumerate((head, tail))]
    return r.select(
        "entry_id", "src", "modified_at", "v_doi",
        F.when(F.trim("id") != "", F.xxhash64(F.trim("id"))).alias("v_id"),
        F.when(F.col("_t") != "", F.xxhash64("_t")).alias("v_abstract"), F.length("_t").alias("n_abstract"),
        F.when(F.col("letters") == "", F.xxhash64(F.lit("untitled"), "entry_id")).otherwise(F.xxhash64("year4", "part", "letters")).alias("class_key"),
        F.when(F.col("letters") != "", F.array_compact(F.array(*keys))).alias("keys"),
    )


def publications(slim: DataFrame, entries: DataFrame) -> DataFrame:
    """(class_key, publication) of the title classes that belong together with another; others are publications by themselves."""
    k = slim.select("class_key", "entry_id", F.explode("keys").alias("k")).groupBy("k", "class_key").agg(F.min("entry_id").alias("rep"))
    met = k.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    k = cut(k.join(met, "k"))  # numbers, and only of classes that meet another
    pairs = cut(k.join(k.select("k", F.col("class_key").alias("other"), F.col("rep").alias("rep_b")), "k").where("class_key < other").groupBy("class_key", "other").agg(F.min("rep").alias("rep"), F.min("rep_b").alias("rep_b")))
    wanted = pairs.select(F.col("rep").alias("entry_id")).union(pairs.select("rep_b")).distinct()
    texts = titled(keep_possible(entries, "entry_id", wanted).withColumn("_names", lower_names()).select("entry_id", *[field(f).alias(f) for f in ("title", "year", "author")]))
    people = F.filter(words(F.col("author")), lambda x: (F.length(x) > 2) & ~x.isin("and", "the", "van", "der", "von", "for"))
    texts = cut(texts.select("entry_id", "letters", people.alias("people")).join(wanted, "entry_id"))  # titles of classes that meet another
    x = pairs.join(texts.withColumnRenamed("entry_id", "rep"), "rep").join(texts.select(F.col("entry_id").alias("rep_b"), F.col("letters").alias("letters_b"), F.col("people").alias("people_b")), "rep_b")
    shared = F.coalesce(F.arrays_overlap("people", "people_b"), F.lit(False))
    x = x.withColumn("_s", F.when(F.length("letters") <= F.length("letters_b"), F.col("letters")).otherwise(F.col("letters_b")))
    x = x.withColumn("_l", F.when(F.length("letters") <= F.length("letters_b"), F.col("letters_b")).otherwise(F.col("letters")))
    x = x.withColumn("_near", F.levenshtein("_s", "_l", 4))
    begins = (F.length("_s") >= 24) & (F.levenshtein("_s", F.expr("substring(_l, 1, length(_s))"), 3) >= 0)
    close = (F.col("_near") >= 0) & (F.col("_near") <= F.greatest(F.lit(1), F.least(F.lit(4), F.floor(F.length("_s") / 12))))
    linked = x.where((close & ((F.col("_near") <= 2) | shared)) | (begins & shared))
    return components(linked, "class_key", "other").select(F.col("node").alias("class_key"), F.col("label").alias("publication"))


def judge(members: DataFrame, spread: DataFrame, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(facts, quality): publication, field, value, n_else, probability; source (hashed), field, sensitivity, false_positive_rate, rounds, change.

    members has publication, src, v_id, v_doi, v_abstract; spread has field, value, n_else for values that several publications have.
    """
    claims = members.select("publication", F.xxhash64("src").alias("source"), _each()).select("publication", "source", "c.*").where("value is not null")
    facts = claims.groupBy("publication", "field", "value").agg(F.sort_array(F.collect_set("source")).alias("pos"))  # sources, not records
    voters = claims.groupBy("publication", "field").agg(F.collect_set("source").alias("all"))
    facts = facts.join(voters, ["publication", "field"]).join(spread, ["field", "value"], "left")
    facts = facts.select("publication", "field", "value", F.coalesce("n_else", F.lit(0)).alias("n_else"), "pos", F.sort_array(F.array_except("all", "pos")).alias("neg"))
    facts = cut(facts.withColumn("pattern", F.xxhash64("field", "pos", "neg", "n_else")).drop("all"))
    patterns = facts.groupBy("pattern").agg(F.first("field").alias("field"), F.first("n_else").alias("n_else"), F.first("pos").alias("pos"), F.first("neg").alias("neg"), F.count(F.lit(1)).alias("n"))
    ballots = F.concat(F.transform("pos", lambda s: F.struct(s.alias("source"), F.lit(1).alias("yes"))), F.transform("neg", lambda s: F.struct(s.alias("source"), F.lit(0).alias("yes"))))
    ballots = cut(patterns.select("pattern", "field", "n_else", "n", F.explode(ballots).alias("v")).select("pattern", "field", "n_else", "n", "v.source", "v.yes"))
    # the vote of another publication weighs as that of a source of usual quality that is silent here
    away = F.log(F.lit((1 - SENSITIVITY) / (1 - FALSE_POSITIVE)))
    known = cut(ballots.select("source").distinct())
    if known.limit(MOST_DRIVEN + 1).count() <= MOST_DRIVEN:
        probability, quality = _driven(ballots, known, away, tolerance, most_rounds)
    else:
        probability, quality = _joined(ballots, away, tolerance, most_rounds)
    facts = facts.join(probability, "pattern").select("publication", "field", "value", "n_else", "probability")
    return facts, quality


def _rates(tp, t, fp, f):
    """(sensitivity, false-positive rate) out of expected counts, of columns or of arrays."""
    return (tp + STRENGTH * SENSITIVITY) / (t + STRENGTH), (fp + STRENGTH * FALSE_POSITIVE) / (f + STRENGTH)


def _sums(votes: DataFrame, by: str) -> DataFrame:
    p, q = F.col("probability") * F.col("n"), (1 - F.col("probability")) * F.col("n")
    return votes.groupBy("field", by).agg(F.sum(p * F.col("yes")).alias("tp"), F.sum(p).alias("t"), F.sum(q * F.col("yes")).alias("fp"), F.sum(q).alias("f"))


def _warn(change: float, tolerance: float, rounds: int) -> None:
    if change > tolerance:
        warnings.warn(f"source quality still changes by {change:.4f} after {rounds} rounds", stacklevel=3)


def _driven(ballots: DataFrame, known: DataFrame, away: Column, tolerance: float, most_rounds: int) -> tuple[DataFrame, DataFrame]:
    """(probability of each pattern, quality) with the rates on the driver, of sources whose number has been checked. A round moves nothing but its sums."""
    spark = ballots.sparkSession
    names = sorted(r.source for r in known.collect())
    place = spark.createDataFrame(list(enumerate(names)), "at int, source long")
    seats = lambda yes: F.collect_list(F.when(F.col("yes") == yes, F.col("at")))
    voting = cut(ballots.join(F.broadcast(place), "source").groupBy("pattern", "field", "n_else", "n").agg(seats(1).alias("for"), seats(0).alias("against")))
    seat = lambda side, v: F.transform(side, lambda i: F.struct(i.alias("at"), F.lit(v).alias("yes")))
    sens, fpr, prior = (np.full((len(FIELDS), len(names)), x) for x in (SENSITIVITY, FALSE_POSITIVE, 0.5))
    prior = prior[:, :1]

    def expect() -> DataFrame:
        rows = [(k, *(x.tolist() for x in (np.log(sens[k] / fpr[k]), np.log((1 - sens[k]) / (1 - fpr[k])))), float(np.log(prior[k, 0] / (1 - prior[k, 0])))) for k in range(len(FIELDS))]
        q = spark.createDataFrame(rows, "field int, w1 array<double>, w0 array<double>, p0 double")
        total = lambda side, w: F.aggregate(side, F.lit(0.0), lambda t, i: t + F.get(w, i))
        odds = total("for", "w1") + total("against", "w0") + F.col("n_else") * away + F.col("p0")
        return voting.join(F.broadcast(q), "field").select("pattern", "field", "n", "for", "against", (1 / (1 + F.exp(-odds))).alias("probability"))

    # at first a value is as likely as its share of the votes
    likely = voting.withColumn("probability", F.size("for") / (F.size("for") + F.size("against")) / (1 + F.col("n_else")))
    for k in range(1, most_rounds + 1):
        votes = likely.select("field", "n", "probability", F.explode(F.concat(seat("for", 1), seat("against", 0))).alias("v")).select("field", "n", "probability", "v.at", "v.yes")
        counts = np.zeros((4, len(FIELDS), len(names)))
        for r in _sums(votes, "at").collect():
            counts[:, r.field, r.at] = r.tp, r.t, r.fp, r.f
        new = _rates(*counts)
        new = np.clip(new[0], 0.05, 0.99), np.minimum(new[1], 0.95)
        change = 1.0 if k == 1 else float(max(np.abs(new[0] - sens).max(initial=0), np.abs(new[1] - fpr).max(initial=0)))
        sens, fpr = new
        t, f = counts[1].sum(axis=1, keepdims=True), counts[3].sum(axis=1, keepdims=True)
        prior = np.clip(np.divide(t, t + f, out=np.full_like(t, 0.5), where=t + f > 0), 0.05, 0.95)
        likely = expect()
        if change <= tolerance:
            break
    _warn(change, tolerance, k)
    rows = [(names[i], j, float(sens[j, i]), float(fpr[j, i]), k, change) for j in range(len(FIELDS)) for i in np.flatnonzero(counts[1, j] + counts[3, j] > 0)]
    quality = spark.createDataFrame(rows, "source long, field int, sensitivity double, false_positive_rate double, rounds int, change double")
    return likely.select("pattern", "probability"), quality


def _joined(ballots: DataFrame, away: Column, tolerance: float, most_rounds: int) -> tuple[DataFrame, DataFrame]:
    """The same for any number of sources: rates are joined, and nothing but the greatest change reaches the driver."""

    def expect(quality: DataFrame) -> DataFrame:
        w = F.when(F.col("yes") == 1, F.log(F.col("sens") / F.col("fpr"))).otherwise(F.log((1 - F.col("sens")) / (1 - F.col("fpr"))))
        odds = F.sum(w).over(Window.partitionBy("pattern")) + F.col("n_else") * away + F.log(F.col("prior") / (1 - F.col("prior")))
        return ballots.join(quality.select("field", "source", "sens", "fpr", "prior"), ["field", "source"]).select("pattern", "field", "source", "yes", "n", (1 / (1 + F.exp(-odds))).alias("probability"))

    likely = ballots.withColumn("probability", F.avg("yes").over(Window.partitionBy("pattern")) / (1 + F.col("n_else")))
    quality = None
    for k in range(1, most_rounds + 1):
        m = _sums(likely, "source")
        prior = m.groupBy("field").agg(F.greatest(F.least(F.sum("t") / F.sum(F.col("t") + F.col("f")), F.lit(0.95)), F.lit(0.05)).alias("prior"))  # a row for each field
        sens, fpr = _rates(*(F.col(c) for c in ("tp", "t", "fp", "f")))
        new = m.join(prior, "field").select("field", "source", F.least(F.greatest(sens, F.lit(0.05)), F.lit(0.99)).alias("sens"), F.least(fpr, F.lit(0.95)).alias("fpr"), "prior")
        moved = F.lit(1.0)
        if quality is not None:
            new = new.join(quality.select("field", "source", F.col("sens").alias("_s"), F.col("fpr").alias("_f")), ["field", "source"])
            moved = F.greatest(F.abs(F.col("sens") - F.col("_s")), F.abs(F.col("fpr") - F.col("_f")))
        quality = settle(new.select("field", "source", "sens", "fpr", "prior", moved.alias("moved")))
        change = quality.agg(F.max("moved")).first()[0] or 0.0
        likely = expect(quality)
        if change <= tolerance:
            break
    _warn(change, tolerance, k)
    rates = quality.select("source", "field", F.col("sens").alias("sensitivity"), F.col("fpr").alias("false_positive_rate"), F.lit(k).alias("rounds"), F.lit(change).alias("change"))
    return likely.groupBy("pattern").agg(F.first("probability").alias("probability")), rates


def _each() -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"v_{f}").alias("value")) for k, f in enumerate(FIELDS)])).alias("c")


def best_representatives(entries: DataFrame, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(survivors, members, facts, quality), of publications of two or more records.

    survivors: publication, n_records, field_name, entry_id, value; members: entry_id, publication and what judged the record;
    facts and quality as in judge(), with field as its place in FIELDS.
    """
    slim = cut(slim_records(entries))  # about a hundred bytes a record
    pubs = publications(slim.select("entry_id", "class_key", "keys"), entries)
    placed = slim.drop("keys").join(pubs, "class_key", "left").withColumn("publication", F.coalesce("publication", "class_key")).drop("class_key")
    several = placed.groupBy("publication").agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1")
    spread = placed.select("publication", _each()).select("publication", "c.*").where("value is not null").distinct()
    spread = spread.groupBy("field", "value").agg((F.count(F.lit(1)) - 1).alias("n_else")).where("n_else > 0")
    members = placed.join(several, "publication")
    if sources is None:
        members = members.withColumn("trust_rank", F.lit(None).cast("int"))
    else:
        members = members.join(sources.where("src is not null").groupBy("src").agg(F.min("trust_rank").alias("trust_rank")), "src", "left")
    members = cut(members)
    facts, quality = judge(members, spread)
    # only values that recur elsewhere can be judged false; they are few
    doubted = facts.where(f"field = {FIELDS.index('abstract')} and n_else > 0 and probability < 0.5").select("publication", F.col("value").alias("v_abstract"), F.lit(True).alias("doubted"))
    m = members.join(doubted, ["publication", "v_abstract"], "left")
    last = lambda c: F.col(c).isNull()
    rank = [last("trust_rank") | last("src"), F.when(F.col("src").isNotNull(), F.coalesce("trust_rank", F.lit(2**31 - 1))).otherwise(2**31 - 1), last("modified_at"), -F.coalesce(F.unix_micros(F.col("modified_at").cast("timestamp")), F.lit(0)), F.col("entry_id")]

    def pick(f: str, usable: Column) -> Column:
        size = -F.col("n_abstract") if f == "abstract" else F.lit(0)
        return F.min(F.when(usable, F.struct(size.alias("a"), *[r.alias(f"r{i}") for i, r in enumerate(rank)], F.col(f"v_{f}").alias("value")))).alias(f)

    best = m.groupBy("publication").agg(
        F.max("n_records").alias("n_records"), pick("id", F.col("v_id").isNotNull()), pick("doi", F.col("v_doi").isNotNull()), pick("abstract", F.col("v_abstract").isNotNull() & F.col("doubted").isNull())
    )
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f)["r4"].alias("entry_id"), F.col(f)["value"].alias("value")) for f in ("id", "abstract", "doi")]))
    survivors = best.select("publication", "n_records", each.alias("s")).select("publication", "n_records", "s.*").where("entry_id is not null")
    return survivors, members, facts, quality


def merged_entries(entries: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """One row for each publication of two or more records: surviving id, abstract and doi, the probability of each, and in `<field>_true` every value of the field that is judged true (one record's spelling of each), the likeliest first."""
    survivors, members, facts, _ = best_representatives(entries, sources)
    named = facts.withColumn("field_name", F.get(F.array(*map(F.lit, FIELDS)), F.col("field"))).select("publication", "field_name", "value", "probability")
    # the record that stands for each value: the one that survives, else that of the smallest entry_id
    of_value = members.select("publication", "entry_id", _each()).select("publication", F.get(F.array(*map(F.lit, FIELDS)), F.col("c.field")).alias("field_name"), F.col("c.value").alias("value"), "entry_id").where("value is not null")
    of_value = of_value.groupBy("publication", "field_name", "value").agg(F.min("entry_id").alias("first"))
    kept = survivors.select("publication", "field_name", "value", "n_records", F.col("entry_id").alias("survivor"))
    v = named.join(of_value, ["publication", "field_name", "value"]).join(kept, ["publication", "field_name", "value"], "left").where("survivor is not null or probability >= 0.5")
    v = cut(v.select("publication", "field_name", "probability", "n_records", (F.col("survivor").isNotNull()).alias("survives"), F.coalesce("survivor", "first").alias("entry_id")))
    texts = keep_possible(entries, "entry_id", v.select("entry_id")).withColumn("_names", lower_names()).select("entry_id", "id", field("abstract").alias("abstract"), field("doi").alias("doi"))
    v = v.join(texts, "entry_id").withColumn("text", F.coalesce(*[F.when(F.col("field_name") == f, F.col(f)) for f in FIELDS])).select("publication", "field_name", "probability", "n_records", "survives", "text")
    out = []
    for f in FIELDS:
        here = F.col("field_name") == f
        out += [F.max(F.when(here & F.col("survives"), F.col("text"))).alias(f), F.max(F.when(here & F.col("survives"), F.col("probability"))).alias(f"{f}_probability")]
        true = F.collect_list(F.when(here & (F.col("probability") >= 0.5), F.struct((-F.col("probability")).alias("p"), "text")))
        out.append(F.transform(F.array_sort(true), lambda x: x["text"]).alias(f"{f}_true"))
    return v.groupBy("publication").agg(F.max("n_records").alias("n_records"), *out).where("n_records is not null")


def source_quality(entries: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """source, field_name, sensitivity, false_positive_rate, and in how many rounds to what change they were found."""
    quality = best_representatives(entries, sources)[3]
    names = entries.select("src").distinct().select("src", F.xxhash64("src").alias("source"))
    return quality.join(names, "source").select(F.col("src").alias("source"), F.get(F.array(*map(F.lit, FIELDS)), F.col("field")).alias("field_name"), "sensitivity", "false_positive_rate", "rounds", "change")
