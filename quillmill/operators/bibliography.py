"""Merging bibliographies in order: duplicates by key, DOI or title, and a policy for keys in conflict.

Entries: entry_id, side ('base' or 'incoming'), pos (order within its side), entry_type, id, fields map<string,string>.

The merge is sequential by nature, but an entry's fate depends only on entries it shares a token or a key with, directly or over
others. So entries are first put into connected components, and the fold runs over each component by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators.components import components

MODES = ("key", "doi", "title")
POLICIES = ("rename", "keep-first", "keep-second", "error")


def field(name: str, fields: str = "fields") -> Column:
    hits = F.filter(F.map_entries(F.coalesce(fields, F.create_map().cast("map<string,string>"))), lambda x: F.lower(x["key"]) == name)
    return F.coalesce(F.get(hits, F.lit(0))["value"], F.lit(""))


def dedupe_tokens(modes: Sequence[str]) -> Column:
    """array<struct<kind, value>> in the order key, DOI, title; empty values give none."""
    unknown = sorted(set(modes) - set(MODES))
    if unknown or not modes:
        raise ValueError(f"unknown modes: {', '.join(unknown)}" if unknown else "no mode is given")
    values = {"key": F.lower(F.coalesce("id", F.lit(""))), "doi": T.normalize_doi(field("doi")), "title": T.normalize_title(field("title"))}
    return F.filter(F.array(*[F.struct(F.lit(m).alias("kind"), values[m].alias("value")) for m in MODES if m in modes]), lambda x: x["value"] != "")


def first_wins(entries: DataFrame, mode: str, by: str = "pos") -> DataFrame:
    """Adds is_first: the first entry, by an order, of those with its token; entries without one are all first. One token kind needs no fold."""
    t = entries.withColumn("_token", F.get(dedupe_tokens([mode]), F.lit(0))["value"])
    firsts = t.where("_token is not null").groupBy("_token").agg(F.min(F.struct(by, "entry_id")).alias("_first"))
    return t.join(firsts, "_token", "left").withColumn("is_first", F.coalesce(F.struct(by, "entry_id") == F.col("_first"), F.lit(True))).drop("_token", "_first")


def fold(rows: list[dict], policy: str, suffix: str) -> list[dict]:
    """The fate of each entry of one component, base first; rows are in order."""
    owner: dict[tuple, int] = {}  # token -> entry; replaced entries' tokens stay, so that later rows meet them
    by_key: dict[str, dict] = {}
    out = []

    def publish(r: dict) -> None:
        by_key[r["key"]] = r
        for t in r["tokens"]:
            owner[t] = r["entry_id"]

    for r in rows:
        r = r | {"new_id": r["id"], "replaces": None}
        if not r["key"]:
            fate = "no_key"
        elif r["side"] == "base":
            fate = "dup" if r["key"] in by_key else "base"
            if fate == "base":
                publish(r)
        else:
            clash = by_key.get(r["key"])
            if clash is None:
                fate = "dup" if any(t in owner for t in r["tokens"]) else "added"
            elif clash["canonical"] == r["canonical"] or policy == "keep-first":
                fate = "dup"
            elif policy == "error":
                fate = "error"
            elif policy == "keep-second":
                fate, r["replaces"] = "replaced", clash.get("place", clash["entry_id"])
                r["place"] = r["replaces"]
                publish(r)
            else:
                fate, n = "renamed", 1
                while (new := f"{r['id']}{suffix}{n if n > 1 else ''}").lower() in by_key:
                    n += 1
                tokens = [t for t in r["tokens"] if t[0] != "key"] + ([("key", new.lower())] if any(t[0] == "key" for t in r["tokens"]) else [])
                r |= {"new_id": new, "key": new.lower(), "tokens": tokens}
                publish(r)
            if fate == "added":
                publish(r)
        out.append(r | {"disposition": fate})
    return out


def merge(entries: DataFrame, modes: Sequence[str] = ("key", "doi", "title"), policy: str = "rename", suffix: str = "_2") -> DataFrame:
    """entry_id, side, pos, new_id, disposition, replaces.

    disposition: base, added, renamed, replaced (takes the place of entry `replaces`), dup, error, no_key. Null ids and fields count as
    empty; a null position comes first; repeated rows are duplicates. `error` rows suppress nothing here: count them and don't write.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    e = entries.select("entry_id", "side", "pos", F.coalesce("id", F.lit("")).alias("id"), F.lower(F.coalesce("id", F.lit(""))).alias("key"), dedupe_tokens(modes).alias("tokens"), F.md5(F.to_json(T.canonical_entry(F.map_concat(F.coalesce("fields", F.create_map().cast("map<string,string>")), F.create_map(F.lit("\x00type"), F.coalesce("entry_type", F.lit("")), F.lit("\x00id"), F.coalesce("id", F.lit(""))))))).alias("canonical"))
    # a renamed key meets keys that begin alike, so keys are bound by what stands before the suffix
    stem = F.regexp_replace("key", rf"(?:{_quoted(suffix.lower())}\d*)+$", "")
    links = F.concat(F.transform("tokens", lambda t: F.concat_ws("\x00", t["kind"], t["value"])), F.array(F.concat(F.lit("stem\x00"), stem)))
    x = e.where("key <> ''").select("entry_id", F.explode(links).alias("token"))
    star = x.join(x.groupBy("token").agg(F.min("entry_id").alias("to")), "token").where("entry_id <> to").select("entry_id", "to").distinct()
    e = e.join(components(star, "entry_id", "to").withColumnRenamed("node", "entry_id"), "entry_id", "left").withColumn("component", F.coalesce("label", "entry_id")).drop("label")

    names = ["entry_id", "side", "pos", "new_id", "disposition", "replaces"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Components come one after another, each in order; only the one at hand is held."""
        at, rows = None, []

        def done() -> list[tuple]:
            return [tuple(r[c] for c in ("entry_id", "side", "pos", "new_id", "disposition", "replaces")) for r in fold(rows, policy, suffix)]

        for b in batches:
            out = []
            for component, i, side, pos, k, key, c, ts in b[["component", "entry_id", "side", "pos", "id", "key", "canonical", "tokens"]].itertuples(index=False, name=None):
                if component != at:
                    out += done()
                    at, rows = component, []
                rows.append({"entry_id": i, "side": side, "pos": pos, "id": k, "key": key, "canonical": c, "tokens": [(t["kind"], t["value"]) for t in ts]})
            yield pd.DataFrame(out, columns=names).astype({"replaces": "Int64"})
        yield pd.DataFrame(done(), columns=names).astype({"replaces": "Int64"})

    ordered = e.withColumn("_b", F.col("side") != "base").repartition("component").sortWithinPartitions("component", "_b", F.col("pos").asc_nulls_first(), "entry_id")
    return ordered.mapInPandas(run, "entry_id long, side string, pos long, new_id string, disposition string, replaces long")


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "_" else c for c in s)


def merge_by_key(entries: DataFrame) -> DataFrame:
    """entry_id, disposition: the merge by key alone that keeps the first. One aggregation and one join, no fold; the same nulls and ties as merge."""
    e = entries.select("entry_id", (F.col("side") != "base").alias("_o"), F.col("pos").isNotNull().alias("_p"), "pos", F.lower(F.coalesce("id", F.lit(""))).alias("key"))
    at = F.struct("_o", "_p", "pos", "entry_id")
    e = e.join(e.where("key <> ''").groupBy("key").agg(F.min(at).alias("_first")), "key", "left")
    fate = F.when(F.col("key") == "", "no_key").when(at != F.col("_first"), "dup").when(F.col("_o"), "added").otherwise("base")
    return e.select("entry_id", fate.alias("disposition"))


def merge_summary(merged: DataFrame) -> DataFrame:
    """Counts by disposition; renamed entries are counted as added too, by whoever sums them."""
    return merged.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


def bibtex_text(entries: DataFrame) -> DataFrame:
    """entry_id, pos, bibtex: each entry as text, the usual fields first, the others by name."""
    first = ["title", "author", "journal", "booktitle", "year", "doi", "url"]
    pairs = F.transform(F.map_entries("fields"), lambda x: F.struct(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, first)), F.lower(x["key"])), F.lit(0)), F.lit(99)).alias("o"), F.lower(x["key"]).alias("k"), F.coalesce(x["value"], F.lit("")).alias("v")))
    lines = F.array_join(F.transform(F.array_sort(pairs), lambda x: F.concat(F.lit("  "), x["k"], F.lit(" = {"), x["v"], F.lit("}"))), ",\n")
    return entries.select("entry_id", "pos", F.concat(F.lit("@"), F.lower("entry_type"), F.lit("{"), F.coalesce("id", F.lit("")), F.lit(",\n"), lines, F.lit("\n}\n")).alias("bibtex"))


def abstract_rows(entries: DataFrame) -> DataFrame:
    """entry_id, id, tokens, chars, preview of entries that have an abstract."""
    a = entries.withColumn("abstract", field("abstract")).where("abstract <> ''")
    return a.select("entry_id", "id", T.basic_tokens(F.col("abstract")).alias("tokens"), F.length("abstract").alias("chars"), T.preview(F.col("abstract"), 50).alias("preview"))


def abstract_stats(entries: DataFrame) -> DataFrame:
    """One row: entries, with an abstract, tokens, tokens of an abstract on average."""
    a = entries.select(field("abstract").alias("a"))
    n = F.count_if(F.col("a") != "")
    return a.agg(F.count(F.lit(1)).alias("n_entries"), n.alias("n_abstracts"), F.coalesce(F.sum(T.basic_tokens(F.col("a"))), F.lit(0)).alias("tokens")).withColumn("mean_tokens", F.try_divide("tokens", "n_abstracts"))


def ordered_files(entries: DataFrame, file: str, order: str, text: str) -> DataFrame:
    """file, text: the texts of each file in order, one after another; null positions first. A file is one row."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).isNotNull().alias("there"), F.col(order).alias("at"), F.col(text).alias("t"))))
    return entries.groupBy(file).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias(text))
