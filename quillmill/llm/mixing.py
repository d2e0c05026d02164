"""Problem 7: a selection of documents in which each source has its target share of the tokens.

Sainte-Laguë apportionment. The planned size of a mix is cut into blocks of equal token size; blocks go to sources by the
highest quotients share / (2 k + 1), then a source's blocks go to its shards by the same rule. Within a shard documents
stand in seeded order; the quota takes the documents of the first blocks, after as many whole passes as it covers.

A source is split into shards of about SHARD_DOCS documents each, so one with a third of all documents is spread over many tasks, and
a mix has SHARD_BLOCKS blocks for each shard of its sources, BLOCKS at least. So a block is a small part of a shard at every size.

A source never gives more than `max_repeats` times what it has; one that is asked for more gives all of it so many times. There are two
answers to a shortfall, and `keep` says which are wanted: "size" keeps the planned size for the other sources and leaves the rest open;
"shares" lowers the size of the mix to the largest at which every source with documents can give its share. Shares of a mix are divided by
their sum; a source without documents keeps its share of the plan, but doesn't lower the size.

What is shuffled is (document, source, tokens), never text.

Nulls: documents without source or text aren't selected, but text without source counts in the total. A null or
non-positive share, or a null source, wants nothing; null max_repeats means no cap, less than 1 means none of it; a null
fraction or encoding wants nothing. A source without documents is reported with 0. Repeated rows are documents of their own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import tokens
from quillmill.session import cut

#: Blocks of a mix at least, and blocks for each shard of its sources: a shard's quota is met to within a block and half a document.
BLOCKS, SHARD_BLOCKS = 10_000, 100
#: Documents in a shard, on average.
SHARD_DOCS = 100_000
SEED = 20_240_607
#: Encodings are read on the driver; there are a handful.
MAX_ENCODINGS = 1_000
KEEP = ("size", "shares")


def sainte_lague(weights: list[float], seats: int, most: list[int | None] | None = None) -> list[int]:
    """Seats by the highest quotients weight / (2 k + 1); ties go to the earlier one. With `most`, what a party can't take stays open.

    Seats whose quotient is above a divisor that hands out no more than all are given at once; only the last few need the heap.
    """
    total = sum(w for w in weights if w > 0)
    if total <= 0 or seats <= 0:
        return [0] * len(weights)
    sure = max(0.0, seats - len(weights) / 2)
    out = [max(0, math.ceil(w * sure / total - 0.5)) if w > 0 else 0 for w in weights]
    while sum(out) > seats:  # rounding errors only
        i = min((i for i, n in enumerate(out) if n), key=lambda i: (weights[i] / (2 * out[i] - 1), -i))
        out[i] -= 1
    heap = [(-w / (2 * n + 1), i) for i, (w, n) in enumerate(zip(weights, out)) if w > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out if most is None else [n if m is None else min(n, m) for n, m in zip(out, most)]


def _source_quotas(g: pd.DataFrame, least_blocks: int) -> pd.DataFrame:
    """Blocks for each source of one mix."""
    g = g.sort_values("source", kind="stable", na_position="last").reset_index(drop=True)
    shares = [float(s) if s is not None and s == s and s > 0 and src is not None else 0.0 for s, src in zip(g["target_share"], g["source"])]
    total = sum(shares)
    most = [math.inf if m is None or m != m else float(max(0, m)) * a for m, a in zip(g["max_repeats"], g["available"])]
    feasible = min((m * total / s for m, s, a in zip(most, shares, g["available"]) if s and a), default=math.inf)
    planned = float(g["planned"].iloc[0])
    size = min(planned, feasible) if g["keep"].iloc[0] == "shares" else planned
    parts = sum(n for n, s in zip(g["shards"], shares) if s)
    everything = max(1.0, float(sum(a for a, s in zip(g["available"], shares) if s)))
    seats = math.ceil(max(least_blocks, SHARD_BLOCKS * parts * max(1.0, size / everything)))
    block = size / seats
    g["blocks_wanted"] = sainte_lague(shares, seats if size > 0 else 0)
    g["whole"] = [bool(a) and n * block > m for n, m, a in zip(g["blocks_wanted"], most, g["available"])]
    g["blocks"] = [0 if not a else int(m / block) if w else n for n, m, w, a in zip(g["blocks_wanted"], most, g["whole"], g["available"])]
    g["block_tokens"] = block
    g["size"] = size
    g["feasible"] = None if feasible == math.inf else feasible
    g["share_wanted"] = [s / total if total else 0.0 for s in shares]
    return g


def _shard_quotas(g: pd.DataFrame, shard_docs: int) -> pd.DataFrame:
    """Blocks for each shard of one source, in bundles worth a hundredth of a shard's documents: a quota smaller than a document would be rounded away in each shard."""
    g = g.sort_values("shard", kind="stable").reset_index(drop=True)
    weights, blocks = [float(x) for x in g["shard_tokens"]], int(g["blocks"].iloc[0])
    bundle = max(1, math.ceil(shard_docs / 100 * g["mean_tokens"].iloc[0] / g["block_tokens"].iloc[0]))
    out = [n * bundle for n in sainte_lague(weights, blocks // bundle)]
    out[max(range(len(out)), key=lambda i: (weights[i] / (2 * out[i] + 1), -i))] += blocks % bundle
    g["shard_blocks"] = out
    return g


def mix_documents(
    docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", folder: str = tokens.TOKENIZER_DIR, vocabularies: dict[str, str] | None = None, seed: int = SEED, keep: Sequence[str] = KEEP[:1], blocks: int = BLOCKS, shard_docs: int = SHARD_DOCS
) -> tuple[DataFrame, DataFrame]:
    """(selection, report): documents with the number of times they are used in each mix; wanted and reached shares of each source.

    Both have a row for each answer asked for in `keep`.
    """
    if set(keep) - set(KEEP) or not keep:
        raise ValueError(f"keep must name some of {KEEP}")
    named = vocabularies or tokens.VOCABULARIES
    encodings = [r[0] for r in targets.select("encoding").where("encoding is not null").distinct().limit(MAX_ENCODINGS + 1).collect()]
    if len(encodings) > MAX_ENCODINGS:
        raise ValueError(f"more than {MAX_ENCODINGS} encodings; mix in several calls")
    of = {e: tokens.vocabulary_of(e, named) for e in encodings}
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("_qm_text")).where("length(_qm_text) > 0")
    counts = cut(tokens.token_counts(slim, ["doc_id", "source"], sorted(set(of.values())), "_qm_text", folder))  # numbers only; the texts are tokenised once
    by_source = cut(counts.groupBy("vocabulary", "source").agg(F.sum("n_tokens").alias("available"), F.ceil(F.count(F.lit(1)) / shard_docs).alias("shards"), F.avg("n_tokens").alias("mean_tokens"), F.max("n_tokens").alias("largest")))
    totals = by_source.groupBy("vocabulary").agg(F.sum("available").alias("all_tokens"))

    vocabulary = F.lit(None).cast("string")
    for e, v in of.items():
        vocabulary = F.when(F.col("encoding") == e, F.lit(v)).otherwise(vocabulary)
    t = targets.select("mix", "source", "target_share", "max_repeats", "encoding", "total_fraction").withColumn("vocabulary", vocabulary)
    t = t.join(totals, "vocabulary", "left").join(by_source, ["vocabulary", "source"], "left")
    t = t.withColumn("available", F.coalesce("available", F.lit(0)).cast("long")).withColumn("shards", F.coalesce("shards", F.lit(0)).cast("long"))
    t = t.withColumn("planned", F.coalesce(F.max(F.col("total_fraction") * F.col("all_tokens")).over(Window.partitionBy("mix")), F.lit(0.0)))
    t = t.withColumn("keep", F.explode(F.array(*map(F.lit, dict.fromkeys(keep)))))
    cols = ["mix", "keep", "source", "target_share", "max_repeats", "encoding", "vocabulary", "available", "shards", "mean_tokens", "largest", "planned"]
    schema = ", ".join(f"{c} {t.schema[c].dataType.simpleString()}" for c in cols) + ", blocks_wanted long, whole boolean, blocks long, block_tokens double, size double, feasible double, share_wanted double"
    quotas = cut(t.select(*cols).groupBy("mix", "keep").applyInPandas(lambda g: _source_quotas(g, blocks), schema))  # one row for each target

    # documents of sources that some mix wants, in the shards of their source
    wanted = quotas.where("blocks > 0 or whole").select("vocabulary", "source", "shards").distinct()
    d = counts.join(wanted, ["vocabulary", "source"]).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards"))).drop("shards")
    by_shard = cut(d.groupBy("vocabulary", "source", "shard").agg(F.sum("n_tokens").alias("shard_tokens")))
    parts = quotas.where("blocks > 0 and not whole").join(by_shard, ["vocabulary", "source"])
    cols = ["mix", "keep", "source", "vocabulary", "max_repeats", "block_tokens", "blocks", "mean_tokens", "shard", "shard_tokens"]
    schema = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in cols) + ", shard_blocks long"
    parts = parts.select(*cols).groupBy("mix", "keep", "source").applyInPandas(lambda g: _shard_quotas(g, shard_docs), schema).where("shard_blocks > 0")

    order = Window.partitionBy("mix", "keep", "source", "shard").orderBy(F.xxhash64(F.lit(seed), "mix", "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = F.col("shard_blocks") * F.col("block_tokens")
    passes = F.floor(want / F.col("shard_tokens"))
    x = d.join(parts, ["vocabulary", "source", "shard"]).withColumn("_qm_passes", passes).withColumn("_qm_rest", want - passes * F.col("shard_tokens"))
    x = x.withColumn("_qm_middle", F.sum("n_tokens").over(order) - F.col("n_tokens") / 2)
    times = F.col("_qm_passes") + (F.col("_qm_middle") <= F.col("_qm_rest")).cast("int")
    x = x.withColumn("times_used", F.least(times, F.coalesce("max_repeats", times)).cast("int")).where("times_used > 0")
    cols = ["mix", "keep", "source", "doc_id", "vocabulary", "n_tokens", "times_used"]
    all_of_it = d.join(quotas.where("whole and max_repeats > 0").select("mix", "keep", "source", "vocabulary", F.col("max_repeats").cast("int").alias("times_used")), ["vocabulary", "source"])
    selection = x.select(*cols).unionByName(all_of_it.select(*cols))

    got = selection.groupBy("mix", "keep", "source").agg(F.sum(F.col("n_tokens") * F.col("times_used")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("times_used").alias("most_used"))
    report = quotas.join(got, ["mix", "keep", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    report = report.withColumn("_qm_all", F.sum("tokens").over(Window.partitionBy("mix", "keep")))
    report = report.select(
        "mix", "keep", "source", "encoding", "vocabulary", "target_share", "share_wanted", "max_repeats", F.col("planned").alias("planned_tokens"), F.col("feasible").alias("feasible_tokens"), F.col("size").alias("mix_tokens"), F.col("available").alias("available_tokens"), F.col("largest").alias("largest_document"),
        "blocks_wanted", "blocks", "tokens", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_used", F.lit(0)).alias("most_used"),
        F.when(F.col("_qm_all") > 0, F.col("tokens") / F.col("_qm_all")).otherwise(0.0).alias("share_reached"),
        F.when(F.col("size") > 0, F.col("tokens") / F.col("size")).otherwise(0.0).alias("share_of_plan"),
    )
    return selection, report
