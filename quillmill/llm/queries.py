"""Queries of the training-data operators, and SQL for those that SQL can express. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.llm import format_duplicates, mixing, names, packing, scans, splitting, survivors, truncation
from quillmill.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_blocks(table(spark, sf_dir, "block_list", spread=True))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).where("text_chars > max_chars and piece_no = 0").select("doc", "block_no")


P1_FOUND = """
WITH flat AS (
  SELECT doc, coalesce(CASE WHEN max_chars > 0 THEN max_chars END, 900) AS top, blocks, unnest(range(len(blocks))) AS i FROM block_list
)
SELECT doc, CAST(i AS INTEGER) AS block_no FROM flat
WHERE length(trim(regexp_replace(blocks[i + 1], '[ \\t\\n]+', ' ', 'g'), ' ')) > top
"""


def p1_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block put together again from what its pieces have of their own, and how many pieces break a rule: over the limit, or not what the block has at their place."""
    p = p1_pieces(spark, sf_dir)
    own = F.expr("substring(piece, overlap_chars + 1)")
    gap = F.when(F.col("joined"), " ").otherwise("")
    after = Window.partitionBy("doc", "block_no").orderBy("piece_no")
    # without an overlap the blank between two pieces is in neither
    parted = (F.col("overlap_chars") == 0) & (F.col("start") > F.lag(F.col("start") + F.col("n_chars")).over(after))
    p = p.withColumn("joined", F.coalesce(parted, F.lit(False)))
    parts = F.array_sort(F.collect_list(F.struct("piece_no", F.concat(gap, own).alias("t"))))
    broken = F.count_if((F.col("n_chars") > F.col("max_chars")) | (F.length("piece") != F.col("n_chars")))
    return p.groupBy("doc", "block_no").agg(F.md5(F.array_join(F.transform(parts, lambda x: x["t"]), "")).alias("digest"), broken.alias("n_broken"))


P1_CHECKED = """
SELECT doc, CAST(i AS INTEGER) AS block_no, md5(t) AS digest, 0 AS n_broken FROM (
  SELECT doc, i, trim(regexp_replace(blocks[i + 1], '[ \\t\\n]+', ' ', 'g'), ' ') AS t FROM (SELECT doc, blocks, unnest(range(len(blocks))) AS i FROM block_list)
) WHERE t <> ''
"""


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best, *_ = survivors.best_representatives(table(spark, sf_dir, "bib_entry"), table(spark, sf_dir, "bib_source"))
    return best.select("entry_id", "field_name")


def p2_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.merged_entries(table(spark, sf_dir, "bib_entry"), table(spark, sf_dir, "bib_source"))


def p2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.source_quality(table(spark, sf_dir, "bib_entry"), table(spark, sf_dir, "bib_source"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repair(table(spark, sf_dir, "png2md", spread=True))[0]


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.paragraphs(table(spark, sf_dir, "png2md", spread=True))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_duplicates.duplicate_pairs(format_duplicates.duplicate_classes(table(spark, sf_dir, "bib_entry")))


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_duplicates.collapse(table(spark, sf_dir, "bib_entry")).select("entry_id", "n_copies")


P4_KEYED = """
    SELECT entry_id,
           regexp_replace(lower(coalesce(entry_type, '')), '[^\\p{L}\\p{N}]', '', 'g') || chr(1)
             || regexp_replace(lower(coalesce(id, '')), '[^\\p{L}\\p{N}]', '', 'g') || chr(1)
             || array_to_string(list_sort(list_transform(map_entries(fields), lambda x:
                  regexp_replace(lower(x.key), '[^\\p{L}\\p{N}]', '', 'g') || chr(2)
                  || regexp_replace(lower(CASE WHEN lower(trim(x.key)) = 'doi'
                       THEN regexp_replace(coalesce(x.value, ''), '^\\s*((https?\\s*:\\s*//\\s*)?(dx\\.|www\\.)?doi\\.[a-z]+/|(urn|info)?\\s*:?\\s*doi\\s*[:/]\\s*)+\\s*', '', 'i')
                       ELSE coalesce(x.value, '') END), '[^\\p{L}\\p{N}]', '', 'g'))), chr(3)) AS canon
    FROM bib_entry
"""

P4_FOUND = f"""
WITH keyed AS ({P4_KEYED})
SELECT a.entry_id AS entry_a, b.entry_id AS entry_b
FROM keyed a JOIN keyed b ON a.canon = b.canon AND a.entry_id < b.entry_id
"""

P4_COLLAPSED = f"""
WITH keyed AS ({P4_KEYED})
SELECT min(entry_id) AS entry_id, count(*) AS n_copies FROM keyed GROUP BY canon
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_pairs(names.entities(table(spark, sf_dir, "bib_entry")))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = names.entities(table(spark, sf_dir, "bib_entry"))
    return linked.groupBy("entity").agg(F.max_by("name", F.struct("n", "name")).alias("name"), F.count(F.lit(1)).alias("n_spellings"), F.sum("n").alias("n_occurrences"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_plan"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_packed(spark, sf_dir))


def p6_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan, doc_id) of every document that lies in the containers of a plan whole: in pieces without gap, one piece unless it is over the capacity, no container over it."""
    p = p6_packed(spark, sf_dir)
    one = p.groupBy("plan", "doc_id", "capacity_tokens").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"), F.max("piece_no").alias("last"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.max("container_tokens").alias("fullest"))
    return one.where("n = last + 1 and end = tokens and fullest <= capacity_tokens and (n = 1 or tokens > capacity_tokens)").select("plan", "doc_id")


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planned size is kept; what a source can't give stays open."""
    return mixing.mix_documents(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "mix_target"))[0].drop("keep")


def p7_selection_at_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest size at which all sources with documents give their shares."""
    return mixing.mix_documents(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "mix_target"), keep=("shares",))[0].drop("keep")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "mix_target"), keep=mixing.KEEP)[1]


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each wanted share, and how many rules the answer breaks: a cap exceeded, a source without documents filled, or one with enough that is off by more than 1 % of the size and than its largest document."""
    r = p7_shares(spark, sf_dir)
    over = F.col("most_used") > F.coalesce("max_repeats", "most_used")
    off = (F.col("blocks") == F.col("blocks_wanted")) & (F.col("available_tokens") > 0) & (F.abs(F.col("tokens") - F.col("share_wanted") * F.col("mix_tokens")) > F.greatest(0.01 * F.col("mix_tokens"), F.col("largest_document")))
    empty = (F.col("available_tokens") == 0) & (F.col("tokens") > 0)
    broken = over.cast("int") + off.cast("int") + empty.cast("int")
    return r.select("mix", "keep", "source", F.floor(F.col("share_wanted") * 1000000 + 0.5).cast("long").alias("share_millionths"), (F.col("available_tokens") > 0).alias("has_documents"), broken.alias("n_broken"))


P7_CHECKED = """
SELECT t.mix, k.keep, t.source, CAST(floor(t.target_share / sum(t.target_share) OVER (PARTITION BY t.mix, k.keep) * 1000000 + 0.5) AS BIGINT) AS share_millionths,
       t.source IN (SELECT source FROM documents WHERE length(text) > 0 AND source IS NOT NULL) AS has_documents, 0 AS n_broken
FROM mix_target t, (VALUES ('size'), ('shares')) AS k(keep)
"""


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.detect(table(spark, sf_dir, "documents", spread=True)).where("is_cut").select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(truncation.detect(table(spark, sf_dir, "documents", spread=True)))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_pieces": p1_pieces,
        "p1_checked": p1_checked,
        "p2_found": p2_found,
        "p2_entries": p2_entries,
        "p2_quality": p2_quality,
        "p3_found": p3_found,
        "p3_paragraphs": p3_paragraphs,
        "p4_found": p4_found,
        "p4_collapsed": p4_collapsed,
        "p5_found": p5_found,
        "p5_entities": p5_entities,
        "p6_packed": p6_packed,
        "p6_fill": p6_fill,
        "p6_placed": p6_placed,
        "p7_selection": p7_selection,
        "p7_selection_at_shares": p7_selection_at_shares,
        "p7_shares": p7_shares,
        "p7_checked": p7_checked,
        "p8_found": p8_found,
        "p8_rates": p8_rates,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND,
        "p1_checked": P1_CHECKED,
        "p4_found": P4_FOUND,
        "p4_collapsed": P4_COLLAPSED,
        "p6_placed": "SELECT plan, doc_id FROM documents, pack_plan WHERE length(text) > 0",
        "p7_checked": P7_CHECKED,
    }
