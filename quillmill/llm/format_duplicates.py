"""Problem 4: records that differ in white space, case, punctuation or field order only.

Each record's characters run through a skip-and-fold table into rolling polynomial hashes; a field's hash is bound to its
name's and the fields are added up, so their order is of no account and no canonical string is built. Rows whose
fingerprints meet are verified: two index vectors walk over the kept characters of both records in step.

Fingerprints are computed once and kept. Only (id, fingerprint) is shuffled for all rows. Contents move for rows whose fingerprint occurs
twice: a bitmap of fixed size over their ids keeps out nearly all others, as long as there are fewer than some ten million; beyond that more
and more others are shuffled along, and dropped by the join. A group of copies of any size is split over salts for the verification.

Nulls: a null `id`, type, map or value counts as empty; a missing field isn't an empty one. An empty table gives an empty
table. Repeated rows are copies. Columns that clash with the operator's own names (prefixed `_qm_`) aren't touched, as only
the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.folding import fold_points, mix, points_of, rolling_hashes
from quillmill.operators.prefilter import keep_possible
from quillmill.session import cut

#: A resolver's address or a scheme in front of a DOI.
DOI_PREFIX = re.compile(r"\s*(?:(?:https?\s*:\s*//\s*)?(?:dx\.|www\.)?doi\.[a-z]+/|(?:urn|info)?\s*:?\s*doi\s*[:/]\s*)+\s*", re.I)

#: Copies of a group verified by one salt.
SALT_ROWS = 20_000


def _flat(batch: pa.RecordBatch, kind: str, key: str, fields: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts of a batch in a row: folded points and lengths of names and of values, and the record of each.

    The type and the key are fields named by a letter that no field name, being folded to lower case, can hold.
    """
    n = batch.num_rows
    maps = batch.column(fields)
    offsets = np.asarray(maps.offsets)
    sizes = np.diff(offsets)
    if maps.null_count:
        sizes = np.where(maps.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    take = np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    names, values = maps.keys.take(pa.array(take)), maps.items.take(pa.array(take))
    owner = np.concatenate((np.repeat(np.arange(n), sizes), np.arange(n), np.arange(n)))
    names = pa.concat_arrays([names.cast(pa.string()), pa.array(["type·"] * n + ["key·"] * n, pa.string())])
    values = pa.concat_arrays([values.cast(pa.string()), batch.column(kind).cast(pa.string()), batch.column(key).cast(pa.string())])
    name_points, name_lengths = points_of(names)
    points, lengths = points_of(values)
    folded = fold_points(points)
    is_doi = pc.equal(pc.utf8_lower(pc.utf8_trim_whitespace(names)), "doi").to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    if is_doi.any():
        folded = folded.copy()
        at = np.flatnonzero(is_doi)
        for i, v in zip(at, values.take(pa.array(at)).to_pylist()):
            if v and (m := DOI_PREFIX.match(v)):
                folded[starts[i] : starts[i] + m.end()] = 0
    name_folded = fold_points(name_points).copy()
    name_folded[name_points == ord("·")] = ord("·")
    return name_folded, name_lengths, folded, lengths, owner


def _fingerprints(batches: Iterator[pa.RecordBatch], kind: str, key: str, fields: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        nf, nl, vf, vl, owner = _flat(b, kind, key, fields)
        with np.errstate(over="ignore"):
            each = mix(mix(rolling_hashes(nf, nl)) + rolling_hashes(vf, vl))
            total = np.zeros(b.num_rows, dtype=np.uint64)
            np.add.at(total, owner, each)
        yield pa.RecordBatch.from_arrays([b.column("_qm_id"), pa.array(mix(total).view(np.int64))], names=["_qm_id", "_qm_h"])


def fingerprints(df: DataFrame, record_id: str = "entry_id", kind: str = "entry_type", key: str = "id", fields: str = "fields") -> DataFrame:
    """(_qm_id, _qm_h) of each record."""
    slim = df.select(F.col(record_id).alias("_qm_id"), F.col(kind).alias("_qm_kind"), F.col(key).alias("_qm_key"), F.col(fields).alias("_qm_fields"))
    t = slim.schema["_qm_id"].dataType.simpleString()
    return slim.mapInArrow(lambda it: _fingerprints(it, "_qm_kind", "_qm_key", "_qm_fields"), f"_qm_id {t}, _qm_h long")


def _order(name_folded: np.ndarray, name_lengths: np.ndarray, owner: np.ndarray, value_hash: np.ndarray) -> np.ndarray:
    """Items by record, then by name, then by value."""
    return np.lexsort((value_hash, rolling_hashes(name_folded, name_lengths), owner))


def _walk(folded: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers to the kept characters, item after item in the given order, and how many each item has."""
    kept = np.flatnonzero(folded)
    ends = np.cumsum(lengths)
    lo, hi = np.searchsorted(kept, ends - lengths), np.searchsorted(kept, ends)
    n = (hi - lo)[order]
    start = lo[order]
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return kept[at], n


def same_records(a: pa.RecordBatch, b: pa.RecordBatch, kind: str = "kind", key: str = "key", fields: str = "fields") -> np.ndarray:
    """Whether row i of both agrees when only letters and digits are compared. Pointers run over both sides in step."""
    fa, fb = _flat(a, kind, key, fields), _flat(b, kind, key, fields)
    n = a.num_rows
    same = np.bincount(fa[4], minlength=n) == np.bincount(fb[4], minlength=n)
    oa = _order(fa[0], fa[1], fa[4], rolling_hashes(fa[2], fa[3]))
    ob = _order(fb[0], fb[1], fb[4], rolling_hashes(fb[2], fb[3]))
    oa, ob = oa[same[fa[4][oa]]], ob[same[fb[4][ob]]]
    owner = fa[4][oa]
    for k in (0, 2):
        (pa_, na), (pb_, nb) = _walk(fa[k], fa[k + 1], oa), _walk(fb[k], fb[k + 1], ob)
        differ = na != nb
        same[owner[differ]] = False
        keep_a, keep_b = np.repeat(~differ, na), np.repeat(~differ, nb)
        unequal = fa[k][pa_[keep_a]] != fb[k][pb_[keep_b]]
        if unequal.any():
            same[np.repeat(owner[~differ], na[~differ])[unequal]] = False
    return same


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each record with the first one of its group, which stands before it; it may be in an earlier batch."""
    names, before = ["kind", "key", "fields"], None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if before is None else [before, b]).combine_chunks()
        first = t.column("_qm_first").to_numpy(zero_copy_only=False).astype(bool)
        of = np.maximum.accumulate(np.where(first, np.arange(len(first)), -1))
        before = t.slice(int(of[-1]), 1).to_batches()[0]
        rows = np.flatnonzero(~first)
        if not len(rows):
            continue
        a, r = t.take(pa.array(rows)), t.take(pa.array(of[rows]))
        same = same_records(*(x.select(names).combine_chunks().to_batches()[0] for x in (a, r)))
        yield pa.RecordBatch.from_arrays([a.column("_qm_id").combine_chunks(), a.column("_qm_rep").combine_chunks(), pa.array(same)], names=["_qm_id", "_qm_rep", "_qm_same"])


def duplicate_classes(df: DataFrame, record_id: str = "entry_id", kind: str = "entry_type", key: str = "id", fields: str = "fields", salt_rows: int = SALT_ROWS) -> DataFrame:
    """(record_id, class_id) of each record that has a copy; class_id is the smallest id of its class."""
    ids = cut(fingerprints(df, record_id, kind, key, fields))
    t = ids.schema["_qm_id"].dataType.simpleString()
    groups = ids.groupBy("_qm_h").agg(F.min("_qm_id").alias("_qm_rep"), F.count(F.lit(1)).alias("_qm_n")).where("_qm_n > 1")
    members = ids.join(groups, "_qm_h").select("_qm_id", "_qm_rep", F.expr(f"cast(ceil(_qm_n / {salt_rows}.0) as int)").alias("_qm_salts"))
    members = cut(members)  # numbers only, of rows that meet another
    content = df.select(F.col(record_id).alias("_qm_id"), F.col(kind).alias("kind"), F.col(key).alias("key"), F.col(fields).alias("fields"))
    met = keep_possible(content, "_qm_id", members.select("_qm_id")).join(members, "_qm_id").withColumn("_qm_first", F.col("_qm_id") == F.col("_qm_rep"))
    salts = F.when(F.col("_qm_first"), F.sequence(F.lit(0), F.col("_qm_salts") - 1)).otherwise(F.array(F.expr("cast(pmod(xxhash64(_qm_id), _qm_salts) as int)")))
    met = met.withColumn("_qm_salt", F.explode(salts)).select("_qm_id", "_qm_rep", "_qm_salt", "_qm_first", "kind", "key", "fields")
    met = met.repartition("_qm_rep", "_qm_salt").sortWithinPartitions("_qm_rep", "_qm_salt", F.desc("_qm_first"))
    verified = cut(met.mapInArrow(_verify, f"_qm_id {t}, _qm_rep {t}, _qm_same boolean"))
    good = verified.where("_qm_same").select("_qm_id", "_qm_rep")
    strays = verified.where("not _qm_same").select("_qm_id")
    if not strays.isEmpty():  # a collision of fingerprints: these rows go through once more by themselves
        rest = df.join(strays.withColumnRenamed("_qm_id", record_id), record_id, "left_semi")
        again = duplicate_classes(rest, record_id, kind, key, fields, salt_rows)
        good = good.unionByName(again.where(F.col(record_id) != F.col("class_id")).select(F.col(record_id).alias("_qm_id"), F.col("class_id").alias("_qm_rep")))
    reps = good.select("_qm_rep").distinct().select(F.col("_qm_rep").alias("_qm_id"), "_qm_rep")
    return good.unionByName(reps).select(F.col("_qm_id").alias(record_id), F.col("_qm_rep").alias("class_id"))


def duplicate_pairs(classes: DataFrame, record_id: str = "entry_id") -> DataFrame:
    """All pairs of a class, smaller id first: entry_a, entry_b."""
    a = classes.select("class_id", F.col(record_id).alias("entry_a"))
    b = classes.select("class_id", F.col(record_id).alias("entry_b"))
    return a.join(b, "class_id").where("entry_a < entry_b").select("entry_a", "entry_b")


def collapse(df: DataFrame, record_id: str = "entry_id", kind: str = "entry_type", key: str = "id", fields: str = "fields") -> DataFrame:
    """One record of each class (the one with the smallest id, whole) with `n_copies`, the number of records that it stands for.

    Input rows that share one record_id are outside this operator's contract: ids must be unique.
    """
    classes = duplicate_classes(df, record_id, kind, key, fields)
    counts = classes.groupBy(F.col("class_id").alias("_qm_c")).agg(F.count(F.lit(1)).alias("_qm_n"))
    away = classes.where(F.col(record_id) != F.col("class_id")).select(F.col(record_id).alias("_qm_away"))
    kept = df.join(away, df[record_id] == F.col("_qm_away"), "left_anti")
    name = "n_copies" if "n_copies" not in df.columns else "_qm_n_copies"
    return kept.join(counts, kept[record_id] == F.col("_qm_c"), "left").drop("_qm_c").withColumn(name, F.coalesce("_qm_n", F.lit(1))).drop("_qm_n")
