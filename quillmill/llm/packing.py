"""Problem 6: put texts into containers of fixed token capacity with little room left unused.

Lexical retrieval packing. Documents are put in random order by a hash and dealt to tasks; a task cuts its documents into shards of
bounded text size, one after another. Each shard has a BM25 inverted index; the longest unused document is a container's seed, its
best-scoring unused neighbours that fit are added, and what room is left then is filled with the largest unused documents that fit. A
document longer than the capacity fills whole containers by itself; its remainder is packed like a document. No document that fits is ever cut.

A seed is scored by all its words. Document frequencies and the mean length are those of the shard, not of all documents.

Shards are independent of each other, so the work is one shuffle of the texts, to a number of tasks that depends on the cluster and the
number of documents (which costs no reading), not on the number of shards. Tokens are counted within the shard, once for each vocabulary.
All plans share the shard's index.

Nulls: null and empty texts have no tokens and get no container; a null or non-positive capacity or null encoding is an
error of the plan and raises. Repeated rows are packed as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import tokens

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
#: A word that one document in so many has is kept as a row of the matrix; seeds that are multiplied by it at once.
OFTEN, AHEAD = 20, 63

#: Characters of text in a shard: from half to one and a half times as many, if there are as many in a task.
SHARD_CHARS = 2_000_000
#: Documents in a task, where there are few.
TASK_DOCS = 1_500
#: Plans are read on the driver; there are a handful.
MAX_PLANS = 1_000


@dataclass(frozen=True)
class Plan:
    name: str
    encoding: str
    capacity: int


class Index:
    """An inverted index of one shard: postings with their BM25 weights, term after term."""

    def __init__(self, texts: list[str]):
        ids: dict[str, int] = {}
        docs, terms, tf = [], [], []
        lengths = np.zeros(len(texts))
        self.of: list[np.ndarray] = []
        for d, t in enumerate(texts):
            words = Counter(WORD.findall(t.lower()))
            lengths[d] = sum(words.values())
            own = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
            self.of.append(own)
            docs.append(np.full(len(words), d, np.int64))
            terms.append(own)
            tf.append(np.fromiter(words.values(), np.float64, len(words)))
        docs, terms, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, terms, tf))
        df = np.bincount(terms, minlength=len(ids))
        idf = np.log1p((len(texts) - df + 0.5) / (df + 0.5))
        weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[docs] / max(1.0, lengths.mean() if len(lengths) else 1.0)))
        order = np.argsort(terms, kind="stable")
        self.docs, self.weights, self.n = docs[order], weight[order], len(texts)
        self.starts = np.concatenate(([0], np.cumsum(df)))
        # the same by document
        self.doc_terms, self.doc_weights = terms, weight
        self.doc_starts = np.concatenate(([0], np.cumsum([len(own) for own in self.of]))).astype(np.int64)
        # words that many documents have make up most postings; their weights are kept as rows of a matrix too
        often = np.flatnonzero(df * OFTEN > len(texts))
        row = np.full(len(ids), -1, np.int64)
        row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.n), np.float32)
        for k, t in enumerate(often):
            s = slice(self.starts[t], self.starts[t + 1])
            self.rows[k, self.docs[s]] = self.weights[s]
        self.common = [row[own[row[own] >= 0]] for own in self.of]
        # a word that no other document has finds nobody
        self.of = [own[df[own] > 1] for own in self.of]
        self.rare = [own[row[own] < 0] for own in self.of]
        self.reach = [int(df[own].sum()) for own in self.rare]
        self.has = np.zeros(len(ids), bool)

    def common_scores(self, seeds: list[int]) -> np.ndarray:
        """What the words of the matrix add to the scores of all documents, for several seeds at once."""
        has = np.zeros((len(seeds), len(self.rows)), np.float32)
        for k, d in enumerate(seeds):
            has[k, self.common[d]] = 1
        return has @ self.rows

    def scores(self, d: int, common: np.ndarray | None = None) -> np.ndarray:
        """The BM25 score of every document for the words of the seed; 0 where none is shared."""
        out = (self.common_scores([d])[0] if common is None else common).astype(np.float64)
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in self.rare[d]]
        if spans:
            out += np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.n)
        return out


class Neighbours:
    """Finds the unused documents that fit and score for a seed: over the postings, or over the words of all that fit, whichever are fewer."""

    def __init__(self, index: Index, free: np.ndarray, most: int):
        """free: tokens of each document, more than `most` once it's used."""
        self.index, self.free, self.most = index, free, most
        self.ahead: dict[int, np.ndarray] = {}
        self._lay_out()

    def _lay_out(self) -> None:
        i = self.index
        docs = np.flatnonzero((self.free <= self.most) & (np.diff(i.doc_starts) > 0))
        self.docs = docs[np.argsort(self.free[docs], kind="stable")]
        self.sizes = self.free[self.docs]
        n = np.diff(i.doc_starts)[self.docs]
        self.starts = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
        at = np.repeat(i.doc_starts[self.docs] - self.starts[:-1], n) + np.arange(n.sum())
        self.terms, self.weights, self.asked = i.doc_terms[at], i.doc_weights[at], 0

    def of(self, seed: int, room: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores)"""
        self.asked += 1
        if self.asked % 64 == 0 and 2 * np.count_nonzero(self.free[self.docs] <= self.most) < len(self.docs):
            self._lay_out()  # most of them are used by now
        k, i = int(np.searchsorted(self.sizes, room, "right")), self.index
        if not k or not len(i.of[seed]):
            return self.docs[:0], np.zeros(0)
        docs = self.docs[:k]
        if i.reach[seed] + i.n < self.starts[k]:
            if seed not in self.ahead:  # the largest unused ones will be the next seeds
                next_ = self.docs[self.free[self.docs] <= self.most][-AHEAD:].tolist()
                self.ahead = dict(zip([seed, *next_], i.common_scores([seed, *next_])))
            score = i.scores(seed, self.ahead[seed])[docs]
        else:
            i.has[i.of[seed]] = True
            end = self.starts[k]
            score = np.add.reduceat(np.where(i.has[self.terms[:end]], self.weights[:end], 0.0), self.starts[:k])
            i.has[i.of[seed]] = False
        good = (self.free[docs] <= room) & (score > 0)
        return docs[good], score[good]


class Unused:
    """Unused items by size, with the largest that fits found in near-constant time."""

    def __init__(self, sizes: list[int]):
        self.order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        self.sorted = [sizes[i] for i in self.order]
        self.at = {i: k for k, i in enumerate(self.order)}
        self.below = list(range(len(sizes)))  # the next unused place at or below, -1 for none
        self.low = 0
        self.used = [False] * len(sizes)

    def _find(self, k: int) -> int:
        path = []
        while k >= 0 and self.used[self.order[k]]:
            path.append(k)
            k = self.below[k] if self.below[k] < k else k - 1
        for p in path:
            self.below[p] = k
        return k

    def largest(self, room: int) -> int:
        """The largest unused item of at most that size, -1 if there is none."""
        k = self._find(bisect_right(self.sorted, room) - 1)
        return self.order[k] if k >= 0 else -1

    def smallest(self) -> int:
        while self.low < len(self.order) and self.used[self.order[self.low]]:
            self.low += 1
        return self.sorted[self.low] if self.low < len(self.order) else 1 << 62


def pack(sizes: list[int], index: Index, capacity: int) -> list[list[tuple[int, int, int, int]]]:
    """Containers of (document, piece, first token, tokens)."""
    out, rest, piece = [], list(sizes), [0] * len(sizes)
    for d, n in enumerate(sizes):
        if n > capacity:
            full = n // capacity
            out += [[(d, k, k * capacity, capacity)] for k in range(full)]
            rest[d], piece[d] = n - full * capacity, full
    items = [d for d, n in enumerate(rest) if n > 0]
    unused = Unused([rest[d] for d in items])
    place = np.full(len(sizes), -1, np.int64)
    place[items] = np.arange(len(items))
    free = np.array([n if n > 0 else capacity + 1 for n in rest], np.int64)  # tokens of what is unused, more than any room where it is used
    near = Neighbours(index, free, capacity)
    part = lambda d: (d, piece[d], sizes[d] - rest[d], rest[d])
    while (i := unused.largest(capacity)) >= 0:
        seed = items[i]
        unused.used[i], free[seed] = True, capacity + 1
        one, room = [part(seed)], capacity - rest[seed]
        if room >= unused.smallest():
            fit, score = near.of(seed, room)
            while len(fit):  # the best neighbour that fits, then the best of those that still do
                k = int(np.argmax(score))
                d = int(fit[k])
                unused.used[place[d]], free[d] = True, capacity + 1
                one.append(part(d))
                room -= rest[d]
                still = free[fit] <= room
                fit, score = fit[still], score[still]
        while (j := unused.largest(room)) >= 0:
            unused.used[j], free[items[j]] = True, capacity + 1
            one.append(part(items[j]))
            room -= rest[items[j]]
        out.append(one)
    return out


def read_plans(plans: DataFrame) -> list[Plan]:
    rows = plans.select("plan", "encoding", "capacity_tokens").limit(MAX_PLANS + 1).collect()
    if len(rows) > MAX_PLANS:
        raise ValueError(f"more than {MAX_PLANS} plans; pack them in several calls")
    bad = [r.plan for r in rows if r.capacity_tokens is None or r.capacity_tokens < 1 or r.encoding is None]
    if bad:
        raise ValueError(f"plans without a positive capacity or an encoding: {bad}")
    return sorted((Plan(r.plan, r.encoding, r.capacity_tokens) for r in rows), key=lambda p: str(p.name))


OUT = "plan string, encoding string, vocabulary string, capacity_tokens int, container string, place int, doc_id {id}, piece_no int, first_token int, n_tokens int, container_tokens int"


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[str], pa.DataType]]:
    """(ids, texts, type of the ids) of each shard of a task, in order."""
    ids, texts, chars, kind = [], [], 0, None
    for b in batches:
        kind = b.schema.field("_qm_id").type
        for i, t in zip(b.column("_qm_id").to_pylist(), b.column("_qm_text").to_pylist()):
            ids.append(i)
            texts.append(t)
            chars += len(t)
            if chars >= 1.5 * most:  # what stays behind is half a shard at least, so the last one is none that's hard to fill
                n, own = 0, 0
                while own < most:
                    own += len(texts[n])
                    n += 1
                yield ids[:n], texts[:n], kind
                ids, texts, chars = ids[n:], texts[n:], chars - own
    if ids:
        yield ids, texts, kind


def pack_documents(docs: DataFrame, plans: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = tokens.TOKENIZER_DIR, vocabularies: dict[str, str] | None = None, shard_chars: int = SHARD_CHARS, task_docs: int = TASK_DOCS) -> DataFrame:
    """One row for each document (or piece of a document over the capacity) of each plan, with its container."""
    wanted = read_plans(plans)
    named = vocabularies or tokens.VOCABULARIES
    of = {p.encoding: tokens.vocabulary_of(p.encoding, named) for p in wanted}
    spark = docs.sparkSession
    most_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    tasks = max(1, min(most_tasks, math.ceil(docs.count() / task_docs)))
    t = docs.select(F.col(doc_id).alias("_qm_id"), F.col(text).alias("_qm_text")).where("length(_qm_text) > 0")
    out = OUT.format(id=t.schema["_qm_id"].dataType.simpleString())
    names = [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, (ids, texts, kind) in enumerate(_shards(batches, shard_chars)):
            counts = {v: tokens.count(texts, v, folder) for v in set(of.values())}
            index, ids = Index(texts), pa.array(ids, kind)
            for p in wanted:
                packed = pack(counts[of[p.encoding]], index, p.capacity)
                n = np.array([len(one) for one in packed], np.int64)
                parts = np.array([x for one in packed for x in one], np.int64).reshape(-1, 4)
                of_row = np.repeat(np.arange(len(packed)), n)
                totals = np.bincount(of_row, parts[:, 3], len(packed)).astype(np.int32)
                constant = [pa.repeat(pa.scalar(x, pa.string()), len(parts)) for x in (p.name, p.encoding, of[p.encoding])] + [pa.repeat(pa.scalar(p.capacity, pa.int32()), len(parts))]
                containers = pa.array([f"{task}-{k}-{c}" for c in range(len(packed))], pa.string()).take(pa.array(of_row))
                place = np.arange(len(parts)) - np.repeat(np.cumsum(n) - n, n)
                numbers = [pa.array(x.astype(np.int32)) for x in (parts[:, 1], parts[:, 2], parts[:, 3], totals[of_row])]
                yield pa.RecordBatch.from_arrays([*constant, containers, pa.array(place.astype(np.int32)), ids.take(pa.array(parts[:, 0])), *numbers], names=names)

    # the order within a task is fixed, so a task that is run again gives the same containers
    order = t.withColumn("_qm_h", F.xxhash64("_qm_id", "_qm_text"))
    return order.repartition(tasks, "_qm_h").sortWithinPartitions("_qm_h", "_qm_id", "_qm_text").select("_qm_id", "_qm_text").mapInArrow(run, out)


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens and share of the capacity filled, for each plan."""
    c = packed.groupBy("plan", "encoding", "vocabulary", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("n"))
    c = c.groupBy("plan", "encoding", "vocabulary", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"))
    return c.withColumn("filled", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))
