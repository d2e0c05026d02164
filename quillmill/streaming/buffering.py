"""Signal buffered in order of arrival: by fixed duration, or up to a silence; in batch and as streams.

Blocks: stream_id, seq (from 0, without gaps), ms, level (RMS), and where a stream can end, last (true for its last block). Durations are
whole milliseconds, so batch and stream agree exactly.

Streams: a micro-batch's rows come in any order, so blocks are taken by seq; those that come too early wait in the state. They are taken
frame by frame. What is left of a stream is passed on at its last block, or by a timer when it falls silent.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SEGMENT = "stream_id string, segment long, first_seq long, last_seq long, n_blocks int, ms long, reason string"


@dataclass(frozen=True)
class Rules:
    """When buffered signal is passed on."""

    block_ms: int = 100
    least_ms: int = 1000
    most_ms: int = 5000
    silence_ms: int = 300
    level: float = 0.01


@dataclass
class Buffer:
    """What is buffered of one stream."""

    segment: int = 0
    first: int = -1
    last: int = -1
    blocks: int = 0
    ms: int = 0
    quiet: int = 0

    def take(self, seq: int, ms: int, level: float | None, rules: Rules) -> tuple | None:
        """Adds a block; gives the segment that is complete with it. A null level counts as silence."""
        self.first = seq if self.first < 0 else self.first
        self.last, self.blocks, self.ms = seq, self.blocks + 1, self.ms + ms
        self.quiet = self.quiet + ms if level is None or level < rules.level else 0
        if self.ms >= rules.most_ms:
            return self.pass_on("full")
        if self.quiet >= rules.silence_ms and self.ms >= rules.least_ms:
            return self.pass_on("silence")
        return None

    def rest(self, rules: Rules, idle: bool = False) -> tuple | None:
        """What is left when nothing comes any more: when idle only after some silence, else whatever is long enough."""
        if self.ms >= rules.least_ms and (self.quiet > 0 or not idle):
            return self.pass_on("idle" if idle else "end")
        return None

    def pass_on(self, why: str) -> tuple:
        out = (self.segment, self.first, self.last, self.blocks, self.ms, why)
        self.segment, self.first, self.last, self.blocks, self.ms, self.quiet = self.segment + 1, -1, -1, 0, 0, 0
        return out


def silence_segments(blocks: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Segments of finished streams: stream_id, segment, first_seq, last_seq, n_blocks, ms, reason.

    blocks: stream_id, seq, ms, level. Streams are sorted within partitions and folded one block at a time in constant memory, so a long
    stream needs no group in memory.
    """
    t = blocks.select(F.col("stream_id").cast("string").alias("stream_id"), "seq", "ms", "level").repartition("stream_id").sortWithinPartitions("stream_id", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, buffer, rows = None, Buffer(), []
        for b in batches:
            for stream, seq, ms, level in b.itertuples(index=False, name=None):
                if stream != at:
                    if at is not None and (left := buffer.rest(rules)):
                        rows.append((at, *left))
                    at, buffer = stream, Buffer()
                if done := buffer.take(seq, ms, None if level is None or level != level else level, rules):
                    rows.append((at, *done))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENT.split(", ")])
            rows = []
        if at is not None and (left := buffer.rest(rules)):
            yield pd.DataFrame([(at, *left)], columns=[c.split()[0] for c in SEGMENT.split(", ")])

    return t.mapInPandas(run, SEGMENT)


class _Ordered(StatefulProcessor):
    """Takes the blocks of a stream one by one in the order of seq, over any number of micro-batches."""

    COLUMNS: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "seq long")
        self.early = handle.getMapState("early", "seq long", "ms long, level double, last boolean")

    def blocks(self, rows: Iterable[pd.DataFrame]) -> Iterator[tuple]:
        """(seq, ms, level, last) in order; a block before the one expected has been taken already."""
        due = self.next.get()[0] if self.next.exists() else 0
        for frame in rows:
            for seq, ms, level, last in frame.sort_values("seq")[["seq", "ms", "level", "last"]].itertuples(index=False, name=None):
                block = (int(ms), None if level is None or level != level else float(level), last is not None and last == True)  # noqa: E712
                if seq > due:
                    self.early.updateValue((int(seq),), block)
                while seq == due:
                    yield (due, *block)
                    due += 1
                    if not self.early.containsKey((due,)):
                        break
                    seq, block = due, tuple(self.early.getValue((due,)))
                    self.early.removeKey((due,))
        self.next.update((due,))

    def close(self) -> None:
        pass


class SilenceProcessor(_Ordered):
    """The same rules over a stream, with a timer for streams that fall silent."""

    COLUMNS = [c.split()[0] for c in SEGMENT.split(", ")]

    def __init__(self, rules: Rules = Rules(), idle_ms: int | None = 500):
        self.rules, self.idle_ms = rules, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("buffer", "segment long, first long, last long, blocks int, ms long, quiet long")

    def _load(self) -> Buffer:
        return Buffer(*self.state.get()) if self.state.exists() else Buffer()

    def _save(self, b: Buffer) -> None:
        self.state.update((b.segment, b.first, b.last, b.blocks, b.ms, b.quiet))

    def handleInputRows(self, key: tuple, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        b, out = self._load(), []
        for seq, ms, level, last in self.blocks(rows):
            if done := b.take(seq, ms, level, self.rules):
                out.append((key[0], *done))
            if last and (left := b.rest(self.rules)):
                out.append((key[0], *left))
        self._save(b)
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        b = self._load()
        left = b.rest(self.rules, idle=True)
        self._save(b)
        yield pd.DataFrame([(key[0], *left)] if left else [], columns=self.COLUMNS)


def _streaming(blocks: DataFrame) -> DataFrame:
    last = F.coalesce("last", F.lit(False)) if "last" in blocks.columns else F.lit(False)
    level = F.col("level").cast("double") if "level" in blocks.columns else F.lit(None).cast("double")
    return blocks.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.col("ms").cast("long").alias("ms"), level.alias("level"), last.alias("last"))


def silence_segments_stream(blocks: DataFrame, rules: Rules = Rules(), idle_ms: int | None = 500) -> DataFrame:
    """Segments of a streaming DataFrame of blocks; needs the RocksDB state store. idle_ms None: what is left waits for the last block."""
    return _streaming(blocks).groupBy("stream_id").transformWithStateInPandas(SilenceProcessor(rules, idle_ms), SEGMENT, "Append", "None" if idle_ms is None else "ProcessingTime")


def blocks_in(buffer_ms: int, block_ms: int) -> int:
    """Blocks until a buffer of so many milliseconds is full; two where the blocks, cut to whole samples, are a little shorter than the buffer."""
    return max(1, -(-buffer_ms // block_ms))


def block_samples(rate: int, seconds: float) -> int:
    """Whole samples of a block: a fraction is cut off, so the block may be shorter than asked for."""
    return int(rate * seconds)


def buffered_samples(blocks: DataFrame, blocks_each: int) -> DataFrame:
    """stream_id, buffer, samples: the samples of whole buffers in a row. blocks: stream_id, seq, samples. A group is one buffer."""
    g = blocks.groupBy("stream_id", F.floor(F.col("seq") / blocks_each).alias("buffer")).agg(F.array_sort(F.collect_list(F.struct("seq", "samples"))).alias("b"))
    return g.where(F.size("b") == blocks_each).select("stream_id", "buffer", F.flatten(F.transform("b", lambda x: x["samples"])).alias("samples"))


def fixed_buffers(blocks: DataFrame, blocks_each: int) -> DataFrame:
    """stream_id, buffer, first_seq, last_seq, ms: whole buffers of so many blocks; the rest of a stream is dropped.

    The place of a block is its seq, which counts from 0 without gaps, so no window over the stream is needed.
    """
    g = blocks.groupBy("stream_id", F.floor(F.col("seq") / blocks_each).alias("buffer"))
    return g.agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("ms").alias("ms"), F.count(F.lit(1)).alias("n")).where(F.col("n") == blocks_each).drop("n")


class FixedProcessor(_Ordered):
    """Buffers of a fixed number of blocks over a stream."""

    COLUMNS = ["stream_id", "buffer", "first_seq", "last_seq", "ms"]

    def __init__(self, blocks_each: int):
        self.each = blocks_each

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("buffer", "buffer long, first long, n int, ms long")

    def handleInputRows(self, key: tuple, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        buffer, first, n, ms = self.state.get() if self.state.exists() else (0, -1, 0, 0)
        out = []
        for seq, block_ms, _, _ in self.blocks(rows):
            first, n, ms = (seq if n == 0 else first), n + 1, ms + block_ms
            if n == self.each:
                out.append((key[0], buffer, first, seq, ms))
                buffer, first, n, ms = buffer + 1, -1, 0, 0
        self.state.update((buffer, first, n, ms))
        yield pd.DataFrame(out, columns=self.COLUMNS)


def fixed_buffers_stream(blocks: DataFrame, blocks_each: int) -> DataFrame:
    return _streaming(blocks).groupBy("stream_id").transformWithStateInPandas(FixedProcessor(blocks_each), "stream_id string, buffer long, first_seq long, last_seq long, ms long", "Append", "None")
