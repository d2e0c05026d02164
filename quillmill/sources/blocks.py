"""Signal as a stream of blocks: spark.readStream.format("quillmill_blocks"), after spark.dataSource.register(BlockSource).

A WAV file (or a folder of them) stands for the microphone: each file is a stream, read in blocks of block_ms, `blocks_per_batch` in a micro-batch.
"""

from __future__ import annotations

import glob
import math
import os
import wave
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "stream_id string, seq long, ms long, level double, last boolean, samples array<float>"


class _Span(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class _BlockReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.block_ms = int(options.get("block_ms", 100))
        self.each = int(options.get("blocks_per_batch", 50))
        self.at = 0

    def _files(self) -> list[tuple[str, int]]:
        """(path, blocks) of each file."""
        out = []
        for p in sorted(glob.glob(os.path.join(self.path, "*.wav"))) if os.path.isdir(self.path) else [self.path]:
            with wave.open(p) as w:
                out.append((p, math.ceil(w.getnframes() / max(1, w.getframerate() * self.block_ms // 1000))))
        return out

    def initialOffset(self) -> dict:
        return {"block": 0}

    def latestOffset(self) -> dict:
        most = max((n for _, n in self._files()), default=0)
        self.at = min(most, self.at + self.each)
        return {"block": self.at}

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        self.at = max(self.at, end["block"])
        return [_Span(p, start["block"], min(n, end["block"])) for p, n in self._files() if start["block"] < min(n, end["block"])]

    def read(self, partition: _Span) -> Iterator[tuple]:
        import numpy as np

        with wave.open(partition.path) as w:
            if w.getsampwidth() != 2:
                raise ValueError(f"{partition.path} isn't 16-bit")
            rate, total = w.getframerate(), w.getnframes()
            size = max(1, rate * self.block_ms // 1000)
            w.setpos(min(total, partition.first * size))
            for k in range(partition.first, partition.end):
                x = np.frombuffer(w.readframes(size), "<i2").reshape(-1, w.getnchannels()).mean(axis=1) / 32768
                level = float(np.sqrt(np.mean(x * x))) if len(x) else None
                yield (os.path.basename(partition.path), k, round(1000 * len(x) / rate), level, (k + 1) * size >= total, x.astype("float32").tolist())

    def commit(self, end: dict) -> None:
        pass


class BlockSource(DataSource):
    """stream_id, seq, ms, level (RMS), last, samples (mono, from -1 to 1) of 16-bit WAV files."""

    @classmethod
    def name(cls) -> str:
        return "quillmill_blocks"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _BlockReader(self.options)
