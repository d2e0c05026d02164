"""Writers. Text and JSON go through Spark's own writers; one file for each row is written by the tasks."""

from __future__ import annotations

import io
import os
import re
import wave
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """Write each row's text or bytes to its own file in a folder that all executors share: name, written, error.

    Files are written beside their place and then renamed, so a task that is run again does no harm. An action on the result writes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            rows = []
            for n, c in b.itertuples(index=False, name=None):
                try:
                    path = os.path.join(folder, os.path.basename(n))
                    part = f"{path}.{os.getpid()}.part"
                    with open(part, "wb") as f:
                        f.write(c.encode() if isinstance(c, str) else bytes(c or b""))
                    os.replace(part, path)
                    rows.append((n, True, None))
                except OSError as e:
                    rows.append((n, False, str(e)))
            yield pd.DataFrame(rows, columns=["name", "written", "error"])

    return df.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInPandas(run, "name string, written boolean, error string")


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path, lineSep="\n")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def sidecar(df: DataFrame, doc: str, pages: str) -> DataFrame:
    """name, content: the OCR JSON of a document, to be written beside it."""
    return df.select(F.concat(F.regexp_replace(doc, r"\.[^./]*$", ""), F.lit(".ocr.json")).alias("name"), F.concat(F.to_json(F.struct(F.col(pages).alias("pages")), {"pretty": "true"}), F.lit("\n")).alias("content"))


def concatenated_wav(chunks: DataFrame, group: str, order: str, wav: str) -> DataFrame:
    """group, wav, seconds, error: chunks in order as one WAV; parameters that differ, or no chunk, are an error."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        params, out, frames = None, io.BytesIO(), 0
        key = g[group].iloc[0]
        with wave.open(out, "wb") as w:
            for b in g.sort_values(order, kind="stable")[wav]:
                with wave.open(io.BytesIO(b)) as r:
                    p = (r.getnchannels(), r.getsampwidth(), r.getframerate())
                    if params is None:
                        params = p
                        w.setnchannels(p[0])
                        w.setsampwidth(p[1])
                        w.setframerate(p[2])
                    elif p != params:
                        w.writeframes(b"")
                        return pd.DataFrame([(key, None, None, f"{p} differs from {params}")], columns=[group, "wav", "seconds", "error"])
                    frames += r.getnframes()
                    w.writeframes(r.readframes(r.getnframes()))
        return pd.DataFrame([(key, out.getvalue(), frames / params[2] if params[2] else 0.0, None)], columns=[group, "wav", "seconds", "error"])

    t = chunks.schema[group].dataType.simpleString()
    return chunks.groupBy(group).applyInPandas(run, f"{group} {t}, wav binary, seconds double, error string")


def write_wavs(samples: DataFrame, folder: str, group: str, order: str = "sample_idx", value: str = "value", rate: int = 44_100, channels: int = 1) -> DataFrame:
    """name, frames, error: one 16-bit WAV for each group, its samples in order, in a folder that all executors share. An action writes.

    Groups are sorted within tasks and written as they come, so a long one needs no memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        at, out, part, path, n = None, None, "", "", 0

        def close() -> list[tuple]:
            if out is None:
                return []
            out.close()
            os.replace(part, path)
            return [(os.path.basename(path), n // channels, None)]

        for b in batches:
            done = []
            for key, g in b.groupby(group, sort=False):
                if key != at:
                    done += close()
                    path = os.path.join(folder, re.sub(r"[^A-Za-z0-9._-]", "_", str(key)) + ".wav")
                    part = f"{path}.{os.getpid()}.part"
                    at, n, out = key, 0, wave.open(part, "wb")
                    out.setnchannels(channels)
                    out.setsampwidth(2)
                    out.setframerate(rate)
                out.writeframesraw(g[value].to_numpy("<i2").tobytes())
                n += len(g)
            yield pd.DataFrame(done, columns=["name", "frames", "error"])
        yield pd.DataFrame(close(), columns=["name", "frames", "error"])

    t = samples.select(F.col(group).cast("string").alias(group), order, F.col(value).cast("int").alias(value)).where(F.col(group).isNotNull())
    return t.repartition(group).sortWithinPartitions(group, order).mapInPandas(run, "name string, frames long, error string")
