"""Models, services and programs outside the engine: an interface, a runner in Arrow batches, and stubs that say that they are.

An engine is loaded once for each task and fed batches; a failure is the row's, not the job's.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Kinds of engine.
KINDS = ("speech_to_text", "text_to_speech", "page_ocr", "image_ocr", "ocr_service", "upload", "fetch", "render", "rasterize", "separate", "download")


class Engine(Protocol):
    """Gives a result for each input, in order; `name` is what the results are labelled with."""

    name: str

    def run(self, inputs: list) -> list[str]: ...


class Stub:
    """Stands in for an engine that isn't here: a digest of the input, labelled `stub`."""

    name = "stub"

    def __init__(self, kind: str):
        if kind not in KINDS:
            raise ValueError(f"unknown kind of engine: {kind}")
        self.kind = kind

    def run(self, inputs: list) -> list[str]:
        return [f"{self.kind}:{hashlib.sha256(str(x).encode()).hexdigest()[:16]}" for x in inputs]


def apply(df: DataFrame, column: str, engine: Callable[[], Engine], batch: int = 4, whole: str | None = None) -> DataFrame:
    """Adds result, engine, error. With `whole`, one failed row makes all rows of that group fail."""

    out = StructType([*df.schema.fields, *[StructField(c, StringType()) for c in ("result", "engine", "error")]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = engine()
        for b in batches:
            results, errors = [], []
            for k in range(0, len(b), batch):
                part = b[column].iloc[k : k + batch].tolist()
                try:
                    results += e.run(part)
                    errors += [None] * len(part)
                except Exception:  # the batch again, one by one
                    for x in part:
                        try:
                            results += e.run([x])
                            errors.append(None)
                        except Exception as why:
                            results.append(None)
                            errors.append(str(why))
            yield b.assign(result=results, engine=e.name, error=errors)

    r = df.mapInPandas(run, out)
    if whole is None:
        return r
    bad = r.where("error is not null").select(whole).distinct().withColumn("_bad", F.lit(True))
    return r.join(bad, whole, "left").withColumn("result", F.when(F.col("_bad").isNull(), F.col("result"))).drop("_bad")


def device(kind: str, requested: str, has_gpu: bool) -> tuple[str, str]:
    """(device, precision): speech recognition falls back to the CPU, speech synthesis doesn't."""
    if kind == "text_to_speech" and requested in ("auto", "cuda") and not has_gpu:
        raise RuntimeError("speech synthesis needs a GPU")
    on = requested if requested != "auto" else "cuda" if has_gpu else "cpu"
    return on, "float16" if on == "cuda" else "int8"


def model_path(name: str, default: str) -> str:
    """The path of a model, or the name of one that an engine knows. The default model must be there: nothing is downloaded silently."""
    path = os.path.expanduser(name)
    if os.path.exists(path):
        return os.path.realpath(path)
    if name == default:
        raise RuntimeError(f"the default model {default} isn't there; fetch it first, or name another")
    return name
