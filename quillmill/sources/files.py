"""Files as tables: text trees, collections by suffix, Markdown, source code, OCR sidecars, WAV."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import callgraph, ocr

# Suffixes of audio that can be separated, and that speech can be recognised in.
AUDIO_SUFFIXES = [".mp3", ".wav", ".flac", ".ogg", ".m4a", ".aac", ".wma"]
SPEECH_SUFFIXES = [".mp3", ".wav", ".flac", ".ogg", ".m4a", ".webm"]


def listing(spark: SparkSession, path: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length of files: contents aren't read, as they aren't selected."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select("path", "modificationTime", "length")


def collection(spark: SparkSession, path: str, suffixes: list[str], recursive: bool = False) -> DataFrame:
    """Distinct files of some suffixes, any case, with pos by path."""
    f = listing(spark, path, recursive).where(T.suffix_of(F.col("path")).isin(suffixes)).dropDuplicates(["path"])
    return f.orderBy("path")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    return listing(spark, path, False, "*.[pP][dD][fF]").orderBy("path")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    return collection(spark, path, T.IMAGE_SUFFIXES)


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    return collection(spark, path, AUDIO_SUFFIXES)


def speech_files(spark: SparkSession, path: str) -> DataFrame:
    return collection(spark, path, SPEECH_SUFFIXES)


def rejected(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """path, error of the files that a collection of these suffixes leaves out."""
    return listing(spark, path, False).where(~T.suffix_of(F.col("path")).isin(suffixes)).select("path", F.concat(F.lit("not supported: "), T.suffix_of(F.col("path"))).alias("error"))


def text_tree(spark: SparkSession, path: str, all_files: bool = False, single_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts, rejects). texts: path, text (newlines made one), chars, bytes, is_text; rejects: path, error.

    Only files of the known suffixes, unless all_files, or a single file is named: the filter is a glob, so other files aren't read.
    Files that aren't UTF-8 are rejected by themselves. Names that begin with `_` or `.`, and files of no length, are hidden to Spark's file index.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if not (all_files or single_file):
        either = ",".join("*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in T.TEXT_SUFFIXES)
        r = r.option("pathGlobFilter", "{" + either + "}")
    f = r.load(path)
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    texts = f.where(ok).select("path", F.regexp_replace(F.col("content").cast("string"), "\r\n?", "\n").alias("text"), F.col("length").alias("bytes"))
    rejects = f.where(~ok).select("path", F.lit("not UTF-8").alias("error"))
    return texts.select("path", "text", F.length("text").alias("chars"), "bytes", F.lit(True).alias("is_text")), rejects


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of .md and .markdown files."""
    r = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="{*.md,*.markdown,*.MD}")
    return r.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, language, error: Python, C and C++ files; a file of another language has an error and no text."""
    r = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    p = F.col("_metadata.file_path")
    known = callgraph.language(p).isNotNull()
    return r.select(p.alias("path"), F.when(known, F.col("value")).alias("text"), callgraph.language(p).alias("language"), F.when(~known, "unknown language").alias("error"))


def ocr_responses(spark: SparkSession, path: str) -> DataFrame:
    """doc, pages of OCR JSON sidecars; what else a response holds is kept in `raw` as a variant."""
    r = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.ocr.json")
    return r.select(F.col("_metadata.file_path").alias("doc"), F.from_json("value", ocr.RESPONSE)["pages"].alias("pages"), F.try_parse_json("value").alias("raw"))


WAV = "path string, channels int, width int, rate int, frames long, seconds double, error string"


def wav_headers(spark: SparkSession, path: str) -> DataFrame:
    """Parameters of WAV files; a file that can't be read has an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in b.itertuples(index=False, name=None):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        n, rate = w.getnframes(), w.getframerate()
                        rows.append((p, w.getnchannels(), w.getsampwidth(), rate, n, n / rate if rate else 0.0, None))
                except (wave.Error, EOFError) as e:
                    rows.append((p, None, None, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "channels", "width", "rate", "frames", "seconds", "error"]).astype({"channels": "Int32", "width": "Int32", "rate": "Int32", "frames": "Int64"})

    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[wW][aA][vV]").load(path)
    return f.select("path", "content").mapInPandas(run, WAV)


def wav_samples(spark: SparkSession, path: str) -> DataFrame:
    """path, sample_idx, value of 16-bit WAV files, channels interleaved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            for p, content in b.itertuples(index=False, name=None):
                with wave.open(io.BytesIO(content)) as w:
                    if w.getsampwidth() != 2:
                        continue
                    while len(part := np.frombuffer(w.readframes(1 << 16), dtype="<i2")):
                        at = (w.tell() * w.getnchannels()) - len(part)
                        yield pd.DataFrame({"path": p, "sample_idx": np.arange(at, at + len(part)), "value": part.astype("int32")})

    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[wW][aA][vV]").load(path)
    return f.select("path", "content").mapInPandas(run, "path string, sample_idx long, value int")
