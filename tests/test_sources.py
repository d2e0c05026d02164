import io
import os
import re
import wave

import pytest
from pyspark.sql import functions as F

from quillmill.operators.components import components
from quillmill.operators.prefilter import keep_possible
from quillmill.sources import arguments, blocks, external, files, pdf, sinks, web
from quillmill.streaming import buffering


def small_pdf(n):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (n, b" ".join(b"%d 0 R" % (3 + k) for k in range(n)))]
    objects += [b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d 10] >>" % (k + 1) for k in range(n)]
    out, at = b"%PDF-1.4\n", []
    for k, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, o)
    table = len(out)
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(at) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at) + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(at) + 1, table)


def test_pages_are_chosen(spark):
    df = spark.createDataFrame([("a", small_pdf(5), "1,4-6"), ("b", small_pdf(2), "9"), ("c", b"no", "1"), ("d", small_pdf(3), None), ("e", None, None)], "path string, content binary, pages string")
    r = {x.path: x for x in pdf.chosen_pages(df).collect()}
    assert r["a"].n_pages == 5 and r["a"].skipped == [5] and pdf.page_count(bytes(r["a"].pruned)) == 3
    assert re.findall(rb"\d+ 0 R", pdf._tree(bytes(r["a"].pruned))[2].split(b"[")[1]) == [b"3 0 R", b"6 0 R", b"7 0 R"]
    at = int(re.findall(rb"startxref\s+(\d+)", bytes(r["a"].pruned))[-1])
    assert bytes(r["a"].pruned)[at : at + 4] == b"xref"
    assert r["b"].error == "no page is left" and r["c"].error == "not a PDF" and r["e"].error and r["b"].pruned is None
    assert bytes(r["d"].pruned) == small_pdf(3)
    assert pdf.chosen_pages(df.where("path = 'x'")).count() == 0


def test_charsets():
    assert web.decode("é".encode("latin-1"), "iso-8859-1") == "é" and web.decode("é".encode(), None) == "é"
    assert web.decode("é".encode("cp1252"), None) == "é" and web.decode("é".encode("utf-16"), None) == "é"
    assert web.decode(b'<meta charset="koi8-r">' + "п".encode("koi8-r"), "no-such") == '<meta charset="koi8-r">п'
    assert web.decode(b"\xff", "utf-8") == "�" and web.decode(None, None) is None and web.decode(b"", None) == ""


def test_mixes_are_written_as_wav(spark, tmp_path):
    rows = [("m/1", k, (k * 37) % 2000 - 1000) for k in range(5000)] + [("n", 0, 5)]
    df = spark.createDataFrame(rows, "mix string, sample_idx long, value int").repartition(3)
    got = {r.name: r.frames for r in sinks.write_wavs(df, str(tmp_path), "mix", rate=8000).collect()}
    assert got == {"m_1.wav": 5000, "n.wav": 1}
    with wave.open(str(tmp_path / "m_1.wav")) as w:
        data = w.readframes(5000)
    assert [int.from_bytes(data[2 * k : 2 * k + 2], "little", signed=True) for k in (0, 1, 4999)] == [rows[k][2] for k in (0, 1, 4999)]


def test_arguments(tmp_path):
    assert arguments.dedupe_modes("Key, doi") == (["key", "doi"], []) and len(arguments.dedupe_modes("year,")[1]) == 1 and arguments.dedupe_modes(" ,")[1]
    (tmp_path / "a.pdf").write_bytes(b"")
    (tmp_path / "b.txt").write_text("")
    p = lambda n: str(tmp_path / n)
    assert not arguments.pdf_run(p("a.pdf"), "1") and arguments.pdf_run(p("b.txt")) and arguments.pdf_run(p("c")) and len(arguments.pdf_run(str(tmp_path), "1", p("b.txt"))) == 2
    assert len(arguments.narration(p("b.txt"), 10, 0)) == 3 and arguments.image_input(p("b.txt")) and not arguments.image_input(str(tmp_path))
    assert arguments.ocr_options(True, {"table_format": "html", "model": "m"}) == ({"table_format": "none", "model": "m"}, ["table_format"])
    assert arguments.ocr_options(False, {"table_format": "html"})[1] == [] and arguments.merge_inputs(p("a.pdf"), p("x"), str(tmp_path))[0].endswith("x isn't there")


def test_models_are_not_fetched_silently(tmp_path):
    assert external.model_path(str(tmp_path), "d") == os.path.realpath(tmp_path) and external.model_path("org/name", "~/none/default") == "org/name"
    with pytest.raises(RuntimeError):
        external.model_path("~/none/default", "~/none/default")


def test_rejects_and_languages(spark, tmp_path):
    for n in ("a.mp3", "b.MP3", "c.doc", "d.py", "e.zz"):
        (tmp_path / n).write_text("x = 1\n")
    assert files.audio_files(spark, str(tmp_path)).count() == 2 and files.speech_files(spark, str(tmp_path)).count() == 2
    assert files.rejected(spark, str(tmp_path), files.AUDIO_SUFFIXES).count() == 3
    code = {r.path.rsplit("/", 1)[1]: (r.language, r.error) for r in files.source_files(spark, str(tmp_path)).collect()}
    assert code["d.py"] == ("python", None) and code["e.zz"] == (None, "unknown language")


def tone(values, rate=1000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"".join(v.to_bytes(2, "little", signed=True) for v in values))
    return out.getvalue()


def test_a_recording_is_a_stream(spark, tmp_path):
    """A WAV file read in blocks over several micro-batches gives the segments that the whole file gives."""
    values = [9000] * 1200 + [0] * 400 + [9000] * 6600 + [0] * 30
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(tone(values))
    spark.dataSource.register(blocks.BlockSource)
    s = spark.readStream.format("quillmill_blocks").option("blocks_per_batch", 9).load(str(tmp_path / "in"))
    q = buffering.silence_segments_stream(s, idle_ms=None).writeStream.format("memory").queryName("said").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for _ in range(40):
            q.processAllAvailable()
            if spark.sql("select 1 from said where reason = 'end'").count():
                break
        got = sorted((r.segment, r.first_seq, r.last_seq, r.reason) for r in spark.sql("select * from said").collect())
        batches = len({p.batchId for p in q.recentProgress if p.numInputRows})
    finally:
        q.stop()
    block = spark.createDataFrame([("a", k, 100 if 100 * k + 100 <= len(values) else len(values) % 100, 0.0 if all(v == 0 for v in values[100 * k : 100 * k + 100]) else 1.0) for k in range(-(-len(values) // 100))], "stream_id string, seq long, ms long, level double")
    assert got == sorted((r.segment, r.first_seq, r.last_seq, r.reason) for r in buffering.silence_segments(block).collect()) and len(got) == 3
    assert batches > 3


def test_blocks_and_buffers(spark):
    assert buffering.blocks_in(3000, 100) == 30 and buffering.blocks_in(100, 99) == 2 and buffering.block_samples(44_100, 0.0333) == 1468
    b = spark.createDataFrame([("s", k, [float(k), 0.5]) for k in (1, 0, 2)], "stream_id string, seq long, samples array<float>")
    assert [tuple(r) for r in buffering.buffered_samples(b, 2).collect()] == [("s", 0, [0.0, 0.5, 1.0, 0.5])]


def test_only_rows_that_may_meet_are_kept(spark):
    d, keys = spark.range(20_000), spark.range(0, 20_000, 500).unionByName(spark.createDataFrame([(None,)], "id long"))
    for words in (1, 64):
        kept = keep_possible(d, "id", keys, words)
        assert kept.join(keys, "id").count() == 40 and kept.count() < 1000
    assert keep_possible(d, "id", keys.where("id < 0")).count() == 0


def test_long_chains_and_wide_stars(spark):
    chain = spark.range(100_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1, 100_000).select(F.lit(1_000_000).alias("a"), (F.col("id") + 1_000_000).alias("b"))
    got = {r.label: r.n for r in components(chain.unionByName(star)).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {0: 100_001, 1_000_000: 100_000}
