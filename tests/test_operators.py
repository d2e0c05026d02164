import io
import json
import wave

from pyspark.sql import functions as F

from quillmill.operators import audio, callgraph, markdown, ocr, report, webpage
from quillmill.operators.components import components
from quillmill.sources import external, files, sinks


def test_markdown_blocks():
    text = "# Title one\n\nText with [a link](http://x.example/y) and **bold\nwords**.\n\n- first\n- second\n"
    assert markdown.speakable(text, "en") == ["Title one", "Text with a link and bold words.", "first", "second"]
    rest = "```\ncode\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n<div>\nx\n</div>\n\n![alt](i.png)\n\n[^1]: note\n"
    assert markdown.speakable(rest, "en") == ["Code block omitted.", "Table omitted.", "HTML block omitted.", "Image omitted.", "Footnote omitted."]
    assert markdown.speakable("```\nx\n```\n\n[^a]: y", "pt-br") == ["Bloco de codigo omitido.", "Nota de rodape omitida."]
    assert markdown.speakable("line one  \nline two `c*d`[^2]\n\n    code\n\n> quote\nlazy\n\nHead\n===", None) == ["line one. line two c*d", "Code block omitted.", "quote lazy", "Head"]
    assert markdown.speakable(None, "en") == [] and markdown.speakable("", "xx") == []


def test_web_page_tiers():
    body = "<p>" + "Words of the text. " * 12 + "</p>"
    page = f"<html><body><nav><a href='/'>Home</a></nav><div class='main-content x'>{body}</div></body></html>"
    assert webpage.container(page).startswith("<div class='main-content x'>")
    md, tier = webpage.extract(page)
    assert tier == "dense_text" and "Home" not in md and md.startswith("Words of")
    assert webpage.extract("<body><h2>A</h2><ul><li>b <b>c</b></li></ul><script>x</script></body>") == ("## A\n\n* b **c**\n", "container")
    assert webpage.extract(None) is None and webpage.container("plain") is None


def test_ocr(spark):
    rows = [("d.pdf", [(0, "A ![i](x)\n", [("x", "data:image/jpeg;base64,QUI=")]), None, (1, None, None)])]
    df = spark.createDataFrame(rows, "doc string, pages array<struct<index:int,markdown:string,images:array<struct<id:string,image_base64:string>>>>")
    p = ocr.pages(df)
    assert [(r.place, r.markdown) for r in p.orderBy("place").collect()] == [(0, "A ![i](x)\n"), (2, "")]
    assert ocr.document_text(df).first().markdown == "A ![i](d_p001_img001.jpg)\n\n\n---\n\n"
    i = ocr.images(p).first()
    assert (i.path, bytes(i.data)) == ("d_p001_img001.jpg", b"AB")
    assert ocr.pages_from_json(spark.createDataFrame([("d", "{}"), ("e", "broken")], "doc string, j string"), "doc", "j").count() == 0
    box = lambda x, y: [[x, y], [x + 5.0, y], [x + 5.0, y + 10.0], [x, y + 10.0]]
    b = spark.createDataFrame([("i", box(9.0, 1.0), "two", 0.9), ("i", box(1.0, 3.0), "one", 0.9), ("i", box(1.0, 30.0), "three", 0.9), ("i", box(1.0, 30.0), "no", 0.1)], "image string, bbox array<array<double>>, text string, conf double")
    assert ocr.boxes_to_text(b).first().text == "one two\nthree"


def test_call_graph(spark):
    names, edges = callgraph.python_calls("def f():\n    g(1)\n    a.b()\n    async def n():\n        k()\n\n@deco()\ndef g(x=h()):\n    pass\ng()\n")
    assert names == ["f", "g"] and edges == [("f", "g"), ("f", "b"), ("f", "k"), ("g", "h"), ("g", "deco")]
    assert callgraph.c_calls("int f(int a) { if (g(a)) { return h(\"k()\"); } return 0; }") == (["f"], [("f", "g"), ("f", "h")])
    src = spark.createDataFrame([("m.py", "def a():\n    b(); b(); z()\n\ndef b():\n    pass\n"), ("x.py", "def (")], "path string, text string")
    x = callgraph.extract(src)
    assert x.where("kind = 'error'").count() == 1
    g = callgraph.adjacency(x.where("kind = 'edge'"), x.where("kind = 'node'").select("file", F.col("caller").alias("name")))
    assert {r.name: r.callees for r in g.collect()} == {"a": ["b", "b"], "b": []}
    text = callgraph.dot(g).first().dot
    assert text.count('"a" -> "b";') == 1 and text.endswith("}") and '  "b";' in text
    assert json.loads(callgraph.graph_json(g).first().json) == {"a": ["b", "b"], "b": []}


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 60), (7, 7), (None, 3)], "a long, b long")
    assert {(r.node, r.label) for r in components(e).collect()} == {(k, 0) for k in range(21)} | {(50, 50), (60, 50)}
    assert components(e.where("a > 100")).count() == 0


def test_audio(spark):
    t = spark.createDataFrame([("m", 0, 0.0, 0, 30000), ("m", 0, 0.0, 1, -5), ("m", 1, None, 0, 30000), ("m", 1, None, 5, 7)], "mix string, track_no int, volume_db double, sample_idx long, value int")
    assert {(r.sample_idx, r.value) for r in audio.mix(t).collect()} == {(0, 32767), (1, -5)}
    s = spark.createDataFrame([("a", 100, " hi "), ("a", 0, "first"), ("a", 50, " ")], "audio string, start long, text string")
    assert audio.transcript(s).first().text == "[00:00.00] first\n[00:01.00] hi"
    assert audio.transcript(s, timestamps=False).first().text == "first hi"
    p = spark.createDataFrame([("i", 1, 2, 0, 0, 0, 255), ("i", 3, 4, 0, 0, 0, 0), ("j", 0, 0, 255, 255, 255, 255)], "img string, x int, y int, r int, g int, b int, a int")
    assert {r.img: tuple(r)[1:] for r in audio.bounding_box(p).collect()} == {"i": (1, 2, 2, 3), "j": (None, None, None, None)}


def wav(values, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"".join(v.to_bytes(2, "little", signed=True) for v in values))
    return out.getvalue()


def test_wav_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav([1, -2, 3]))
    (tmp_path / "b.wav").write_bytes(b"no")
    h = {r.path.rsplit("/", 1)[1]: r for r in files.wav_headers(spark, str(tmp_path)).collect()}
    assert h["a.wav"].frames == 3 and h["a.wav"].seconds == 3 / 8000 and h["b.wav"].error
    (tmp_path / "b.wav").unlink()
    assert [(r.sample_idx, r.value) for r in files.wav_samples(spark, str(tmp_path)).orderBy("sample_idx").collect()] == [(0, 1), (1, -2), (2, 3)]
    c = spark.createDataFrame([("d", 1, wav([2])), ("d", 0, wav([1])), ("e", 0, wav([1])), ("e", 1, wav([1], 16000))], "doc string, n int, wav binary")
    r = {x.doc: x for x in sinks.concatenated_wav(c, "doc", "n", "wav").collect()}
    assert wave.open(io.BytesIO(r["d"].wav)).getnframes() == 2 and r["e"].error


def test_text_tree_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.MD").write_bytes(b"x\r\ny")
    (tmp_path / "in" / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "in" / "c.bin").write_bytes(b"z")
    good, bad = files.text_tree(spark, str(tmp_path / "in"))
    assert [(r.text, r.chars, r.bytes) for r in good.collect()] == [("x\ny", 3, 4)] and bad.count() == 1
    assert sinks.write_files(good.select(F.lit("o.md").alias("n"), "text"), str(tmp_path / "out"), "n", "text").where("written").count() == 1
    assert (tmp_path / "out" / "o.md").read_text() == "x\ny"


def test_engines_are_labelled_and_failures_are_the_rows(spark):
    class Odd:
        name = "odd"

        def run(self, inputs):
            if any(x == "bad" for x in inputs):
                raise RuntimeError("no")
            return [x.upper() for x in inputs]

    df = spark.createDataFrame([("d", "a"), ("d", "bad"), ("e", "b")], "doc string, x string").coalesce(1)
    assert [(r.x, r.result) for r in external.apply(df, "x", Odd).orderBy("x").collect()] == [("a", "A"), ("b", "B"), ("bad", None)]
    assert {r.x: r.result for r in external.apply(df, "x", Odd, whole="doc").collect()} == {"a": None, "bad": None, "b": "B"}
    assert external.apply(df, "x", lambda: external.Stub("image_ocr")).first().engine == "stub"


def test_reports(spark):
    d = spark.createDataFrame([("a", "one two!"), ("b", None)], "k string, t string")
    r = report.token_report(d, "k", "t")
    assert {x.k: (x.tokens, x.chars, x.ratio) for x in r.collect()} == {"a": (3, 8, 0.375), "b": (0, 0, None)}
    assert report.with_total(r, "k").where("is_total = 1").first().tokens == 3
    assert report.failures(d, F.col("t").isNull()).first().exit_code == 1
    assert [x.k for x in report.skip_existing(d, d.where("k = 'a'"), "k").collect()] == ["b"]
