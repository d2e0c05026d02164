"""The query catalogue: (spark, folder of tables) -> DataFrame. Each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions import signal as S
from quillmill.functions import text as T
from quillmill.functions import tokens
from quillmill.operators import audio, bibliography, callgraph, markdown, ocr, report, webpage
from quillmill.session import cut, ensure_checkpoint_dir, table
from quillmill.sources import bibtex, files, sinks, web
from quillmill.streaming import buffering

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def values(spark: SparkSession, column: str, rows: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in rows], f"{column} string")


# ---- texts


@query
def doc_token_report(spark, d):
    r = report.token_report(table(spark, d, "documents"), "doc_id", "text")
    return r.select("doc_id", "tokens", "chars", F.floor(F.col("ratio") * 1000000).cast("long").alias("ratio_millionths"))


@query
def token_ranking(spark, d):
    """Most tokens first."""
    return report.token_report(table(spark, d, "documents"), "doc_id", "text", ordered=True).select("doc_id", "tokens", "chars")


@query
def size_ranking(spark, d):
    """Largest first."""
    return report.size_report(table(spark, d, "documents"), "doc_id", "text", ordered=True).select("doc_id", "bytes")


@query
def token_grand_total(spark, d):
    t = table(spark, d, "documents")
    r = report.with_total(t.select(F.coalesce("source", F.lit("")).alias("source"), T.basic_tokens(F.col("text")).alias("tokens"), F.length("text").alias("chars")), "source")
    return r.select("source", "tokens", "chars", "n_files", "is_total", F.floor(F.col("ratio") * 1000000).cast("long").alias("ratio_millionths"))


@query
def doc_bpe_tokens(spark, d):
    """Tokens with the vocabularies at hand, each named by its file; whole texts."""
    names = sorted(set(tokens.VOCABULARIES.values()))
    return tokens.token_counts(table(spark, d, "documents", spread=True), ["doc_id"], names)


@query
def size_report(spark, d):
    r = report.size_report(table(spark, d, "documents"), "doc_id", "text")
    return r.select("doc_id", "bytes", F.floor(F.col("megabytes") * 1000000).cast("long").alias("megabyte_millionths"))


@query
def whitespace_normalized(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_space(F.col("text"))).alias("digest"))


@query
def clean_markdown(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_markdown(F.col("text"))).alias("digest"))


@query
def strip_image_links(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.strip_image_links(F.col("text"))).alias("digest"))


@query
def text_previews(spark, d):
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text"), 50).alias("preview"), F.md5(T.preview(F.col("text"), 1200, "\n\n…")).alias("long_digest"))


@query
def table_sniff(spark, d):
    return table(spark, d, "documents").select("doc_id", T.looks_like_table(F.col("text")).alias("is_table"))


@query
def output_names(spark, d):
    p = F.col("path")
    return table(spark, d, "documents").where("path is not null").select("doc_id", T.with_suffix(p, ".md").alias("md"), T.with_suffix(p, ".ocr.json").alias("sidecar"), T.suffix_of(p).alias("suffix"), T.sanitize_filename(p).alias("safe"))


@query
def filename_titles(spark, d):
    return table(spark, d, "png2md").select("page_id", T.filename_title(F.col("image")).alias("title"))


# ---- blocks


@query
def lines_adjacent_dedupe(spark, d):
    b = table(spark, d, "block_list").select("doc", F.posexplode("blocks").alias("pos", "block"))
    return report.adjacent_distinct(b, "doc", "pos", "block").select("doc", "pos", F.md5("block").alias("digest"))


@query
def sentence_split(spark, d):
    b = table(spark, d, "block_list").select("doc", F.posexplode("blocks").alias("pos", "block")).where("block is not null")
    s = b.select("doc", "pos", T.sentences(T.normalize_space(F.col("block"))).alias("s"))
    return s.select("doc", "pos", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


def _chunks(spark, d):
    limit = F.coalesce("max_chars", F.lit(900))
    return table(spark, d, "block_list").select("doc", T.pack_chunks(T.dedupe_adjacent(F.col("blocks")), limit).alias("chunks"))


@query
def chunk_pack(spark, d):
    c = _chunks(spark, d).select("doc", F.posexplode_outer("chunks").alias("chunk_no", "chunk")).where("chunk_no is not null")
    return c.select("doc", "chunk_no", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest"))


@query
def chunk_batches(spark, d):
    c = _chunks(spark, d).select("doc", F.posexplode_outer("chunks").alias("n", "chunk")).where("n is not null")
    return report.numbered_batches(c, "doc", "n", 2).groupBy("doc", "batch").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("chunk")).alias("chars"))


@query
def narration_chunks(spark, d):
    """Markdown to chunks to narrate: the longest path over documents."""
    lang = F.regexp_replace(F.lower(F.coalesce("lang", F.lit("en"))), "^pt.*", "pt-br")
    return markdown.narration_chunks(table(spark, d, "documents", spread=True), "doc_id", "text", lang)


@query
def omission_cues(spark, d):
    kinds = spark.createDataFrame([(k,) for k in T.OMISSION_CUES["en"]], "kind string")
    b = table(spark, d, "block_list").select("doc", "lang").join(F.broadcast(kinds))  # five rows, fixed
    return b.select("doc", "kind", T.omission_cue(F.col("kind"), F.col("lang")).alias("cue"))


@query
def skip_existing(spark, d):
    return report.skip_existing(table(spark, d, "documents").where("path is not null").select("doc_id", "path"), table(spark, d, "documents").where("n_chars is not null and path is not null").select("path"), "path").select("doc_id", "path")


# ---- bibliographies


@query
def normalize_title_keys(spark, d):
    return table(spark, d, "bib_entry").select("entry_id", T.normalize_title(bibliography.field("title")).alias("title_key"))


@query
def normalize_doi_keys(spark, d):
    return table(spark, d, "bib_entry").select("entry_id", T.normalize_doi(bibliography.field("doi")).alias("doi_key"))


@query
def canonical_records(spark, d):
    c = T.canonical_entry(F.col("fields"))
    return table(spark, d, "bib_entry").select("entry_id", F.md5(F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["key"], x["value"])), "\n")).alias("digest"))


@query
def dedupe_tokens(spark, d):
    return table(spark, d, "bib_entry").select("entry_id", F.explode(bibliography.dedupe_tokens(["key", "doi", "title"])).alias("t")).groupBy("t.kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t.value").alias("n_values"))


@query
def dedupe_first_wins(spark, d):
    e = bibliography.first_wins(table(spark, d, "bib_entry"), "title", "entry_id")
    return e.where("is_first").select("entry_id")


def _sides(spark, d):
    """Entries of publishers and libraries are the base, all others come in."""
    kinds = table(spark, d, "bib_source").select("src", "src_kind")
    e = table(spark, d, "bib_entry").join(kinds, "src", "left")
    return e.withColumn("side", F.when(F.col("src_kind").isin("publisher", "library"), "base").otherwise("incoming")).select("entry_id", "side", F.col("entry_id").alias("pos"), "entry_type", "id", "fields")


@query
def merge_two_sets(spark, d):
    """By key only, keep-first: set-oriented, no fold."""
    return bibliography.merge_by_key(_sides(spark, d)).select("entry_id", "disposition")


def _merge(policy):
    def run(spark, d):
        return bibliography.merge(_sides(spark, d), policy=policy).select("entry_id", "disposition", "new_id", "replaces")

    run.__name__ = "merge_policy_" + policy.replace("-", "_")
    return run


for _p in bibliography.POLICIES:
    query(_merge(_p))


@query
def merge_summary(spark, d):
    return bibliography.merge_summary(merge_two_sets(spark, d))


@query
def abstract_rows(spark, d):
    return bibliography.abstract_rows(table(spark, d, "bib_entry")).select("entry_id", "tokens", "chars", "preview")


@query
def abstract_stats(spark, d):
    s = bibliography.abstract_stats(table(spark, d, "bib_entry"))
    return s.select("n_entries", "n_abstracts", "tokens", F.floor(F.col("mean_tokens") * 1000).cast("long").alias("mean_tokens_thousandths"))


@query
def bibtex_text(spark, d):
    return bibliography.bibtex_text(table(spark, d, "bib_entry")).select("entry_id", F.md5("bibtex").alias("digest"))


# ---- OCR


@query
def page_join(spark, d):
    """Pages with their image links rewritten, in the order of the response."""
    return ocr.document_text(table(spark, d, "ocr_response")).select("doc", F.md5("markdown").alias("digest"))


@query
def page_join_without_images(spark, d):
    return ocr.document_text(table(spark, d, "ocr_response"), keep_images=False).select("doc", F.md5("markdown").alias("digest"))


@query
def ocr_sidecar(spark, d):
    """The sidecar's JSON, read again."""
    t = table(spark, d, "ocr_response")
    j = sinks.sidecar(t, "doc", "pages")
    return ocr.pages_from_json(j, "name", "content").select(F.col("name"), "place", F.md5("markdown").alias("digest"))


@query
def ocr_pages_from_json(spark, d):
    j = table(spark, d, "ocr_response").select("doc", F.to_json(F.struct("pages")).alias("json"))
    return ocr.pages_from_json(j, "doc", "json").select("doc", "place", "index", F.md5("markdown").alias("digest"), F.size("images").alias("n_images"))


@query
def image_filenames(spark, d):
    return ocr.images(ocr.pages(table(spark, d, "ocr_response"))).select("doc", "place", "image_no", "id", "path", F.md5("data").alias("digest"))


@query
def page_image_links(spark, d):
    return ocr.pages(table(spark, d, "ocr_response")).select("doc", "place", F.md5(ocr.page_text()).alias("digest"))


@query
def disposition_failures(spark, d):
    return report.failures(table(spark, d, "png2md"), F.trim(F.coalesce("content", F.lit(""))) == "")


@query
def line_clusters(spark, d):
    """Events as boxes: values are heights on the page, times run across."""
    e = table(spark, d, "events").withColumn("value", F.coalesce("value", F.lit(0.0)))
    n = ocr.line_numbers(e, "user_id", F.col("value"), F.col("event_id"), F.pmod("event_id", F.lit(5)) / 4.0, 0.1)
    return n.groupBy("user_id").agg((F.max("line_no") + 1).alias("n_lines"))


@query
def image_sections(spark, d):
    s = ocr.sections(table(spark, d, "png2md").withColumn("scan", F.coalesce("scan", F.lit(""))), "scan", "page_id", "image", "content")
    return s.select("scan", F.md5("markdown").alias("digest"))


@query
def boxes_to_text(spark, d):
    """Events as detected words: the value is the height on the page, sure ones only."""
    e = table(spark, d, "events").where("value is not null")
    x, y, h = F.col("event_id") % 97 * 1.0, F.col("value") * 3, 1.0 + F.col("event_id") % 4
    box = F.array(F.array(x, y), F.array(x + 5, y), F.array(x + 5, y + h), F.array(x, y + h))
    b = e.select(F.col("user_id").cast("string").alias("image"), box.alias("bbox"), F.concat("event_type", F.col("event_id").cast("string")).alias("text"), (F.col("event_id") % 10 / 10.0).alias("conf"))
    return ocr.boxes_to_text(b).select("image", F.md5("text").alias("digest"))


# ---- web pages, made of documents


def _pages(spark, d):
    html = F.concat(F.lit("<html><body><nav><a href='/'>Home</a></nav><article><p>"), F.regexp_replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), "\n{2,}", "</p><p>"), F.lit("</p></article></body></html>"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", html.alias("html"))


@query
def page_article(spark, d):
    return _pages(spark, d).select("doc_id", F.md5(webpage.article_html(F.col("html"))).alias("digest"))


OUTER = [("article", "<article class='x'>", "</article>"), *[(f"class {c}", f"<div class='a {c} b'>", "</div>") for c in webpage.CONTAINERS], ("main", "<main>", "</main>"), ("body", "", "")]


def _framed(spark, d):
    """Each document in one kind of container, beside others that come later in the order of preference."""
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), F.lit(a).alias("a"), F.lit(z).alias("z")) for n, a, z in OUTER])
    t = table(spark, d, "documents", spread=True).where("text is not null").withColumn("k", F.get(kinds, F.pmod("doc_id", F.lit(len(OUTER))).cast("int")))
    later = F.when(F.col("k.kind") == "body", "").when(F.col("k.kind") == "main", "<p>before</p>").otherwise("<main><p>elsewhere</p></main>")
    return t.select("doc_id", F.concat(F.lit("<html><head><title>t</title></head><body>"), later, "k.a", F.lit("<p>"), safe, F.lit("</p>"), "k.z", F.lit("</body></html>")).alias("html"))


@query
def page_container_priority(spark, d):
    return _framed(spark, d).select("doc_id", F.md5(webpage.main_container("html")).alias("digest"))


@query
def page_clean_html(spark, d):
    """Cleaned HTML is never empty where there is a page."""
    c = webpage.cleaned_html("html")
    return _framed(spark, d).withColumn("c", c).select("doc_id", (F.length("c") > 0).alias("is_there"), F.contains("html", F.col("c")).alias("is_part"))


@query
def page_markdown(spark, d):
    h = F.concat(F.lit("<html><body><nav><a href='/'>Home</a></nav><article><p>"), F.regexp_replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), "\n{2,}", "</p><p>"), F.lit("</p></article></body></html>"))
    return table(spark, d, "documents", spread=True).where("text is not null").select("doc_id", webpage.page_markdown(h).alias("m")).select("doc_id", "m.markdown", "m.tier")


PAGES = [
    "<body><h2>A</h2><ul><li>b <b>c</b></li></ul><script>x</script></body>",
    "<p>one<br>two</p><hr><p><em>three</em> <code>f(x)</code></p>",
    "<div class='content'><h1>T</h1><p>see <a href='u'>here</a></p><ol><li>x</li><li>y</li></ol></div>",
    "<pre>a  b\nc</pre><blockquote><p>q</p></blockquote>",
    "<table><tr><th>h</th><td>v</td></tr></table><img alt='i' src='s.png'>",
]


@query
def page_markdown_cases(spark, d):
    return values(spark, "html", PAGES).select("html", webpage.page_markdown("html").alias("m")).select("html", "m.markdown", "m.tier")


@query
def page_decode(spark, d):
    """Documents as bytes in three charsets, with and without a header that tells."""
    t = table(spark, d, "documents").where("text is not null")
    k = F.pmod("doc_id", F.lit(3))
    content = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.encode("text", "UTF-16LE")).otherwise(F.concat(F.lit(b"\xef\xbb\xbf"), F.encode("text", "UTF-8")))
    header = F.when(k == 1, "utf-16-le").when(k == 0, F.when(F.col("doc_id") % 2 == 0, "UTF-8"))
    return t.select("doc_id", F.md5(web.page_text(content, header)).alias("digest"))


# ---- files, written and read again


def _folder(spark, name):
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/{name}-{uuid.uuid4().hex}"


@query
def text_tree(spark, d):
    """OCR documents as text files in a tree, read with the rest: path, sizes, text."""
    at = _folder(spark, "tree")
    t = ocr.document_text(table(spark, d, "ocr_response")).withColumn("name", F.concat(F.regexp_replace("doc", "[^A-Za-z0-9]", "_"), F.lit(".md")))
    sinks.write_files(t, at, "name", "markdown").where("not written").count()
    good, _ = files.text_tree(spark, at)
    return good.select(F.element_at(F.split("path", "/"), -1).alias("name"), "chars", "bytes", F.md5("text").alias("digest"))


@query
def bibtex_roundtrip(spark, d):
    """Entries with a key, written as one .bib file for each source and read again: how many come back."""
    at = _folder(spark, "bib")
    e = table(spark, d, "bib_entry").where("id rlike '^[A-Za-z0-9_:.-]+$' and src is not null and entry_type is not null")
    clean = F.map_from_entries(F.transform(F.filter(F.map_entries("fields"), lambda x: x["value"].isNotNull() & x["key"].rlike("^[A-Za-z]+$")), lambda x: F.struct(F.lower(x["key"]), F.regexp_replace(x["value"], r"[{}\\\\]", ""))))
    t = bibliography.bibtex_text(e.withColumn("fields", F.map_filter("fields", lambda k, v: F.lit(True))).withColumn("fields", clean)).join(e.select("entry_id", "src"), "entry_id")
    t = bibliography.ordered_files(t, "src", "pos", "bibtex")
    sinks.write_files(t, at, "src", "bibtex").where("not written").count()
    return bibtex.read(spark, at).groupBy("src").agg(F.count("id").alias("n_entries"), F.count("error").alias("n_errors"))


# ---- graphs


@query
def call_graph_semi(spark, d):
    """Suppliers called by parts, where both are defined: parts of at least size 25, suppliers in credit."""
    o = table(spark, d, "lineitem")
    edges = o.select(F.lit("").alias("file"), F.concat(F.lit("p"), "l_partkey").alias("caller"), F.concat(F.lit("s"), "l_suppkey").alias("callee"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    p = table(spark, d, "part").where("p_size >= 25").select(F.lit("").alias("file"), F.concat(F.lit("p"), "p_partkey").alias("name"))
    s = table(spark, d, "supplier").where("s_acctbal > 0").select(F.lit("").alias("file"), F.concat(F.lit("s"), "s_suppkey").alias("name"))
    return callgraph.first_seen(callgraph.defined_calls(edges, p.unionByName(s))).groupBy("caller").agg(F.count(F.lit(1)).alias("n_callees"), F.min("ord").alias("first_ord"))


SOURCES = [
    ("a.py", "import x\n\n@deco(1)\ndef f(a=g()):\n    h(a)\n    x.y.z()\n\n    async def inner():\n        k()\n    return f\n\ndef g():\n    pass\n\ndef h(b):\n    g(); g()\n    w.add_node('n', h)\n\nf()\n"),
    ("b.c", "int sq(int x) { return x * x; }\n/* no(); */\nint main(void) {\n  if (sq(2)) { printf(\"sq(3)\"); }\n  return sq(4);\n}\n"),
    ("c.py", "def broken(:\n"),
    ("d.py", "def build(g):\n    g.my_add_node('n', step)\n    g.add_node('m', lambda s: run(s))\n    g.add_conditional_edges('n', route)\n\ndef step(s):\n    run(s)\n\ndef run(s):\n    pass\n\ndef route(s):\n    pass\n"),
]


@query
def py_call_edges(spark, d):
    x = callgraph.extract(spark.createDataFrame(SOURCES, "path string, text string"))
    return x.withColumn("caller", F.when(F.col("kind") != "error", F.col("caller")))  # the parser's words differ between versions


@query
def call_graph_dot(spark, d):
    x = callgraph.extract(spark.createDataFrame(SOURCES, "path string, text string"))
    graph = cut(callgraph.adjacency(x.where("kind = 'edge'").drop("kind"), x.where("kind = 'node'").select("file", F.col("caller").alias("name"))))
    return callgraph.dot(graph).join(callgraph.graph_json(graph), "file")


# ---- signals


@query
def bounding_box(spark, d):
    """Embeddings as images of 8 pixels a row: dark where the value is high."""
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("k", "v"))
    shade = F.when(F.col("v") > 0.15, 0).otherwise(255)
    pixels = p.select("img", F.pmod(F.col("k"), F.lit(8)).alias("x"), F.floor(F.col("k") / 8).cast("int").alias("y"), shade.alias("r"), shade.alias("g"), shade.alias("b"), F.lit(255).alias("a"))
    return audio.bounding_box(pixels)


def _ints(c):
    return F.transform(c, lambda x: F.floor(x.cast("double") * 10000).cast("int"))


@query
def rms_energy(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.floor(S.rms(_ints("embedding")) * 100).cast("long").alias("rms_hundredths"))


@query
def gain_overlay_mix(spark, d):
    """All embeddings of a label, with gains from -3 to 3 dB, overlaid on the first of them."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("mix"), "vec_id", F.posexplode(_ints("embedding")).alias("sample_idx", "value"))
    firsts = table(spark, d, "embeddings").groupBy(F.col("label").alias("mix")).agg(F.min("vec_id").alias("first"))
    t = e.join(firsts, "mix").withColumn("track_no", F.when(F.col("vec_id") == F.col("first"), 0).otherwise(1)).withColumn("volume_db", F.col("vec_id") % 5 * 1.5 - 3.0)
    return audio.mix(t)


def _blocks(spark, d):
    """Events as signal blocks: one of 100 ms each, silent where the value is low."""
    e = table(spark, d, "events")
    of = Window.partitionBy("user_id")
    seq = F.row_number().over(of.orderBy("ts", "event_id"))
    return e.select(F.col("user_id").cast("string").alias("stream_id"), (seq - 1).cast("long").alias("seq"), F.lit(100).cast("long").alias("ms"), F.when(F.col("value") < 5, 0.0).otherwise(F.col("value")).alias("level"), (seq == F.count(F.lit(1)).over(of)).alias("last"))


@query
def transcript_timestamps(spark, d):
    e = table(spark, d, "events")
    b = e.select(F.col("user_id").alias("audio"), "event_id", "ts", F.col("event_type").alias("text"), F.floor(F.coalesce("value", F.lit(0.0)) * 100).cast("long").alias("cs"))
    order = Window.partitionBy("audio").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("start", F.coalesce(F.sum("cs").over(order), F.lit(0)))
    return b.select("event_id", T.timestamp_mark(F.col("start")).alias("mark"))


@query
def fixed_buffer_batch(spark, d):
    return buffering.fixed_buffers(_blocks(spark, d), 30)


@query
def vad_segments_batch(spark, d):
    return buffering.silence_segments(_blocks(spark, d))


PARTS = 5


def _streamed(spark, d, make):
    """Run a stream over blocks that came in PARTS files, one in each micro-batch; its result as a table. Every stream is spread over the files."""
    base = _folder(spark, "stream")
    blocks = cut(_blocks(spark, d))
    for k in range(PARTS):
        blocks.where(F.least(F.floor(F.col("seq") / 7), F.lit(PARTS - 1)) == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(blocks.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    q = make(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query
def vad_segments_stream(spark, d):
    return _streamed(spark, d, lambda s: buffering.silence_segments_stream(s, idle_ms=None))


@query
def fixed_buffer_stream(spark, d):
    return _streamed(spark, d, lambda s: buffering.fixed_buffers_stream(s, buffering.blocks_in(3000, 100)))


@query
def buffered_samples(spark, d):
    b = _blocks(spark, d).withColumn("samples", F.array("seq", F.floor(F.coalesce("level", F.lit(0.0)) * 100).cast("long")))
    return buffering.buffered_samples(b, 10).select("stream_id", "buffer", F.array_join("samples", ",").alias("samples"))


@query
def buffer_offsets(spark, d):
    b = buffering.fixed_buffers(_blocks(spark, d), 7)
    return audio.offsets(b, "stream_id", "buffer", "ms").select("stream_id", "buffer", "offset")


@query
def transcripts(spark, d):
    """Events as recognised segments: one transcript for each user."""
    s = table(spark, d, "events").select(F.col("user_id").cast("string").alias("audio"), (F.col("event_id") * 37).alias("start"), F.when(F.col("event_id") % 9 == 0, " ").otherwise(F.concat(F.lit(" "), "event_type")).alias("text"))
    return audio.transcript(s).join(audio.transcript(s, timestamps=False).withColumnRenamed("text", "plain"), "audio").select("audio", F.md5("text").alias("digest"), F.md5("plain").alias("plain_digest"))


@query
def synthesis_metrics(spark, d):
    """Events as synthesised chunks: batches of two, realtime factor with a guard against no time."""
    c = table(spark, d, "events").select("user_id", (F.col("event_id") % 16 / 4.0).alias("audio_seconds"), F.when(F.col("user_id") % 3 == 0, 0.0).otherwise(8.0).alias("elapsed"))
    return audio.synthesis_metrics(c, "user_id")


@query
def crop_report(spark, d):
    """Embeddings as images of 8 pixels a row, cropped to what is dark with a margin of one."""
    box = bounding_box(spark, d)
    n = table(spark, d, "embeddings").select(F.col("vec_id").alias("img"), F.lit(8).alias("w"), F.ceil(F.size("embedding") / 8).cast("int").alias("h"))
    c = box.join(n, "img").withColumn("c", S.crop_box(F.col("left"), F.col("top"), F.col("right"), F.col("bottom"), F.col("w"), F.col("h"), 1))
    share = S.removed_percent(F.col("w"), F.col("h"), F.col("c.right") - F.col("c.left"), F.col("c.bottom") - F.col("c.top"))
    return c.select("img", "c.left", "c.top", "c.right", "c.bottom", F.floor(share * 100 + 0.001).cast("long").alias("removed_hundredths"))


@query
def dark_inversion(spark, d):
    p = F.transform("embedding", lambda x: F.pmod(F.floor(x.cast("double") * 1000), F.lit(256)).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(S.inverted_if_dark(p), ",").alias("pixels"))


@query
def durations(spark, d):
    """Samples over rates, progress and realtime factors, with guards against zero."""
    e = table(spark, d, "events").withColumn("rate", F.col("event_id") % 5 * 8000)
    return e.select("event_id", S.duration(F.col("event_id"), F.col("rate")).alias("seconds"), S.progress(F.col("event_id") % 300, F.col("event_id") % 4 * 100).alias("percent"), S.realtime_factor(F.col("event_id") * 1.0, F.col("user_id") % 2 * 4.0).alias("factor"))


@query
def adjacency_lists(spark, d):
    """Suppliers called by parts of each nation's suppliers as a graph: names to callees, in order."""
    o = table(spark, d, "lineitem").where("l_suppkey is not null")
    edges = o.select(F.lit("").alias("file"), F.concat(F.lit("p"), "l_partkey").alias("caller"), F.concat(F.lit("s"), "l_suppkey").alias("callee"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    p = table(spark, d, "part").select(F.lit("").alias("file"), F.concat(F.lit("p"), "p_partkey").alias("name"))
    s = table(spark, d, "supplier").select(F.lit("").alias("file"), F.concat(F.lit("s"), "s_suppkey").alias("name"))
    return callgraph.adjacency(edges, p.unionByName(s)).select("name", F.size("callees").alias("n"), F.md5(F.array_join("callees", ",")).alias("digest"))


@query
def props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# ---- literals: parsers of arguments

PAGE_RANGES = ["1,3-5", "5-1", "x,2", "-3", "1-2-3", "4,4,2", "0", " 7 - 9 ,1", ""]
COLOURS = ["#fff", "#A1b2C3", "white", "12, 34,56", "red"]
TRACKS = ["a.wav", "b.wav:-3.5", "C:/x/c.wav:2", "d.wav:loud"]
MARKS = [0, 5, 99, 100, 5999, 6000, 123456, 987654321]


@query
def page_range(spark, d):
    return values(spark, "spec", PAGE_RANGES).select("spec", F.array_join(T.parse_page_range(F.col("spec")), ",").alias("pages"))


@query
def colours(spark, d):
    return values(spark, "spec", COLOURS).select("spec", T.parse_colour(F.col("spec")).alias("c")).select("spec", "c.r", "c.g", "c.b")


@query
def track_specs(spark, d):
    return values(spark, "spec", TRACKS).select("spec", T.track_spec(F.col("spec")).alias("t")).select("spec", "t.path", "t.volume_db")


@query
def timestamp_marks(spark, d):
    return spark.createDataFrame([(x,) for x in MARKS], "cs long").select("cs", T.timestamp_mark(F.col("cs")).alias("mark"))


TEMPLATES = ["%(id)s", "a.%(ext)s", "%(ext)s.b", ""]
FORMATS = ["mp3", "m4a", "opus", "wav", "flac"]
SEPARATIONS = [(True, False, False, 0), (False, True, False, 2), (True, True, True, 1), (False, False, False, 4), (False, False, True, 0)]
REQUESTS = [("none", False, True, ""), ("html", True, False, "page"), ("markdown", True, True, "word")]
CHOICES = [("1,3-5", 4), ("9", 3), ("x", 3), ("2-1,2", 2), ("0,1", 1)]
SPEAKERS = [("Ana", "Ana,Rui"), ("Eva", "Ana,Rui"), ("Eva", "")]


@query
def output_templates(spark, d):
    return values(spark, "template", [*TEMPLATES, None]).select("template", T.output_template(F.col("template")).alias("named"))


@query
def audio_options(spark, d):
    return values(spark, "codec", FORMATS).select(T.audio_options(F.col("codec"), F.lit(192)).alias("o")).select("o.codec", "o.quality", "o.cover")


@query
def separation_commands(spark, d):
    t = spark.createDataFrame(SEPARATIONS, "mp3 boolean, float32 boolean, int24 boolean, jobs int")
    return t.select(F.array_join(T.separation_command(F.lit("x.wav"), F.lit("htdemucs"), F.lit("out"), F.col("mp3"), F.col("float32"), F.col("int24"), F.col("jobs")), " ").alias("command"))


@query
def ocr_requests(spark, d):
    t = spark.createDataFrame(REQUESTS, "table_format string, header boolean, blocks boolean, scores string")
    return t.select(T.ocr_payload(F.lit("m"), F.lit("u"), F.lit(True), F.col("table_format"), F.col("header"), F.lit(False), F.col("blocks"), F.col("scores")).alias("payload"))


@query
def page_choices(spark, d):
    t = spark.createDataFrame(CHOICES, "spec string, n_pages int").withColumn("c", T.page_choice(F.col("spec"), F.col("n_pages")))
    return t.select("spec", "n_pages", F.array_join("c.kept", ",").alias("kept"), F.array_join("c.skipped", ",").alias("skipped"), "c.error")


@query
def speakers(spark, d):
    t = spark.createDataFrame(SPEAKERS, "speaker string, supported string")
    return t.select("speaker", "supported", T.speaker_allowed(F.col("speaker"), F.filter(F.split("supported", ","), lambda x: x != "")).alias("allowed"))


MARKDOWN = [
    ("# Title one\n\nText with [a link](http://x.example/y) and **bold\nwords**.\n\n- first\n- second\n", "en"),
    ("```\ncode\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n<div>\nx\n</div>\n\n![alt](i.png)\n\n[^1]: note\n", "en"),
    ("```\nx\n```\n\n[^a]: y", "pt-br"),
    ("line one  \nline two `c*d`[^2]\n\n    code\n\n> quote\nlazy\n\nHead\n===", None),
]


@query
def markdown_blocks(spark, d):
    t = spark.createDataFrame(MARKDOWN, "markdown string, lang string")
    return t.select("markdown", F.array_join(markdown.speakable_blocks("markdown", "lang"), " / ").alias("blocks"))
