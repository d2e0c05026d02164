"""Column expressions over strings. All run in the JVM; nulls give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of files that count as text.
TEXT_SUFFIXES = [".txt", ".md", ".csv", ".json", ".jsonl", ".tex", ".bib", ".xml", ".html", ".css", ".js", ".ts", ".py", ".java", ".c", ".cpp", ".h", ".hpp", ".f90", ".go", ".rs", ".rb", ".php", ".sh", ".bash", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".log", ".rst", ".org", ".adoc", ".sql", ".mod"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tiff", ".tif"]
# What is said in place of content that can't be read aloud.
OMISSION_CUES = {
    "en": {"code": "Code block omitted.", "table": "Table omitted.", "html": "HTML block omitted.", "image": "Image omitted.", "footnote": "Footnote omitted."},
    "pt-br": {"code": "Bloco de codigo omitido.", "table": "Tabela omitida.", "html": "Bloco HTML omitido.", "image": "Imagem omitida.", "footnote": "Nota de rodape omitida."},
}
# Named colours.
COLOURS = {"white": (255, 255, 255), "black": (0, 0, 0), "red": (255, 0, 0), "green": (0, 255, 0), "blue": (0, 0, 255)}

#: All characters that count as white space.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(WHITE))


def normalize_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_doi(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"^https?://(dx\.)?doi\.org/", ""), r"(?U)^doi:\s*", ""))


def normalize_title(c: Column) -> Column:
    """Folded title; a letter outside ASCII separates words."""
    plain = F.translate(F.regexp_replace(c, r"(?U)\\[A-Za-z]+\s*", " "), "{}", "")
    return F.lower(F.trim(F.regexp_replace(plain, r"[^0-9A-Za-z]+", " ")))


def canonical_entry(fields: Column) -> Column:
    """Sorted (folded name, stripped value) pairs of a map."""
    return F.array_sort(F.transform(F.map_entries(fields), lambda x: F.struct(F.lower(x["key"]).alias("key"), strip(x["value"]).alias("value"))))


def basic_tokens(c: Column) -> Column:
    """The regex tokenizer `regex_basic`: runs of letters and digits, and single other marks. 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def megabytes(n_bytes: Column) -> Column:
    return n_bytes / 1048576


def preview(c: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def clean_markdown(c: Column) -> Column:
    """Runs of empty lines shortened, then lines stripped at their ends, the whole stripped, one newline at the end."""
    short = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\n{3,}", "\n\n")
    return F.concat(strip(F.regexp_replace(short, r"[^\S\n]+(?=\n|$)", "")), F.lit("\n"))


def strip_image_links(c: Column) -> Column:
    """Without image links that begin a line; what follows them on the line stays."""
    return F.regexp_replace(F.regexp_replace(c, r"(?md)^[ \t]*!\[[^\]]*\]\([^)]+\)[ \t]*\n?", ""), r"\n{3,}", "\n\n")


def rewrite_image_links(markdown: Column, images: Column) -> Column:
    """`](id)` becomes `](path)` for each image of array<struct<id, path>>, in order; images without id or path are passed over."""
    usable = F.filter(F.coalesce(images, F.array()), lambda i: i["id"].isNotNull() & i["path"].isNotNull() & (i["id"] != ""))
    return F.aggregate(usable, markdown, lambda m, i: F.replace(m, F.concat(F.lit("]("), i["id"], F.lit(")")), F.concat(F.lit("]("), i["path"], F.lit(")"))))


def sanitize_filename(c: Column) -> Column:
    return F.left(F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_"), F.lit(255))


def data_uri_suffix(c: Column) -> Column:
    """The suffix a data URI's header names, .png where it names none that is known. Null counts as no header."""
    kind = F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^data:[^/,;]*/([^;,]*)", 1))
    return F.when(kind.isin("jpeg", "jpg"), ".jpg").when(kind.isin("gif", "webp", "bmp", "tiff"), F.concat(F.lit("."), kind)).otherwise(".png")


def image_filename(stem: Column, page: Column, image: Column, data: Column) -> Column:
    return F.concat(sanitize_filename(stem), F.format_string("_p%03d_img%03d", page, image), data_uri_suffix(data))


def parse_page_range(c: Column) -> Column:
    """Sorted distinct 0-based pages of a list such as `1,3-5`; parts that can't be read are skipped, a reversed range is empty."""
    whole = r"^\s*[+]?\d{1,9}\s*$"
    span = r"^\s*[+]?\d{1,9}\s*-\s*[+]?\d{1,9}\s*$"

    def part(x: Column) -> Column:
        lo, hi = (F.element_at(F.split(x, "-"), k).try_cast("int") for k in (1, 2))
        lo, hi = (F.regexp_extract(x, r"(\d+)\D*-", 1).try_cast("int"), F.regexp_extract(x, r"-\D*(\d+)", 1).try_cast("int"))
        some = F.when(hi >= lo, F.sequence(lo - 1, F.greatest(hi, lo) - 1)).otherwise(F.array().cast("array<int>"))
        return F.when(x.rlike(span), some).when(x.rlike(whole), F.array(F.regexp_extract(x, r"(\d+)", 1).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(c, ","), part))))


def with_suffix(path: Column, suffix: str) -> Column:
    """The path with its last suffix replaced, or added where it has none."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(suffix))


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def title_case(c: Column) -> Column:
    """Each letter after a non-letter in upper case, all others in lower case."""
    chars = F.split(c, "")
    folded = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(False).alias("inside")),
        lambda acc, x: F.struct(F.concat(acc["out"], F.when(acc["inside"], F.lower(x)).otherwise(F.upper(x))).alias("out"), x.rlike(r"\p{L}").alias("inside")),
    )
    return folded["out"]


def filename_title(path: Column) -> Column:
    return title_case(F.translate(stem_of(path), "_-", "  "))


def timestamp_mark(centiseconds: Column) -> Column:
    """[MM:SS.ss] of whole centiseconds; minutes aren't bounded."""
    minutes, rest = F.floor(centiseconds / 6000), F.pmod(centiseconds, F.lit(6000))
    return F.format_string("[%02d:%02d.%02d]", minutes.cast("long"), F.floor(rest / 100).cast("long"), F.pmod(rest, F.lit(100)).cast("long"))


def omission_cue(kind: Column, lang: Column) -> Column:
    """The cue for (kind, language), null if there is none."""
    table = F.create_map(*[F.lit(x) for la, kinds in OMISSION_CUES.items() for k, cue in kinds.items() for x in (f"{la}|{k}", cue)])
    return F.try_element_at(table, F.concat_ws("|", lang, kind))


def looks_like_table(c: Column) -> Column:
    """Whether the first two lines that aren't blank are a pipe row and a divider."""
    lines = F.filter(F.transform(F.split(c, r"\r\n|\n|\r"), strip), lambda x: x != "")
    divider = r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$"
    return F.coalesce((F.size(lines) >= 2) & F.contains(F.get(lines, F.lit(0)), F.lit("|")) & F.get(lines, F.lit(1)).rlike(divider), F.lit(False))


def dedupe_adjacent(blocks: Column) -> Column:
    """Normalised blocks without empty ones and without those equal to the one before."""
    full = F.filter(F.transform(blocks, normalize_space), lambda x: x != "")
    empty = F.array().cast("array<string>")
    return F.aggregate(full, empty, lambda kept, x: F.when((F.size(kept) > 0) & (F.try_element_at(kept, F.lit(-1)) == x), kept).otherwise(F.array_append(kept, x)))


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)(?<=[.!?])\s+"), lambda x: x != "")


def split_long_text(text: Column, limit: Column) -> Column:
    """Pieces of at most `limit` characters: sentences packed greedily, longer ones sliced.

    A sentence of exactly the limit that comes first is preceded by an empty piece; that is kept as it is harmless.
    """
    empty = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        rest = F.when(acc["cur"] != "", F.array(strip(acc["cur"]))).otherwise(empty)
        slices = F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / limit).cast("int")), lambda k: strip(F.substring(s, k * limit + 1, limit)))
        fits = F.length(acc["cur"]) + F.length(s) + 1 <= limit
        done = F.when(F.length(s) > limit, F.concat(acc["done"], rest, slices)).when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(strip(acc["cur"]))))
        cur = F.when(F.length(s) > limit, F.lit("")).when(fits, strip(F.concat(acc["cur"], F.lit(" "), s))).otherwise(s)
        return F.struct(done.alias("done"), cur.alias("cur"))

    start = F.struct(empty.alias("done"), F.lit("").alias("cur"))
    folded = F.aggregate(sentences(text), start, step, lambda a: F.concat(a["done"], F.when(a["cur"] != "", F.array(strip(a["cur"]))).otherwise(empty)))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(folded)


def pack_chunks(blocks: Column, limit: Column) -> Column:
    """Blocks, split where they are too long, packed greedily with an empty line between; the separator counts even at the start."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        fits = F.length(acc["cur"]) + F.length(part) + 2 <= limit
        done = F.when(fits | (acc["cur"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"])))
        return F.struct(done.alias("done"), F.when(fits, strip(F.concat(acc["cur"], F.lit("\n\n"), part))).otherwise(part).alias("cur"))

    parts = F.flatten(F.transform(blocks, lambda b: split_long_text(b, limit)))
    start = F.struct(empty.alias("done"), F.lit("").alias("cur"))
    return F.aggregate(parts, start, step, lambda a: F.concat(a["done"], F.when(a["cur"] != "", F.array(a["cur"])).otherwise(empty)))


def parse_colour(c: Column, strict: bool = False) -> Column:
    """struct<r, g, b> of #rgb, #rrggbb, a name, or r,g,b; if it is none of these null, or an error where strict."""
    s = F.lower(F.trim(c))
    named = F.lit(None).cast("struct<r:int,g:int,b:int>")
    rgb = lambda *x: F.struct(*[v.cast("int").alias(k) for k, v in zip("rgb", x)])
    for name, v in COLOURS.items():
        named = F.when(s == name, rgb(*map(F.lit, v))).otherwise(named)
    six = [F.conv(F.substring(s, k, 2), 16, 10) for k in (2, 4, 6)]
    three = [F.conv(F.repeat(F.substring(s, k, 1), F.lit(2)), 16, 10) for k in (2, 3, 4)]
    parts = [F.trim(F.get(F.split(s, ","), F.lit(k))) for k in range(3)]
    if strict:
        named = F.coalesce(named, F.raise_error(F.concat(F.lit("not a colour: "), c)).cast("struct<r:int,g:int,b:int>"))
    return F.when(s.rlike("^#[0-9a-f]{6}$"), rgb(*six)).when(s.rlike("^#[0-9a-f]{3}$"), rgb(*three)).when(s.rlike(r"^\s*\d+\s*,\s*\d+\s*,\s*\d+\s*(,.*)?$"), rgb(*parts)).otherwise(named)


def track_spec(c: Column) -> Column:
    """struct<path, volume_db> of `path[:db]`, split at the last colon; 0 dB by default, volume null if it isn't a number."""
    tail = F.regexp_extract(c, r"^(.*):([^:]*)$", 2)
    has = F.contains(c, F.lit(":"))
    return F.struct(F.when(has, F.regexp_extract(c, r"^(.*):([^:]*)$", 1)).otherwise(c).alias("path"), F.when(has, F.trim(tail).try_cast("double")).otherwise(F.lit(0.0)).alias("volume_db"))


def output_template(c: Column) -> Column:
    """A file name template: the default where none is given, with the extension's place added unless it ends in it."""
    return F.when(c.isNull(), "%(title)s.%(ext)s").when(F.endswith(c, F.lit(".%(ext)s")), c).otherwise(F.concat(c, F.lit(".%(ext)s")))


# Audio formats whose quality can be chosen, and those that can hold a cover.
WITH_QUALITY, WITH_COVER = ["mp3", "m4a", "opus"], ["m4a", "mp3"]


def audio_options(kind: Column, quality: Column) -> Column:
    """struct<codec, quality, cover>: the quality where the format has one, and whether a thumbnail becomes its cover."""
    return F.struct(kind.alias("codec"), F.when(kind.isin(WITH_QUALITY), quality.cast("string")).alias("quality"), F.coalesce(kind.isin(WITH_COVER), F.lit(False)).alias("cover"))


def separation_command(path: Column, model: Column, out: Column, mp3: Column, float32: Column, int24: Column, jobs: Column, strict: bool = False) -> Column:
    """array<string> of a stem separation call; of the formats mp3 comes before float32 before int24. Where strict, more than one is an error."""
    none = F.array().cast("array<string>")
    kind = F.when(mp3, F.array(F.lit("--mp3"))).when(float32, F.array(F.lit("--float32"))).when(int24, F.array(F.lit("--int24"))).otherwise(none)
    n = F.when(jobs > 0, F.array(F.lit("-j"), jobs.cast("string"))).otherwise(none)
    whole = F.concat(F.array(F.lit("demucs"), F.lit("-n"), model, F.lit("-o"), out), kind, n, F.array(path))
    if not strict:
        return whole
    many = sum((F.coalesce(x, F.lit(False)).cast("int") for x in (mp3, float32, int24)), F.lit(0)) > 1
    return F.when(many, F.raise_error(F.lit("only one output format can be chosen")).cast("array<string>")).otherwise(whole)


def page_choice(spec: Column, n_pages: Column) -> Column:
    """struct<kept, skipped, error>: 0-based pages of a list (see parse_page_range) that exist, those that don't, and an error if none is left."""
    wanted = parse_page_range(spec)
    inside = lambda i: (i >= 0) & (i < n_pages)
    kept = F.filter(wanted, inside)
    error = F.when(F.size(wanted) == 0, "no page range").when(F.size(kept) == 0, "no page is left")
    return F.struct(kept.alias("kept"), F.filter(wanted, lambda i: ~inside(i)).alias("skipped"), error.alias("error"))


def speaker_allowed(speaker: Column, supported: Column) -> Column:
    """Whether a voice can be used: any, where the model names none."""
    return F.when(F.coalesce(F.size(supported), F.lit(0)) <= 0, True).otherwise(F.array_contains(supported, speaker))


def ocr_payload(model: Column, url: Column, images: Column, table_format: Column, header: Column, footer: Column, blocks: Column, scores: Column) -> Column:
    """The JSON of an OCR request; options that are off are absent."""
    on = lambda c: F.when(c, F.lit(True))
    return F.to_json(F.struct(
        model.alias("model"), F.struct(F.lit("document_url").alias("type"), url.alias("document_url")).alias("document"), images.alias("include_image_base64"),
        F.when(table_format != "none", table_format).alias("table_format"), on(header).alias("extract_header"), on(footer).alias("extract_footer"), on(blocks).alias("include_blocks"),
        F.nullif(scores, F.lit("")).alias("confidence_scores_granularity"),
    ))
