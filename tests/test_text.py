from pyspark.sql import functions as F

from quillmill.functions import signal as S
from quillmill.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_doi_and_title(spark):
    assert one(spark, " HTTPS://DX.DOI.ORG/10.1/AbC/ ", T.normalize_doi) == "10.1/abc/"
    assert one(spark, "doi:  10.1/x", T.normalize_doi) == "10.1/x"
    assert one(spark, None, T.normalize_doi) is None
    assert one(spark, "The {\\it Wide} Ünder-world", T.normalize_title) == "the wide nder world"


def test_space_preview_and_files(spark):
    assert one(spark, " a \t\n b ", T.normalize_space) == "a b"
    assert one(spark, "abcdef", lambda c: T.preview(c, 3)) == "abc..."
    assert one(spark, "dir.x/a b.tar.gz", lambda c: T.with_suffix(c, ".md")) == "dir.x/a b.tar.md"
    assert one(spark, "a/Foo's_3rd-2a.png", T.filename_title) == "Foo'S 3Rd 2A"
    assert one(spark, "data:image/JPEG;base64,xx", T.data_uri_suffix) == ".jpg"
    assert one(spark, None, T.data_uri_suffix) == ".png"
    assert one(spark, None, T.output_template) == "%(title)s.%(ext)s" and one(spark, "", T.output_template) == ".%(ext)s" and one(spark, "%(ext)s.x", T.output_template) == "%(ext)s.x.%(ext)s"


def test_markdown_cleaning(spark):
    assert one(spark, "a  \n\n\n\nb\n \n \n \nc \n", T.clean_markdown) == "a\n\nb\n\n\n\nc\n"
    assert one(spark, "![x](y) tail\n\n\n\nb ![i](j)\n", T.strip_image_links) == "tail\n\nb ![i](j)\n"
    assert one(spark, "| a | b |\n|---|:---:|\n", T.looks_like_table) is True
    assert one(spark, None, T.looks_like_table) is False


def test_page_range_colour_and_track(spark):
    assert one(spark, "3-5,1,x,5-1,-3,1-2-3", T.parse_page_range) == [0, 2, 3, 4]
    assert tuple(one(spark, "#f0a", T.parse_colour)) == (255, 0, 170)
    assert one(spark, "teal?", T.parse_colour) is None
    assert tuple(one(spark, "a:b.wav:-2.5", T.track_spec)) == ("a:b.wav", -2.5)
    assert one(spark, 6_001, T.timestamp_mark, "long") == "[01:00.01]"


def test_chunks(spark):
    blocks = ["First one.", "First one.", " ", "Second  one.", "x" * 25]
    packed = one(spark, blocks, lambda c: T.pack_chunks(T.dedupe_adjacent(c), F.lit(24)), "array<string>")
    assert packed == ["First one.\n\nSecond one.", "x" * 24, "x"]
    assert one(spark, [], lambda c: T.pack_chunks(c, F.lit(24)), "array<string>") == []
    pieces = one(spark, "One two. Three four. Five.", lambda c: T.split_long_text(c, F.lit(12)))
    assert pieces == ["One two.", "Three four.", "Five."]
    # a first sentence of exactly the limit is preceded by an empty piece
    assert one(spark, "abcdefghi. Next.", lambda c: T.split_long_text(c, F.lit(10))) == ["", "abcdefghi.", "Next."]


def test_signal(spark):
    assert one(spark, [3.0, 4.0], S.rms, "array<double>") == (12.5) ** 0.5
    assert one(spark, [], S.rms, "array<double>") is None
    assert one(spark, [10, 20], S.inverted_if_dark, "array<int>") == [245, 235]
    assert one(spark, 30000, lambda c: S.gain(c, F.lit(6.0)), "int") == 32767
    assert one(spark, 0.0, lambda c: S.duration(F.lit(5), c), "double") == 0.0


def test_payload_leaves_out_what_is_off(spark):
    j = one(spark, "u", lambda c: T.ocr_payload(F.lit("m"), c, F.lit(True), F.lit("none"), F.lit(True), F.lit(False), F.lit(False), F.lit("")))
    assert j == '{"model":"m","document":{"type":"document_url","document_url":"u"},"include_image_base64":true,"extract_header":true}'
