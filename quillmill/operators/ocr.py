"""OCR responses and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T

RESPONSE = "struct<pages:array<struct<index:int,markdown:string,images:array<struct<id:string,image_base64:string>>>>>"


def pages(df: DataFrame, doc: str = "doc", column: str = "pages") -> DataFrame:
    """doc, place (from 0, in the order of the response), index, markdown, images; missing pages are none, missing text is empty."""
    p = df.select(doc, F.posexplode(F.coalesce(column, F.array().cast("array<struct<index:int,markdown:string,images:array<struct<id:string,image_base64:string>>>>"))).alias("place", "p")).where("p is not null")
    return p.select(doc, "place", "p.index", F.coalesce("p.markdown", F.lit("")).alias("markdown"), F.coalesce("p.images", F.array().cast("array<struct<id:string,image_base64:string>>")).alias("images"))


def pages_from_json(df: DataFrame, doc: str, json: str) -> DataFrame:
    """The pages of responses held as JSON strings; what can't be parsed has none."""
    return pages(df.select(doc, F.from_json(json, RESPONSE)["pages"].alias("pages")), doc)


def images(p: DataFrame, doc: str = "doc") -> DataFrame:
    """doc, place, image_no (from 1), id, path, data: images with data and their file names; base64 without the header."""
    i = p.select(doc, "place", F.posexplode("images").alias("k", "i")).where("i.image_base64 is not null and i.image_base64 <> ''")
    named = T.image_filename(T.stem_of(F.col(doc)), F.col("place") + 1, F.col("k") + 1, F.col("i.image_base64"))
    return i.select(doc, "place", (F.col("k") + 1).alias("image_no"), "i.id", named.alias("path"), F.try_to_binary(F.regexp_replace("i.image_base64", r"^[^,]*,", ""), F.lit("base64")).alias("data"))


def page_text(doc: str = "doc", keep_images: bool = True) -> Column:
    """A page's Markdown with its image links rewritten to file names, or taken out."""
    if not keep_images:
        return T.strip_image_links(F.col("markdown"))
    named = F.transform("images", lambda i, k: F.struct(i["id"].alias("id"), T.image_filename(T.stem_of(F.col(doc)), F.col("place") + 1, k + 1, i["image_base64"]).alias("path")))
    return T.rewrite_image_links(F.col("markdown"), named)


def document_text(df: DataFrame, doc: str = "doc", keep_images: bool = True) -> DataFrame:
    """doc, markdown: pages in the order of the response, with a rule between."""
    p = pages(df, doc).withColumn("markdown", page_text(doc, keep_images))
    return p.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "markdown"))), lambda x: x["markdown"]), "\n\n---\n\n").alias("markdown"))


def box_places(bbox: Column) -> tuple[Column, Column, Column]:
    """(vertical middle, left, height) of a box of corner points."""
    xs, ys = F.transform(bbox, lambda p: p[0]), F.transform(bbox, lambda p: p[1])
    return (F.array_min(ys) + F.array_max(ys)) / 2, F.array_min(xs), F.array_max(ys) - F.array_min(ys)


def line_numbers(boxes: DataFrame, within: str, y: Column, x: Column, height: Column, least: float = 8.0) -> DataFrame:
    """Adds line_no: a new line starts where the middle is further from the one before than 0.6 of the mean height, at least 8."""
    w = Window.partitionBy(within)
    b = boxes.withColumn("_y", y).withColumn("_x", x).withColumn("_limit", F.greatest(F.avg(height).over(w) * 0.6, F.lit(least)))
    order = w.orderBy("_y", "_x")
    jump = F.coalesce(F.abs(F.col("_y") - F.lag("_y").over(order)) > F.col("_limit"), F.lit(False)).cast("int")
    return b.withColumn("_jump", jump).withColumn("line_no", F.sum("_jump").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_jump", "_limit")


def boxes_to_text(boxes: DataFrame, within: str = "image", min_confidence: float = 0.3) -> DataFrame:
    """image, text: boxes of (bbox, text, conf) sure enough, clustered to lines, each line from left to right."""
    y, x, height = box_places(F.col("bbox"))
    b = line_numbers(boxes.where(F.col("conf") >= min_confidence), within, y, x, height)
    lines = b.groupBy(within, "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_x", "_y", "text"))), lambda v: v["text"]), " ").alias("t"))
    return lines.groupBy(within).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda v: v["t"]), "\n").alias("text"))


def sections(df: DataFrame, group: str, order: str, path: str, text: str) -> DataFrame:
    """group, markdown: a section for each image under its title, the text fenced."""
    body = F.when(T.strip(F.col(text)) != "", F.concat(F.lit("```\n"), F.col(text), F.lit("\n```"))).otherwise("_No content extracted._")
    s = df.select(group, order, F.concat(F.lit("## "), T.filename_title(F.col(path)), F.lit("\n\n"), F.coalesce(body, F.lit("_No content extracted._"))).alias("s"))
    return s.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "s"))), lambda x: x["s"]), "\n\n---\n\n").alias("markdown"))
