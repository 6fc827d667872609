"""Chat messages with images, as arrays of structs (type, text, image_url)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEMS = "array<struct<type:string,text:string,image_url:string>>"


def is_multimodal(items: Column) -> Column:
    return F.coalesce(F.exists(items, lambda x: x["type"] == "image_url"), F.lit(False))


def image_kind(source: Column) -> Column:
    """url, base64 or file, by how an image is named."""
    return F.when(source.rlike("^https?://"), F.lit("url")).when(source.rlike("^data:image/[a-z.+-]+;base64,"), F.lit("base64")).when(source.isNotNull(), F.lit("file"))


def normalised(items: Column, most_images: int = 5) -> Column:
    """Text items trimmed, empty ones dropped, images beyond the first ones dropped."""
    text = F.filter(items, lambda x: (x["type"] == "text") & (F.coalesce(F.trim(x["text"]), F.lit("")) != ""))
    text = F.transform(text, lambda x: F.struct(x["type"].alias("type"), F.trim(x["text"]).alias("text"), F.lit(None).cast("string").alias("image_url")))
    image = F.filter(items, lambda x: (x["type"] == "image_url") & x["image_url"].isNotNull())
    return F.concat(text, F.slice(image, 1, most_images))
