"""Replies of a conversion service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dialect import not_empty
from ..functions import images as I
from ..functions.math import image_name

REPLY = "backend string, version string, results map<string,struct<md_content:string,images:map<string,string>>>"


def decode_reply(rows: DataFrame, reply: str, stem: Column, quirks: str = "reference") -> DataFrame:
    """``rows`` with the fields of a JSON reply.

    api_stem: the result's key, the file's own or else the first; api_md: its Markdown with
    image references rewritten; api_images: (ord, name, new_name, bytes) of the images that can
    be decoded; api_error if there is no result. Images are numbered before or, with
    ``quirks="fixed"``, after those that can't be decoded are left out.
    """
    out = rows.withColumn("_r", F.from_json(reply, REPLY))
    entries = F.map_entries("_r.results")
    picked = F.coalesce(F.get(F.filter(entries, lambda e: e["key"] == stem), 0), F.get(entries, 0))
    out = out.withColumn("_p", picked)

    def image(e: Column, i: Column) -> Column:
        return F.struct((i + 1).cast("int").alias("ord"), e["key"].alias("name"), I.decode_data_uri(e["value"]).alias("bytes"))

    listed = F.transform(F.coalesce(F.map_entries(F.col("_p")["value"]["images"]), F.array().cast("array<struct<key:string,value:string>>")), image)
    decoded = F.filter(listed, lambda x: x["bytes"].isNotNull())
    number = (lambda x, i: (i + 1).cast("int")) if quirks != "reference" else (lambda x, i: x["ord"])
    named = F.transform(decoded, lambda x, i: F.struct(number(x, i).alias("ord"), x["name"].alias("name"), image_name(number(x, i), I.api_extension(x["name"])).alias("new_name"), x["bytes"].alias("bytes")))
    out = out.withColumn("api_images", named)
    entries = F.transform("api_images", lambda x: F.struct(x["ord"].alias("ord"), x["name"].alias("old"), F.concat(F.lit("./assets/"), x["new_name"]).alias("new")))
    md = F.col("_p")["value"]["md_content"]
    out = out.select("*", F.col("_p")["key"].alias("api_stem"), I.rewrite_from_api(md, entries, quirks).alias("api_md"), F.when(not_empty(md).isNull(), F.lit("The service returned no content")).alias("api_error"))
    return out.drop("_r", "_p")
