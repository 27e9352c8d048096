"""Ingest: raw recognition arrays, request payloads, admission and quality gates; JSON out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LARGEST = 10 * 2**20


def read_regions(raw: DataFrame) -> DataFrame:
    """doc_id, page_no, boxes, txts, scores -> regions with edges; empty texts dropped, places kept."""
    rows = raw.select("doc_id", "page_no", F.posexplode(F.arrays_zip("boxes", "txts", "scores")).alias("seq", "r"))
    text = F.trim(F.regexp_replace("r.txts", r"^\s+|\s+$", ""))
    edge = lambda pick, k: pick(F.transform("r.boxes", lambda p: p[k].cast("int")))
    out = rows.select("doc_id", "page_no", "seq", text.alias("text"), edge(F.array_min, 0).alias("left"), edge(F.array_min, 1).alias("top"), edge(F.array_max, 0).alias("right"), edge(F.array_max, 1).alias("bottom"), F.col("r.scores").cast("double").alias("confidence"))
    return out.filter("text <> ''")


def admit_assets(assets: DataFrame) -> DataFrame:
    """Adds error: content type first, then size, then emptiness; null admits."""
    kind = F.col("content_type")
    good = kind.startswith("image/") | (kind == "application/pdf")
    return assets.withColumn("error", F.when(~F.coalesce(good, F.lit(False)), "INVALID_CONTENT_TYPE").when(F.col("length") > LARGEST, "FILE_TOO_LARGE").when(F.col("length") == 0, "EMPTY_FILE"))


def quality_gate(assets: DataFrame) -> DataFrame:
    """Adds quality_error (resolution before blur) and warning (glare)."""
    error = F.when(F.least("width", "height") < 600, "RESOLUTION_TOO_LOW").when(F.col("blur_variance") < 80, "IMAGE_TOO_BLURRY")
    return assets.withColumn("quality_error", error).withColumn("warning", F.when(F.col("glare_ratio") > 0.15, "GLARE_DETECTED"))


def decode_payloads(events: DataFrame) -> DataFrame:
    """request_id, error, size of JSON events with a base64 image, directly or in the text of ``body``."""
    packed = F.coalesce(F.get_json_object("event", "$.image_base64"), F.get_json_object(F.get_json_object("event", "$.body"), "$.image_base64"))
    raw = F.try_to_binary(packed, F.lit("base64"))
    error = F.when(packed.isNull() | (packed == ""), "MISSING_IMAGE").when(raw.isNull(), "INVALID_BASE64").when(F.length(raw) == 0, "EMPTY_FILE").when(F.length(raw) > LARGEST, "FILE_TOO_LARGE")
    return events.select("request_id", error.alias("error"), F.when(error.isNull(), F.length(raw)).alias("size"))


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.title() for w in rest)


def _named(c: Column, kind: T.DataType, name, order) -> Column:
    """The value with the keys of all structs in it renamed by ``name`` and put in ``order``, at any depth; maps by key."""
    if isinstance(kind, T.StructType):
        fields = [_named(c[f.name], f.dataType, name, order).alias(name(f.name)) for f in order(kind.fields)]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _named(x, kind.elementType, name, order))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(c)))
    return c


def to_json(results: DataFrame, with_id: bool = True) -> DataFrame:
    """doc_id, json: one camelCase object per result, at any depth; null keys kept. ``with_id``: the object has the id, too."""
    body = [c for c in results.schema.fields if with_id or c.name != "doc_id"]
    cells = [_named(F.col(f"`{f.name}`"), f.dataType, camel, list).alias(camel(f.name)) for f in body]
    return results.select("doc_id", F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("json"))


def report_rows(sections: dict[str, DataFrame]) -> DataFrame:
    """section, body: every row of every section as a JSON object with sorted keys at any depth, null keys kept."""
    by_name = lambda fields: sorted(fields, key=lambda f: f.name)
    out = None
    for name, rows in sections.items():
        cells = [_named(F.col(f"`{f.name}`"), f.dataType, str, by_name).alias(f.name) for f in by_name(rows.schema.fields)]
        part = rows.select(F.lit(name).alias("section"), F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("body"))
        out = part if out is None else out.unionByName(part)
    return out


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """Sections of a report as JSON lines with sorted keys, a folder each; parents are made, an older section goes."""
    for name, rows in sections.items():
        report_rows({name: rows}).select("body").write.mode("overwrite").text(f"{path}/{name}")
