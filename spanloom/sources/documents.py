"""Ragged document uploads (S4-S7): one JSON value per row in, one record per row out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom.functions.text import first_truthy, json_values, one_json
from spanloom.operators.insights import RECORD_ALIASES
from spanloom.session import materialise

# Wrapper keys, tried in order, and the keys that make an object one document.
WRAPPERS = ("documents", "docs", "data", "records", "items")
FP_WRAPPERS = ("records", "false_positives", "items", "data")
TEXT_KEYS = ("text", "source", "content", "document")

_OBJECT = "map<string,variant>"
_LIST = "array<variant>"


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files as ``upload, content``; a file whose every line is an object becomes one value per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("upload"), F.col("value").alias("content"))


def jsonl_uploads(spark: SparkSession, path: str) -> DataFrame:
    """A large JSONL upload, line by line: rows ``upload, pos, doc`` ready for :func:`strict_rows`."""
    return spark.read.text(path).where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("upload"), F.monotonically_increasing_id().alias("pos"), one_json(F.col("value")).alias("doc"))


def value_uploads(spark: SparkSession, path: str) -> DataFrame:
    """S6 for uploads too large for one cell: rows ``upload, pos, content``, one for each JSON value of a file, read by byte ranges.

    A JSON string holds no line break, so brackets outside strings can be counted line by line.  Running sums of them, within a
    range and over the ranges of a file, say where no value is open; the lines in between are gathered, which is one value or
    the few of a line, and cut by :func:`json_values`.  A part that is no JSON has NULL for its content.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("upload"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    bare = F.regexp_replace("value", r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    opened = F.length(bare) - F.length(F.translate(bare, "[{", "")) - F.length(bare) + F.length(F.translate(bare, "]}", ""))
    lines = materialise(lines.where(F.trim("value") != "").withColumn("opened", opened), "upload-lines")
    inside = Window.partitionBy("upload", "block").orderBy("line")
    earlier = Window.partitionBy("upload").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def running(rows, what, name):
        """The sum of ``what`` up to each line of a file; a window sees one range, or one row for each range."""
        ranges = rows.groupBy("upload", "block").agg(F.sum(what).alias("n")).select("upload", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        return rows.withColumn(name, F.sum(what).over(inside)).join(ranges, ["upload", "block"]).withColumn(name, F.col(name) + F.col("before")).drop("before")

    ended = running(lines, "opened", "depth").withColumn("ends", (F.col("depth") <= 0).cast("long"))
    parts = running(ended, "ends", "part").withColumn("part", F.col("part") - F.col("ends"))
    texts = parts.groupBy("upload", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "value"))), lambda x: x["value"]), "\n").alias("content"))
    values = texts.withColumn("values", F.coalesce(json_values(F.col("content")), F.array(F.lit(None).cast("string"))))
    return values.select("upload", "part", F.posexplode("values").alias("at", "content")).select("upload", F.struct("part", "at").alias("pos"), "content")


def concatenated(uploads: DataFrame) -> DataFrame:
    """Several values of one upload count as a list; an upload that is no JSON has NULL for its content.

    Only uploads that are not one value are cut into values.
    """
    several = json_values(F.col("content"))
    return uploads.withColumn("content", F.when(one_json(F.col("content")).isNotNull(), F.col("content")).otherwise(F.concat(F.lit("["), F.array_join(several, ","), F.lit("]"))))


def _kind(v: Column) -> Column:
    s = F.schema_of_variant(v)
    return F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").otherwise("other")


def _object(v: Column) -> Column:
    return F.when(_kind(v) == "object", F.try_variant_get(v, "$", _OBJECT))


def _text(m: Column, key: str) -> Column:
    return F.try_variant_get(F.try_element_at(m, F.lit(key)), "$", "string")


def strict(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents ``upload, pos, id, text``, and the uploads refused with the reason.

    An upload is one object with a non-empty ``documents`` list, or, if it is not one JSON value, lines of one object each.
    Missing ids are made up, ``doc_id`` stands in for ``id``; one document without text, or anything behind a value, refuses the
    whole upload.
    """
    lines = F.transform(F.filter(F.split("content", "\n"), lambda x: F.trim(x) != ""), one_json)
    whole = uploads.withColumn("_one", one_json(F.col("content")))
    whole = whole.withColumn("_lines", F.when(F.col("_one").isNull(), lines))
    listed = F.try_variant_get(F.try_element_at(_object(F.col("_one")), F.lit("documents")), "$", _LIST)
    whole = whole.withColumn("docs", F.when(F.col("_one").isNotNull(), listed).otherwise(F.col("_lines")))
    objs = F.transform("docs", _object)
    broken = F.col("_one").isNull() & F.exists("_lines", lambda v: v.isNull())
    whole = whole.withColumn("_docs", objs).withColumn(
        "reason", F.when(broken, "neither one JSON value nor lines of them").when(F.col("docs").isNull() | (F.size("docs") == 0), "'documents' must be a non-empty list").when(
            F.exists("_docs", lambda m: m.isNull() | ~F.map_contains_key(m, F.lit("text"))), "each document must have 'text'"))
    bad = whole.where(F.col("reason").isNotNull()).select("upload", "reason")
    rows = _exploded(whole, F.when(F.col("reason").isNull(), F.col("_docs")), "m")
    m = F.col("m")
    good = rows.select(
        "upload", "pos",
        F.when(F.map_contains_key(m, F.lit("id")), _text(m, "id")).when(F.map_contains_key(m, F.lit("doc_id")), _text(m, "doc_id"))
        .otherwise(F.concat(F.lit("doc_"), F.col("pos").cast("string"))).alias("id"),
        _text(m, "text").alias("text"))
    return good, bad


def strict_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S4 for an upload too large for one cell: rows of :func:`jsonl_uploads`, each accepted or refused by itself.

    Gives documents ``upload, pos, id, text`` and refused lines ``upload, pos, reason``.  A made-up id carries ``pos``.
    """
    rows = lines.withColumn("m", _object(F.col("doc")))
    m = F.col("m")
    ok = F.coalesce(F.map_contains_key(m, F.lit("text")), F.lit(False))
    named = F.when(F.map_contains_key(m, F.lit("id")), _text(m, "id")).when(F.map_contains_key(m, F.lit("doc_id")), _text(m, "doc_id"))
    good = rows.where(ok).select("upload", "pos", named.otherwise(F.concat(F.lit("doc_"), F.col("pos").cast("string"))).alias("id"), _text(m, "text").alias("text"))
    return good, rows.where(~ok).select("upload", "pos", F.lit("each document must have 'text'").alias("reason"))


def _exploded(rows: DataFrame, items: Column, name: str) -> DataFrame:
    """``upload, pos`` and a row per item.  Empty lists are dropped behind the generator: a filter before it would be pushed
    below the parsing and do that twice."""
    return rows.select("upload", F.posexplode_outer(items).alias("pos", name)).where("pos IS NOT NULL")


def _wrapped(obj: Column, keys) -> Column:
    """The first wrapper key that holds a list."""
    return F.coalesce(*[F.when(_kind(F.try_element_at(obj, F.lit(k))) == "array",
                               F.try_variant_get(F.try_element_at(obj, F.lit(k)), "$", _LIST)) for k in keys])


def lenient(uploads: DataFrame) -> DataFrame:
    """Records ``upload, pos, record`` (a map of variants) from any of the accepted shapes.

    A list of objects or texts, an object wrapping such a list, one document, or an object of id →
    document or text; several values in a row count as a list (S6).  Other list members are dropped;
    uploads that give no records are named by :func:`lenient_rejects`.
    """
    parsed = concatenated(uploads).withColumn("v", F.try_parse_json("content")).withColumn("_obj", _object(F.col("v")))
    items = F.when(_kind(F.col("v")) == "array", F.try_variant_get("v", "$", _LIST)).otherwise(_wrapped(F.col("_obj"), WRAPPERS))
    parsed = parsed.withColumn("_items", items)
    one = F.exists(F.array(*[F.lit(k) for k in TEXT_KEYS]), lambda k: F.map_contains_key("_obj", k))

    def item(x, i):
        return F.when(_kind(x) == "object", F.try_variant_get(x, "$", _OBJECT)).when(
            _kind(x) == "string", F.create_map(
                F.lit("doc_id"), F.to_variant_object(F.array(F.concat(F.lit("doc-"), (i + 1).cast("string")))),
                F.lit("text"), F.to_variant_object(F.array(F.try_variant_get(x, "$", "string")))))

    # JSON object order decides the positions; variants sort their keys, so the order comes from the text.
    keys = F.json_object_keys("content")

    def entry(k):
        v = F.try_element_at("_obj", k)
        own = F.try_variant_get(v, "$", _OBJECT)
        named = F.create_map(F.lit("doc_id"), F.to_variant_object(F.array(k)))
        return F.when(_kind(v) == "object", F.when(F.map_contains_key(own, F.lit("doc_id")), own).otherwise(F.map_concat(own, named))).otherwise(
            F.map_concat(named, F.create_map(F.lit("text"), v)))

    records = (
        F.when(F.col("_items").isNotNull(), F.filter(F.transform("_items", item), lambda m: m.isNotNull()))
        .when(one, F.array("_obj"))
        .when(F.col("_obj").isNotNull(), F.transform(keys, entry)))
    return _exploded(parsed, records, "record")


def lenient_rejects(uploads: DataFrame) -> DataFrame:
    """Uploads that :func:`lenient` cannot read, as ``upload, reason``."""
    read = concatenated(uploads)
    kind = _kind(F.try_parse_json("content"))
    reason = F.when(F.col("content").isNull(), "not JSON").when(F.coalesce(kind, F.lit("other")).isin("object", "array"), None).otherwise("no list, wrapper or document")
    return read.select("upload", reason.alias("reason")).where("reason is not null")


def record_text(m: Column, key: str) -> Column:
    """A record's field as text; texts made by :func:`lenient` sit in a one-element list."""
    v = F.try_element_at(m, F.lit(key))
    return F.coalesce(F.when(_kind(v) == "array", F.try_variant_get(v, "$[0]", "string")), F.try_variant_get(v, "$", "string"))


def normalised(records: DataFrame, dataset: str = "geneva", model_type: str = "domain-specific") -> DataFrame:
    """F13 over :func:`lenient`'s records."""
    default = {"text": F.lit(""), "doc_id": F.concat(F.lit("doc-"), (F.col("pos") + 1).cast("string")),
               "dataset": F.lit(dataset), "model_type": F.lit(model_type)}
    return records.select("upload", "pos", *[
        first_truthy(*[record_text(F.col("record"), a) for a in names], default=default[f]).alias(f) for f, names in RECORD_ALIASES.items()])


def fp_items(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records ``upload, pos, record`` of a list or a wrapped list; an upload of anything else, or with a member that is no
    object, is refused as a whole."""
    parsed = uploads.withColumn("v", one_json(F.col("content"))).withColumn("_obj", _object(F.col("v")))
    items = F.when(F.col("_obj").isNotNull(), _wrapped(F.col("_obj"), FP_WRAPPERS)).otherwise(F.try_variant_get("v", "$", _LIST))
    parsed = parsed.withColumn("_items", items).withColumn("_objs", F.transform("_items", _object))
    reason = F.when(F.col("_items").isNull(), "not a list of records").when(F.exists("_objs", lambda m: m.isNull()), "a record is no object")
    parsed = parsed.withColumn("reason", reason)
    return (_exploded(parsed, F.when(F.col("reason").isNull(), F.col("_objs")), "record"), parsed.where("reason IS NOT NULL").select("upload", "reason"))


def fp_columns(items: DataFrame) -> DataFrame:
    """The alias columns :func:`spanloom.operators.review.normalise_records` looks for."""
    from spanloom.operators.review import ALIASES
    names = list(dict.fromkeys(a for v in ALIASES.values() for a in v))
    return items.select("upload", F.col("pos").alias("idx"), *[record_text(F.col("record"), a).alias(a) for a in names])
