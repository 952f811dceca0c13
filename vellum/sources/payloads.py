"""Documents as JSON: what the extraction returns, and what chunking, editing and generation take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.schema import DOCUMENT

#: Where a format may be named, in the order in which it counts.
_PLACES = ("$.extension", "$.extracted_data.extension", "$.extracted_data.document_type", "$.extracted_data.metadata.source_type", "$.document_type", "$.metadata.source_type", "$.extracted_data.extracted_data.metadata.source_type")


def _named(payload: Column, *places: str) -> Column:
    """The first place with a value that is not blank, lower-cased and without a leading dot."""
    # Each step is computed once: named again in the next, it would read the JSON anew, some hundred times in all.
    own = lambda v: X.let(F.regexp_replace(F.lower(X.strip(v)), r"^\.+", ""), lambda x: F.nullif(x, F.lit("")))
    return F.coalesce(*[X.let(F.get_json_object(payload, p), own) for p in places])


def payload_extension(payload: Column) -> Column:
    """The format that a payload names; empty if it names none."""
    return F.coalesce(_named(payload, *_PLACES), F.lit(""))


def edit_extension(payload: Column) -> Column:
    """The editor of a payload: docx (also without a named format), html, md, txt or pptx; null for others."""
    return X.let(payload_extension(payload), lambda own: (
        F.when(own.isin("", "doc", "docx"), "docx").when(own.isin("html", "htm"), "html").when(own.isin("md", "markdown"), "md")
        .when(own.isin("txt", "text"), "txt").when(own.isin("ppt", "pptx"), "pptx")
    ))


def generation_format(payload: Column) -> Column:
    """target_format, output_format, document_type or extension, json and xml left aside; docx for what is not known."""
    places = ("$.target_format", "$.output_format", "$.document_type", "$.extracted_data.document_type", "$.extension")
    names = [X.let(_named(payload, p), lambda n: F.when(~n.isin("json", "xml"), n)) for p in places]
    return X.normalize_extension(F.coalesce(*names))


def read_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds `extension` and `doc` to rows of JSON: the document itself, or one wrapped in `extracted_data`, even twice."""
    c = F.col(payload)
    body = F.coalesce(F.get_json_object(c, "$.extracted_data.extracted_data"), F.get_json_object(c, "$.extracted_data"), c)
    return df.withColumns({"extension": payload_extension(c), "doc": F.from_json(body, DOCUMENT)})


def chunk_request(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds extension, filename, chunks and error to rows of JSON with `extracted_data` and, perhaps, a filename.

    HTML and payloads without a document are errors; a format that is not known, or not named, is docx."""
    from vellum.sources.documents import chunk

    c = F.col(payload)
    named = _named(c, "$.extension", "$.input_format")
    own = X.normalize_extension(F.coalesce(named, F.lit("docx")))
    error = F.when(F.get_json_object(c, "$.extracted_data").isNull(), "extracted_data is required").when(F.col("extension") == "html", "html is not supported")
    rows = read_payloads(df, payload).withColumn("extension", own).withColumn("error", error)
    rows = rows.withColumn("doc", F.when(F.col("error").isNull(), F.col("doc").withField("source_type", F.col("extension"))))
    rows = chunk(rows, "chunks").withColumn("filename", X.chunk_filename(F.get_json_object(c, "$.filename"), F.col("extension")))
    return rows.withColumn("chunks", F.when(F.col("error").isNull(), F.col("chunks"))).drop("doc")


def to_payload(doc: Column, extension: Column) -> Column:
    """The extraction's answer as JSON; payloads of media and parts become base64."""
    return F.to_json(F.struct(extension.alias("extension"), F.lit("json").alias("output_format"), doc.alias("extracted_data")))
