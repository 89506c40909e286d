"""JSON documents of models: untrusted, so every read is a try."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(json: Column) -> Column:
    """A variant; null for null and for text that is no JSON."""
    return F.try_parse_json(json)


def is_truthy(doc: Column) -> Column:
    """False for null, {}, [], "", 0 and false, as dynamic languages have it; true for all else."""
    text = F.to_json(doc)
    return F.coalesce(~F.is_variant_null(doc) & ~text.isin("{}", "[]", '""', "false") & ~text.rlike(r"^-?0+(\.0+)?([eE].*)?$"), F.lit(False))


def is_object(doc: Column) -> Column:
    return F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))


def text_field(doc: Column, key: str, default: str) -> Column:
    """The default stands for a missing key only; an explicit null stays null."""
    value = F.try_variant_get(doc, f"$.{key}", "variant")
    return F.when(value.isNull(), F.lit(default)).otherwise(F.try_variant_get(doc, f"$.{key}", "string"))


def list_field(doc: Column, key: str) -> Column:
    """A list of strings; missing: empty; null: null; a scalar: a list of itself."""
    value = F.try_variant_get(doc, f"$.{key}", "variant")
    listed = F.try_variant_get(doc, f"$.{key}", "array<string>")
    single = F.try_variant_get(doc, f"$.{key}", "string")
    return (
        F.when(value.isNull(), F.array().cast("array<string>"))
        .when(F.is_variant_null(value), F.lit(None).cast("array<string>"))
        .otherwise(F.coalesce(listed, F.when(single.isNotNull(), F.array(single))))
    )


def event_json(event: Column, paper_id: Column, title: Column | None = None) -> Column:
    """An event as it is published; a null title is left out."""
    title = F.lit(None).cast("string") if title is None else title
    return F.to_json(F.struct(event.alias("event"), paper_id.cast("string").alias("id"), title.alias("title")))
