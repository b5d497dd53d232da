"""What arrives against what is declared: fields that are missing, new or of another type."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tickerloom.schemas import ENDPOINT_FIELDS

Sections = Mapping[str, Mapping[str, Mapping[str, str]]]

# fixed values: what a field of each declared type may arrive as
FITS = {"string": ("string",), "bigint": ("bigint",), "double": ("bigint", "double"), "boolean": ("boolean",)}


def variant_kind(value: Column) -> Column:
    """bigint, double, string, boolean, array, object, or void for a JSON null."""
    kind = F.lower(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))
    return F.when(kind.isin("decimal", "float"), "double").otherwise(kind)


def arrived_fields(responses: DataFrame) -> DataFrame:
    """endpoint, field, kind, n: how often each field arrived as each kind, in one pass over ``endpoint, body``.

    A body is an object or a list of objects. A null ``field`` counts what is
    neither: bodies that can't be read (kind ``unreadable``), and list members and
    bodies that are no object (their own kind).
    """
    body = F.try_parse_json(F.col("body"))
    read = responses.where(F.col("body").isNotNull()).select("endpoint", body.alias("v")).withColumn("kind", variant_kind(F.col("v")))
    several = F.when(F.col("kind") == "array", F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    members = read.select("endpoint", F.explode(several).alias("r")).withColumn("kind", F.coalesce(variant_kind(F.col("r")), F.lit("unreadable")))
    fields = F.when(F.col("kind") == "object", F.map_entries(F.try_variant_get("r", "$", "map<string, variant>")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("r").alias("value")))
    each = members.select("endpoint", F.col("kind").alias("whole"), F.inline(F.coalesce(fields, whole)))
    kind = F.when(F.col("key").isNull(), F.col("whole")).otherwise(variant_kind(F.col("value")))
    return each.select("endpoint", F.col("key").alias("field"), kind.alias("kind")).groupBy("endpoint", "field", "kind").agg(F.count("*").alias("n"))


def field_drift(responses: DataFrame, sections: Sections = ENDPOINT_FIELDS) -> DataFrame:
    """section, endpoint, field, declared, seen, filled, status: a row for each declared field and each one that arrived.

    ``seen`` lists the kinds of the field's values, ``filled`` counts those that
    aren't null. Status: ``ok``; ``absent``, declared and never filled; ``undeclared``,
    arrived without a declaration; ``retyped``, filled with a kind that does not fit;
    ``unreadable``, bodies or members that are no object (a null field).
    """
    declared = responses.sparkSession.createDataFrame(
        [(section, endpoint, field, kind) for section, members in sections.items() for endpoint, fields in members.items() for field, kind in fields.items()],
        "section string, d_endpoint string, d_field string, declared string",
    )
    filled = F.col("kind") != "void"
    arrived = arrived_fields(responses).groupBy("endpoint", "field").agg(
        F.array_sort(F.collect_set(F.when(filled, F.col("kind")))).alias("kinds"), F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("filled")
    )
    joined = arrived.join(declared, (F.col("endpoint") == F.col("d_endpoint")) & (F.col("field") == F.col("d_field")), "full")
    fits = F.lit(False)
    for kind, may in FITS.items():
        fits = fits | ((F.col("declared") == kind) & (F.size(F.array_except("kinds", F.array(*map(F.lit, may)))) == 0))
    none = F.coalesce("filled", F.lit(0)) == 0
    status = (
        F.when(F.col("declared").isNull(), F.when(F.col("field").isNull(), "unreadable").otherwise("undeclared"))
        .when(none, "absent").when(fits, "ok").otherwise("retyped")
    )
    return joined.select(
        "section", F.coalesce("endpoint", "d_endpoint").alias("endpoint"), F.coalesce("field", "d_field").alias("field"), "declared",
        F.coalesce(F.array_join("kinds", ","), F.lit("")).alias("seen"), F.coalesce("filled", F.lit(0)).alias("filled"), status.alias("status"),
    )
