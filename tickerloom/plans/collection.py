"""Landed endpoint responses to one fundamentals document per symbol."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tickerloom.operators.lookups import look_up, to_do
from tickerloom.operators.ordering import latest_rows
from tickerloom.schemas import ENDPOINT_FIELDS, SHARED_ENDPOINTS, record_type

Sections = Mapping[str, Mapping[str, Mapping[str, str]]]


def endpoint_struct(body: Column, fields: Mapping[str, str], description: str) -> Column:
    """Declared fields of an endpoint's records; an unreadable body has none."""
    data = F.from_json(body, f"array<{record_type(dict(fields))}>")
    return F.struct(F.lit(description).alias("description"), data.alias("data"))


def assemble(
    responses: DataFrame, sectors: DataFrame, collected_at: Column, api_version: str = "v3",
    sections: Sections = ENDPOINT_FIELDS, shared: tuple[str, ...] = SHARED_ENDPOINTS,
    descriptions: Mapping[str, str] | None = None,
) -> DataFrame:
    """Documents from ``responses``: symbol, endpoint, body, at.

    The latest body per symbol and endpoint counts. Shared endpoints have a
    null symbol; all are read at once and put beside every symbol.
    """
    described = descriptions or {}
    own = [e for members in sections.values() for e in members if e not in shared]
    # each task keeps one body per symbol and endpoint before the shuffle
    newest = latest_rows(responses, ["symbol", "endpoint"], [F.col("at").desc()], 1, "_place")
    # at most one row per endpoint and symbol is left to turn
    wide = newest.where(F.col("symbol").isNotNull()).groupBy("symbol").pivot("endpoint", own).agg(F.first("body"))
    common = latest_rows(
        responses.where(F.col("symbol").isNull() & F.col("endpoint").isin(*shared)), ["endpoint"], [F.col("at").desc()], 1, "_place"
    ).agg(F.map_from_entries(F.collect_list(F.struct("endpoint", "body"))))
    wide = wide.withColumn("_shared", common.scalar())
    for endpoint in shared:
        wide = wide.withColumn(endpoint, F.try_element_at("_shared", F.lit(endpoint)))
    placed = look_up(wide, sectors, "symbol", "sector", F.lit(""))
    return placed.select(
        "symbol",
        F.struct(
            F.col("symbol").cast("string").alias("symbol"), "sector",
            collected_at.cast("string").alias("collected_at"), F.lit(api_version).alias("api_version"),
        ).alias("meta"),
        *[
            F.struct(*[
                endpoint_struct(F.col(e), fields, described.get(e, "")).alias(e) for e, fields in members.items()
            ]).alias(section)
            for section, members in sections.items()
        ],
    )


def new_responses(responses: DataFrame, finished: DataFrame) -> DataFrame:
    """Responses of symbols without a document; shared ones always stay."""
    shared = F.col("symbol").isNull()
    own = to_do(responses.where(~shared), finished, "symbol")
    return responses.where(shared).unionByName(own)
