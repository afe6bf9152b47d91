"""Nested embedding records to token vectors and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import normalise, round_values, to_float32
from ..options import STOP_WORDS

RECORD_SCHEMA = (
    "linex_index bigint, features array<struct<token:string,"
    "layers:array<struct<index:bigint,values:array<double>>>>>"
)
_RECORD_BITS, _TOKEN_BITS, _LAYER_BITS = 31, 20, 12  # parts of a vector id


def only_key(mapping: Column, key: str) -> Column:
    """Keep one key of a map."""
    return F.map_filter(mapping, lambda k, _: k == key)


def unnest(records: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Records to one row per token and layer, without shuffle.

    ``vec_id`` comes from the record number and the place in the record, so it is
    unique within a file and needs no global numbering. A number that does not fit its
    part of the id is an error.
    """
    # The outer form keeps Spark from testing the size of ``features`` first: that test would be
    # pushed below whatever made them, with all its expressions written out once more.
    tokens = records.select(*keys, "linex_index", F.posexplode_outer("features").alias("tok", "feature"))
    tokens = tokens.filter(F.col("tok").isNotNull())
    layers = tokens.select(
        *keys, "linex_index", "tok", "feature.token", F.posexplode("feature.layers").alias("lay", "layer")
    )
    place = F.shiftleft(F.col("linex_index"), _TOKEN_BITS + _LAYER_BITS) + F.shiftleft(
        F.col("tok").cast("bigint"), _LAYER_BITS
    ) + F.col("lay")
    fits = (F.col("linex_index").between(0, 2**_RECORD_BITS - 1)) & (F.col("tok") < 2**_TOKEN_BITS) & (F.col("lay") < 2**_LAYER_BITS)
    place = F.when(fits, place).otherwise(F.raise_error(F.lit("record, token or layer number too large for a vector id")))
    return layers.select(
        *keys, place.alias("vec_id"), "token", F.col("layer.index").alias("layer"), F.col("layer.values").alias("values")
    )


def pick_layers(features: Column, layers: Sequence[int]) -> Column:
    """Keep some layers of every token, by place; negative counts from the end."""
    return F.transform(
        features,
        lambda f: F.struct(
            f["token"].alias("token"),
            F.array(*[F.element_at(f["layers"], k + 1 if k >= 0 else k) for k in layers]).alias("layers"),
        ),
    )


def without_tokens(rows: DataFrame, dropped: Sequence[str] = STOP_WORDS, token: str = "token") -> DataFrame:
    """Leave out stop words (or special tokens)."""
    return rows.filter(~F.col(token).isin(*dropped))


def token_vectors(
    records: DataFrame, keys: Sequence[str] = ("file_id",), dropped: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """Unit-length token vectors (keys, vec_id, token, embedding) without stop words."""
    rows = without_tokens(unnest(records, keys), dropped)
    return rows.select(*keys, "vec_id", "token", normalise(to_float32(F.col("values"))).alias("embedding"))


def rounded_records(records: DataFrame, digits: int = 6) -> DataFrame:
    """Round all vectors, as the record files hold them."""
    def layer(x: Column) -> Column:
        return F.struct(x["index"].alias("index"), round_values(x["values"], digits).alias("values"))

    features = F.transform(
        "features",
        lambda f: F.struct(f["token"].alias("token"), F.transform(f["layers"], layer).alias("layers")),
    )
    return records.withColumn("features", features)
