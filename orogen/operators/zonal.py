"""Statistics by tile or raster and the stretches to bytes that use them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orogen.functions.numbers import stretch, to_byte
from orogen.work import cut

#: Mode and bounds by which each product is stretched to bytes.
STRETCHES = {
    "slope": ("value", 0.0, 51.0),
    "hillshade": ("value", 0.0, 1.0),
    "multi-hillshade": ("value", 0.0, 1.0),
    "slrm": ("value", -2.0, 2.0),
    "svf": ("value", 0.6375, 1.0),
    "asvf": ("value", 0.7, 0.9),
    "positive-openness": ("value", 60.0, 95.0),
    "negative-openness": ("value", 60.0, 95.0),
    "sky-illumination": ("percent", 0.25, 0.0),
    "local-dominance": ("value", 0.5, 1.8),
    "msrm": ("value", -2.5, 2.5),
    "mstp": ("value", 0.0, 1.0),
    "vat": ("value", 0.0, 1.0),
}


def sort_key(v: Column) -> Column:
    """A long that orders doubles as their values do: the bits of a double, turned round below zero. Both zeros are one, NaN is above all; not for nulls."""

    @F.arrow_udf(T.LongType())
    def key(z: pa.Array) -> pa.Array:
        bits = (z.to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
        return pa.array(np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits))

    return key(v)


def key_value(k: Column) -> Column:
    """The double of a sort_key."""

    @F.arrow_udf(T.DoubleType())
    def value(z: pa.Array) -> pa.Array:
        bits = z.to_numpy(zero_copy_only=False)
        return pa.array(np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits).view(np.float64))

    return value(k)


def select_ranks(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """zone, what, key: of each zone's keys in order, the one at place rank (from 0). keys: zone, key; wanted: zone, what, rank.

    Counting passes over 16 bits at a time, the highest first: a pass counts the next 16 bits of those keys that begin as a wanted one does, and so fixes 16 more of its bits. A task holds
    counts of at most 65,536 digits for each beginning that is wanted, however many keys or different values a zone has; no key is sorted or sent. What a pass finds, four rows a zone, is written.
    """
    state = wanted.select("zone", "what", "rank", F.lit(0).cast("long").alias("begin"))
    for shift in (48, 32, 16, 0):
        # the sign stays in the highest digit, so digits of one beginning are in the order of their keys
        asked = state.select(F.col("zone").alias("_zone"), F.col("begin").alias("_begin")).distinct()
        begin = F.lit(0).cast("long") if shift == 48 else F.shiftright("key", shift + 16)
        digit = F.shiftright("key", shift) if shift == 48 else F.shiftright("key", shift).bitwiseAND(F.lit(0xFFFF))
        own = keys.select("zone", begin.alias("begin"), digit.alias("digit"))
        own = own if shift == 48 else own.join(asked, (F.col("zone") == F.col("_zone")) & (F.col("begin") == F.col("_begin")), "left_semi")
        counts = own.groupBy("zone", "begin", "digit").agg(F.count("*").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy("zone", "begin").orderBy("digit"))).withColumnsRenamed({"zone": "_zone", "begin": "_begin"})
        here = (F.col("zone") == F.col("_zone")) & (F.col("begin") == F.col("_begin")) & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
        state = cut(state.join(upto, here).select("zone", "what", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), F.shiftleft("begin", 16).bitwiseOR(F.col("digit")).alias("begin")), "ranks")  # used twice by the next pass
    return state.select("zone", "what", F.col("begin").alias("key"))


def percent_bounds(cells: DataFrame, zone: str, low: float, high: float, value: str = "z") -> DataFrame:
    """zone, low, high: values below and above which low and high percent of a zone's valid cells lie, interpolated; the extremes where these are equal.

    Zones without a valid cell, or null, have none. Zone and key of the valid cells are written once and then counted, see select_ranks; memory does not grow with a zone.
    """
    keys = cut(cells.where(F.col(zone).isNotNull() & F.col(value).isNotNull()).select(F.col(zone).alias("zone"), sort_key(F.col(value)).alias("key")), "keys")
    extremes = keys.groupBy("zone").agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
    place = lambda share: (F.col("n") - 1) * F.lit(share)
    places = {"low": place(low / 100), "high": place(1 - high / 100)}
    ranks = F.array(*(F.struct(F.lit(f"{side}{end.__name__}").alias("what"), end(at).cast("long").alias("rank")) for side, at in places.items() for end in (F.floor, F.ceil)))
    found = select_ranks(keys, extremes.select("zone", F.explode(ranks).alias("x")).select("zone", "x.what", "x.rank"))
    table = extremes.join(found.groupBy("zone").pivot("what", ["lowfloor", "lowceil", "highfloor", "highceil"]).agg(F.first("key")), "zone")
    ends = table.select("zone", "n", *(key_value(F.col(c)).alias(c) for c in ("least", "most", "lowfloor", "lowceil", "highfloor", "highceil")))

    def between(side: str) -> Column:
        at, under, above = places[side], F.col(f"{side}floor"), F.col(f"{side}ceil")
        return F.when(under == above, under).otherwise((F.ceil(at) - at) * under + (at - F.floor(at)) * above)

    p = ends.select("zone", "least", "most", between("low").alias("low"), between("high").alias("high"))
    flat = F.col("low") >= F.col("high")
    return p.select(F.col("zone").alias(zone), F.when(flat, F.col("least")).otherwise(F.col("low")).alias("low"), F.when(flat, F.col("most")).otherwise(F.col("high")).alias("high"))


def stretch_percent(cells: DataFrame, zone: str, low: float, high: float, value: str = "z") -> DataFrame:
    """cells with v: value stretched between its zone's percentiles."""
    bounds = percent_bounds(cells, zone, low, high, value)
    return cells.join(bounds, zone, "left").select(*cells.columns, stretch(F.col(value), F.col("low"), F.col("high")).alias("v"))


def product_bytes(cells: DataFrame, product: str, bands: list[str], zone: str = "tile_id") -> DataFrame:
    """cells with each band as a byte under its product's stretch; a missing value is 0."""
    mode, low, high = STRETCHES[product]
    if mode == "value":
        return cells.select(*(to_byte(stretch(F.col(c), low, high)).alias(c) if c in bands else F.col(c) for c in cells.columns))
    for c in bands:
        bounds = percent_bounds(cells, zone, low, high, c)
        cells = cells.join(bounds, zone, "left").select(*(to_byte(stretch(F.col(c), F.col("low"), F.col("high"))).alias(c) if x == c else F.col(x) for x in cells.columns))
    return cells


def filled(v: Column, nodata: float) -> Column:
    """v with the sentinel for what is missing: for sinks only."""
    return F.coalesce(v, F.lit(float(nodata)))
