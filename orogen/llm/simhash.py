"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.common import connected_components, cut, free_names, in_slices

RADIUS = 3
SHINGLE = 3
SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SHIFTS = np.arange(64, dtype=np.uint64)
_BATCH = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text; 0 for null and for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, max(1, len(words) - shingle + 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _BATCH):
        bits = np.unpackbits(h[at : at + _BATCH].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int((np.uint64(1) << _SHIFTS[2 * ones > len(h)]).sum(dtype=np.uint64)) if len(h) else 0


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp long) of every row of docs, and its long columns keep; the text is read whole."""

    def run(batches):
        for b in in_slices(batches, 1):
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], ["doc_id", "fp", *keep])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *keep)))


def _ball(fp, bits: int):
    """All values within one flipped bit of fp among its lowest bits: half the radius, rounded down."""
    return F.concat(F.array(fp), F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over as many partitions as a shuffle has: narrow rows lie in few files, and each is about to become many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def links_within_two(fps: DataFrame) -> DataFrame:
    """Edges (u, v) whose components are those of all fingerprints at most 2 bits apart.

    Every fingerprint emits its ball of radius 1. Fingerprints that meet in a variant differ from one another in at most
    2 bits, and any such two meet. A variant's members are kept as the mask of the bits they flipped, so a bucket is two
    longs however many rows fall into it, and it gives a star of at most 64 edges instead of all its pairs.
    """
    buckets = (
        spread(fps.select("fp"), "fp").select("fp", F.explode(_ball(F.col("fp"), 64)).alias("variant"))
        .groupBy("variant")
        .agg(F.bit_or(F.col("variant").bitwiseXOR(F.col("fp"))).alias("mask"), F.count("*").alias("n"))
        .where("n > 1")
    )
    flips = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(F.lit(1)) == 1),
        lambda i: F.col("variant").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)),
    )
    members = F.when(F.col("n") > F.bit_count("mask"), F.concat(F.array("variant"), flips)).otherwise(flips)
    return buckets.select(members.alias("members")).select(F.array_min("members").alias("v"), F.explode("members").alias("u")).where("u <> v").select("u", "v")


def links_at_three(parts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between components of parts (fp, component) that hold fingerprints at most radius (3) bits apart.

    The radius is odd: one of the two 32-bit halves differs in at most half of it, 1 bit. Each fingerprint emits
    every variant of each half within that distance (of two halves 1 bit apart, the one without the bit sets it, so one side's ball is enough),
    and meets the plain halves of the others there. Colliding pairs are verified in the join; what is joined already is left out.
    """
    low = F.lit(0xFFFFFFFF).cast("long")
    halves = spread(parts, "fp").select("fp", "component", F.posexplode(F.array(F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 32))).alias("side", "half"))
    key = lambda value: F.col("side").cast("long") * F.lit(1 << 32).cast("long") + value
    plain = halves.select(key(F.col("half")).alias("key"), F.col("fp").alias("fp_b"), F.col("component").alias("v"))
    up = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftright", F.col("half"), i).bitwiseAND(F.lit(1)) == 0)
    ball = F.concat(F.array("half"), F.transform(up, lambda i: F.col("half").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    balls = halves.select("side", "fp", "component", F.explode(ball).alias("variant")).select(key(F.col("variant")).alias("key"), F.col("fp").alias("fp_a"), F.col("component").alias("u"))
    near = (F.col("u") != F.col("v")) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= radius)
    return balls.join(plain, (balls["key"] == plain["key"]) & near).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def groups_of(rows: DataFrame) -> DataFrame:
    """(fp, first_id, part) of every fingerprint of rows (doc_id, fp): its smallest doc_id, and what its group has in common."""
    groups = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "groups")
    two = connected_components(links_within_two(groups.select("fp")))
    parts = cut(groups.join(two, groups["fp"] == two["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component")), "parts")
    three = connected_components(links_at_three(parts))
    whole = parts.join(three, parts["component"] == three["node"], "left").select("fp", "first_id", F.coalesce(three["component"], parts["component"]).alias("part"))
    return cut(whole, "whole")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of at most 3 bits).

    Null, empty and wordless texts have fingerprint 0 and link like any other. Rows with the same text or doc_id each stay a
    row; rows whose doc_id is null take part with their fingerprint but are never a component's name (a component of
    such rows only has a null one). An empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    rows = cut(fingerprints(docs), "fingerprints")
    whole = groups_of(rows)
    names = whole.groupBy("part").agg(F.min("first_id").alias("component_id"))
    named = whole.join(names, "part").select(F.col("fp").alias("fp_b"), "component_id")
    return rows.join(named, rows["fp"] == named["fp_b"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of every near-duplicate group: the one with the smallest doc_id (a null one comes last), of these the one with the smallest hash.

    Null, empty and wordless texts are one group. Repeated ids with different texts stand for themselves; equal rows are one group, of which one row stays. An
    empty table gives an empty one; all columns stay as they are, whatever their names.
    """
    one, two = free_names(docs, "_h1", "_h2")
    each = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    hashed = docs.withColumns({one: F.xxhash64(each), two: F.xxhash64(each, F.lit(1))})  # of the whole row: rows that agree in both are equal
    rows = cut(fingerprints(hashed, (one, two)), "fingerprints")
    whole = groups_of(rows).select(F.col("fp").alias("fp_b"), "part")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(one).alias("h1"), F.col(two).alias("h2"))
    firsts = rows.groupBy("fp").agg(F.min(order).alias("first"))  # by fingerprint before by group: a group's rows do not meet in one task
    kept = firsts.join(whole, firsts["fp"] == whole["fp_b"]).groupBy("part").agg(F.min("first").alias("first"))
    k1, k2 = free_names(hashed, "_k1", "_k2")
    kept = kept.select(F.col("first.h1").alias(k1), F.col("first.h2").alias(k2))
    return hashed.join(kept, (hashed[one] == kept[k1]) & (hashed[two] == kept[k2]), "left_semi").dropDuplicates([one, two]).select(*(F.col(f"`{c}`") for c in docs.columns))
