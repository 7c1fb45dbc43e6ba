"""Benchmark decontamination by a positional inverted index; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.llm.common import cut

WINDOW = 13  # words of a phrase
NEAR = 10  # words of a window (repeated ones as often) that make a proximity match, within its length and in any order
CLOSE = 3  # words of a window's rarest that must stand together before its other words are read
BROADCAST_WINDOWS = 100_000  # test phrases up to so many are broadcast (about 300 bytes each); more meet the index in a salted shuffle
SALTS = 32  # parts of a term's postings where they meet in a shuffle
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The words of a text, lower-cased, at 1, 2, ...; an empty string at 0, and another at the end if the text ends in a break."""
    return F.split(F.concat(F.lit(" "), lower(F.coalesce(text.cast("string"), F.lit("")))), _BREAK, -1)


def count_of(listed: Column) -> Column:
    return F.size(listed) - 1 - (F.element_at(listed, -1) == "").cast("int")


def phrases(items: DataFrame, id_column: str = "item_id") -> DataFrame:
    """(item, words) of all windows of the items; an item of fewer words than a window, but not none, is one window. Items without an id are left out."""
    cut_words = F.slice(F.col("w"), 2, F.greatest(F.col("n"), F.lit(0)))
    rows = items.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("string").alias("item"), words(F.col("text")).alias("w")).withColumn("n", count_of(F.col("w"))).select("item", "n", cut_words.alias("w")).where("n > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - WINDOW + 1, F.lit(1)))
    return rows.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), WINDOW).alias("words")).distinct()


def meet(entries: DataFrame, listed: DataFrame, small: bool) -> DataFrame:
    """Index entries with the rows of listed that name their term. Where listed is not small, a term's postings are dealt to SALTS parts."""
    if small:
        return entries.join(F.broadcast(listed), "term")
    salted = entries.withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.lit(SALTS)).cast("int"))
    return salted.join(listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["term", "salt"]).drop("salt")


def build_index(docs: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """The positional index, written once: (row, pos, term) of every place where docs (doc_id, text) have a word of the windows, pos from 1.

    row is a number given here to each row of docs. A row's entry at pos 0 has an empty term, and alone carries doc_id, n_words and two hashes of the text (h1, h2).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    terms = windows.select(F.explode(F.concat("words", F.array(F.lit("")))).alias("term")).distinct()
    terms = terms.union(terms.sparkSession.range(1).select(F.lit(""))).distinct()  # with no window, too
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    listed = source.select("row", "doc_id", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"), words(F.col("text")).alias("w"))
    counted = listed.select("row", "doc_id", "h1", "h2", count_of(F.col("w")).cast("long").alias("n_words"), "w")
    entries = counted.select("row", "doc_id", "n_words", "h1", "h2", F.posexplode_outer("w").alias("pos", "term"))  # outer, though never empty: Spark then adds no filter that splits the text again
    first = F.col("pos") == 0
    once = [F.when(first, F.col(c)).alias(c) for c in ("doc_id", "n_words", "h1", "h2")]
    return cut(meet(entries.where(first | (F.col("term") != "")), terms, small).select("row", "pos", "term", *once), "index")


def rarest(windows: DataFrame, index: DataFrame) -> DataFrame:
    """(win, item, rare) of each window: its words as (n, offset, term), those with the fewest postings first."""
    counts = index.where("pos > 0").groupBy("term").agg(F.count("*").alias("n"))
    each = windows.select("win", "item", F.posexplode("words").alias("offset", "term")).join(counts, "term", "left").fillna(0, "n")
    return each.groupBy("win", "item").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("rare"))


def phrase_starts(rare: DataFrame, index: DataFrame, small: bool) -> DataFrame:
    """(row, start, win, stretch): where the offset-adjusted postings of a window's two rarest words agree on its first word's place."""
    ends = F.size("rare")
    two = rare.where(F.get("rare", F.lit(0))["n"] > 0).select("win", F.least(ends, F.lit(2)).alias("asked"), F.explode(F.slice("rare", 1, 2)).alias("a")).select("win", "asked", "a.term", "a.offset")
    starts = meet(index.where("pos > 0").select("row", "pos", "term"), two, small).select("row", (F.col("pos") - F.col("offset")).alias("start"), "win", "asked").where("start >= 1")
    agreed = starts.groupBy("row", "start", "win").agg(F.count("*").alias("n"), F.first("asked").alias("asked")).where("n = asked")
    return agreed.select("row", "start", "win", F.expr(f"int(start div {WINDOW})").alias("stretch"))


def close_places(rare: DataFrame, index: DataFrame, small: bool) -> DataFrame:
    """(row, item, stretch) where a proximity match can be: it has all but WINDOW - NEAR words of a window, so CLOSE of any WINDOW - NEAR + CLOSE, here of the rarest, that lie less than WINDOW apart."""
    few = rare.where(F.size("rare") == WINDOW).select("item", F.explode(F.slice("rare", 1, WINDOW - NEAR + CLOSE)).alias("a")).where("a.n > 0").select("item", "a.term").distinct()
    at = meet(index.where("pos > 0").select("row", "pos", "term"), few, small).select("row", "item", "pos")
    lists = at.groupBy("row", "item").agg(F.array_sort(F.collect_list("pos")).alias("at")).where(F.size("at") >= CLOSE)  # a document's places, which lie in one task from the start
    runs = F.filter(F.arrays_zip(F.slice("at", 1, F.size("at") - CLOSE + 1).alias("a"), F.slice("at", CLOSE, F.size("at") - CLOSE + 1).alias("b")), lambda x: x["b"] - x["a"] < WINDOW)
    spans = F.transform(runs, lambda x: F.sequence(F.floor(F.greatest(x["b"] - (WINDOW - 1), F.lit(0)) / WINDOW).cast("int"), F.floor(x["a"] / WINDOW).cast("int")))
    return lists.select("row", "item", F.explode(F.array_distinct(F.flatten(spans))).alias("stretch"))


def stretches_at(places: DataFrame, index: DataFrame) -> DataFrame:
    """(row, stretch, heard): the postings (pos, term) by place of twice WINDOW words from stretch * WINDOW on, at least for all places (row, stretch). Every run of WINDOW words lies in one.

    Places grow with the corpus, so they meet the index by a join that Spark plans by their size.
    """
    cells = cut(places.select("row", F.explode(F.array(F.col("stretch"), F.col("stretch") + 1)).alias("cell")).distinct(), "cells")
    entries = index.where("pos > 0").select("row", "pos", "term", F.expr(f"int(pos div {WINDOW})").alias("cell")).join(cells, ["row", "cell"], "left_semi")
    twice = entries.select("row", F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("stretch"), F.struct("pos", "term").alias("entry")).where("stretch >= 0")
    return cut(twice.groupBy("row", "stretch").agg(F.array_sort(F.collect_list("entry")).alias("heard")), "stretches")


def _heard(start: Column, size: Column | int) -> Column:
    """The test words of a run of the text."""
    return F.transform(F.filter("heard", lambda e: e["pos"].between(start, start + size - 1)), lambda e: e["term"])


def exact_matches(starts: DataFrame, stretches: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, item, start, size) of the windows whose words all have a posting at their places."""
    size = F.size("words")
    return starts.join(stretches, ["row", "stretch"]).join(windows, "win").where(_heard(F.col("start"), size) == F.col("words")).select("row", "item", "start", size.alias("size"))


def near_matches(places: DataFrame, stretches: DataFrame, windows: DataFrame, small: bool) -> DataFrame:
    """(row, item) where a run of WINDOW words has at least NEAR of a window's, in any order and repeated ones as often. A place must hold enough of the item's words before any of its windows is tried."""
    terms = F.array_distinct("words")
    often = F.transform(terms, lambda t: F.struct(t.alias("term"), F.size(F.filter("words", lambda x: x == t)).alias("n")))
    asked = windows.where(F.size("words") == WINDOW).select("item", "words", (F.size(terms) - (WINDOW - NEAR)).alias("least"), F.when(F.size(terms) < WINDOW, often).alias("repeated"))
    whole = asked.groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("own"), F.min("least").alias("fewest"))
    hint = F.broadcast if small else lambda df: df
    there = F.transform("heard", lambda e: e["term"])
    likely = places.join(stretches, ["row", "stretch"]).join(hint(whole), "item").where(F.size(F.array_intersect(there, "own")) >= F.col("fewest")).drop("own", "fewest")
    likely = likely.join(hint(asked), "item").where(F.size(F.array_intersect(there, "words")) >= F.col("least"))
    first = F.col("stretch") * WINDOW
    runs = F.transform(F.sequence(first, first + WINDOW - 1), lambda s: _heard(s, WINDOW))
    different = F.transform(runs, lambda w: F.size(F.array_intersect(w, F.col("words"))))
    counted = F.transform(runs, lambda w: F.aggregate("repeated", F.lit(0), lambda n, t: n + F.least(t["n"], F.size(F.filter(w, lambda x: x == t["term"])))))
    return likely.where(F.array_max(F.when(F.col("repeated").isNull(), different).otherwise(counted)) >= NEAR).select("row", "item").distinct()


def judge(docs: DataFrame, items: DataFrame, near: bool = True) -> DataFrame:
    """doc_id, h1, h2, n_words, n_hit, n_items, items_sha256, contaminated, n_near of every row of docs (h1, h2: hashes of its text).

    The index of the training texts is written once and everything else reads it: the postings of each window's rarest words are intersected by their offsets (phrases) or
    nearness, and only where they agree are the other words' postings read and compared. Items found as phrases are not looked at again for nearness. No Python.
    """
    windows = cut(phrases(items).withColumn("win", F.monotonically_increasing_id()), "windows")
    small = windows.count() <= BROADCAST_WINDOWS
    index = build_index(docs, windows, small)
    rare = cut(rarest(windows, index), "rare")
    listed = F.broadcast(windows) if small else windows
    starts = cut(phrase_starts(rare, index, small), "starts")
    places = starts.select("row", "stretch")
    if near:
        close = cut(close_places(rare, index, small), "close")
        places = places.union(close.select("row", "stretch"))
    stretches = stretches_at(places, index)
    exact = exact_matches(starts, stretches, listed)
    heads = index.where("pos = 0").select("row", "doc_id", "n_words", "h1", "h2")
    found = heads
    if near:
        exact = cut(exact, "exact")
        left = close.join(exact.select("row", "item").distinct(), ["row", "item"], "left_anti")
        found = found.unionByName(near_matches(left, stretches, windows, small).withColumnRenamed("item", "close"), allowMissingColumns=True)
    else:
        found = found.withColumn("close", F.lit(None).cast("string"))
    found = found.unionByName(exact, allowMissingColumns=True)
    grouped = found.groupBy("row").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "h1", "h2", "n_words")),
        F.collect_set(F.when(F.col("item").isNotNull(), F.struct("start", "size"))).alias("spans"),
        F.collect_set("item").alias("items"),
        F.collect_set("close").alias("near"),
    )
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1))))
    return grouped.withColumn("n_hit", F.size(covered).cast("long")).select(
        "doc_id", "h1", "h2", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), F.when(F.col("n_words") < WINDOW, 0).otherwise(F.size("near")).cast("long").alias("n_near"),
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near of every row of docs.

    A null text has no words and is never contaminated; items without a word or an id never match; repeated items count once;
    repeated documents each stay a row; texts of any length are indexed whole; with an empty benchmark no word is hit, and empty documents give an empty result. Columns other than doc_id and text are ignored.
    """
    return judge(docs, items).drop("h1", "h2")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    bad = judge(docs, items, near=False).where("contaminated").select("h1", "h2").distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.join(bad, (F.xxhash64(text) == bad["h1"]) & (F.xxhash64(text, F.lit(1)) == bad["h2"]), "left_anti")
