"""Secrets in texts, told apart by how many owners and repositories share them; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.llm.common import cut

#: Kind, pattern, group that holds the secret, least length (of that group).
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),  # of 18 characters or more: the same as dropping shorter matches afterwards
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
COPIED_OWNERS = 3  # a value under so many owners is a copied example
COPIED_REPOSITORIES = 10  # and so is one in so many repositories, be it under one owner
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def matches(text: Column, kind: int) -> Column:
    """All leftmost non-overlapping matches of a kind in a text: array of (start, kind, end, value), in code points.

    The pieces between the matches give the positions; the texts without a match, nearly all, are only searched once.
    """
    _, pattern, group, least = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("before"), whole.alias("whole"), value.alias("value"))

    def add(state, x):
        start = state["at"] + F.length(x["before"])
        end = start + F.length(x["whole"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    found = F.aggregate(F.filter(rows, lambda x: x["whole"].isNotNull()), start, add, lambda state: state["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def spell(spans: Column, names: list[str]) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    kinds = F.array(*map(F.lit, names))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories) of candidates (hash, owner, repository). A hash that a third of all rows hold is pre-aggregated at each step."""
    return (
        candidates.groupBy("hash", "owner", "repository")
        .agg(F.lit(1).alias("one"))
        .groupBy("hash", "owner")
        .agg(F.count("repository").alias("repositories"))
        .groupBy("hash")
        .agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"))
    )


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", copied: int = COPIED_OWNERS, spread: int = COPIED_REPOSITORIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_copied, n_repositories of every row of docs.

    Each matched value is hashed and counted over the whole corpus by distinct owner (a document's source) and repository (its
    doc_id, of an owner). Values of one owner in fewer than spread repositories look live: they add a span `owned` over the value; values under
    copied or more owners, or in spread or more repositories, be it under one owner, count as copied examples (n_copied). n_repositories: of the row's values
    the most repositories, 0 without a value. A null text is empty, one of any length is read whole; a null owner is an owner of its own and a null doc_id no
    repository; repeated rows each stay a row and count once; other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), *(matches(text, k).alias(f"k{k}") for k in range(len(KINDS))))
    found = cut(found.withColumn("row", F.monotonically_increasing_id()), "secrets")  # written, so that row stays the same
    some = F.concat("k0", "k1", "k2")
    seen = found.where(F.size(some) > 0).select("row", F.coalesce("owner", F.lit("\0")).alias("owner"), "repository", F.explode(some).alias("span")).withColumn("hash", F.unhex(F.sha2("span.value", 256)))
    counts = ownership(seen)
    judged = seen.join(counts, "hash").groupBy("row").agg(
        F.collect_set(F.when((F.col("n_owners") == 1) & (F.col("n_repositories") < spread), F.struct((F.col("span.end") - F.length("span.value")).alias("start"), F.lit(len(KINDS)).alias("kind"), F.col("span.end").alias("end")))).alias("owned"),
        F.sum(((F.col("n_owners") >= copied) | (F.col("n_repositories") >= spread)).cast("long")).alias("n_copied"),
        F.max("n_repositories").alias("n_repositories"),
    )
    base = F.transform(some, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    names = [k[0] for k in KINDS] + ["owned"]
    owned = F.coalesce("owned", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    out = found.join(judged, "row", "left")
    counted = [F.size(f"k{k}").cast("long").alias(f"n_{KINDS[k][0]}") for k in range(len(KINDS))]
    return out.select("doc_id", *counted, F.sha2(spell(base, names), 256).alias("base_sha256"), spell(F.concat(base, owned), names).alias("spans"), F.size(owned).cast("long").alias("n_owned"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_copied", "n_repositories")))


_DUCK = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source AS owner, coalesce(text, '') AS t FROM documents),
m AS (
  {kinds}
),
p AS (SELECT row, kind, unnest(generate_series(1, len(whole))) AS i, before, whole, value FROM m WHERE len(whole) > 0),
s AS (SELECT row, kind, whole[i] AS w, value[i] AS v, list_sum(list_transform(before[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0) AS start FROM p),
b AS (SELECT row, kind, CAST(start AS BIGINT) AS start, CAST(start + length(w) AS BIGINT) AS stop, v FROM s WHERE length(v) >= CASE kind WHEN 0 THEN 12 WHEN 1 THEN 18 ELSE 16 END),
c AS (SELECT v, count(DISTINCT coalesce(owner, chr(1))) AS n_owners, count(DISTINCT coalesce(owner, chr(1)) || '/' || doc_id) AS n_repositories FROM b JOIN d USING (row) GROUP BY v),
o AS (SELECT DISTINCT row, 3 AS kind, stop - length(v) AS start, stop FROM b JOIN c USING (v) WHERE n_owners = 1 AND n_repositories < 10),
a AS (SELECT row, kind, start, stop FROM b UNION ALL SELECT row, kind, start, stop FROM o),
names AS (SELECT row, kind, start, stop, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS said FROM a),
g AS (SELECT row, string_agg(said, ',' ORDER BY start, kind, stop) AS spans, string_agg(said, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_owned FROM names GROUP BY row),
e AS (SELECT row, count(*) FILTER (n_owners >= 3 OR n_repositories >= 10) AS n_copied, max(n_repositories) AS n_repositories FROM b JOIN c USING (v) GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied, coalesce(n_repositories, 0) AS n_repositories
FROM d LEFT JOIN g USING (row) LEFT JOIN e USING (row)
"""


def oracle_sql() -> str:
    one = "SELECT row, {k} AS kind, string_split_regex(t, {p}) AS before, regexp_extract_all(t, {p}) AS whole, regexp_extract_all(t, {p}, {g}) AS value FROM d"
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    return _DUCK.format(kinds=" UNION ALL ".join(one.format(k=k, p=quoted(p), g=g) for k, (_, p, g, _) in enumerate(KINDS)))
