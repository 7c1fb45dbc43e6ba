"""Toxic passages: maximum-scoring segments over token log-odds, judged by extreme-value statistics."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.common import cut, drop, free_names

BANDS, IN_BAND = 8, 4  # min-hashes by which near copies find one another before they vote: they agree on one band of 8, each of 4
COPY = 0.8  # word pairs two texts share, of all they have, from which on they are near copies
LEAST_Z = 4.0
DRIFT = 0.5  # what a token without a score costs a segment
BROADCAST_ROWS = 1_000_000  # labels up to so many rows are broadcast; more are joined by a shuffle
LEXICON_BYTES = 64 << 20  # a lexicon up to this size in memory is sent to the workers; a larger one stays a table and meets the documents' tokens in a join, with the same result
ENTRY_BYTES = 150  # what an entry of a dict takes beside its token's letters
SALTS = 32  # parts that the rows of one token fall into in that join
STEMS = range(5, 9)  # lengths of the beginnings that count as stems
BINS, BIN = 400, 0.25
_TOKEN = re.compile(r"[^\W_]+")
_ODD = np.random.default_rng(42).integers(0, 1 << 31, BANDS * IN_BAND, np.uint32) * np.uint32(2) + np.uint32(1)
_FLUSH = 300_000
_PIECE = 1 << 14
_KNOWN = 500_000


@dataclass
class Model:
    """scores: of the telling tokens, as a dict or, where they are too many to send, as a table (token, score)."""

    scores: dict[str, float] | DataFrame
    decay: float  # lambda of the extreme-value law
    scale: float  # its K
    slope: float
    offset: float

    def probability(self, x: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -50, 50))))


def maximal_segments(items: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last token, score) of a sequence in linear time (Ruzzo and Tompa 1999).

    items: positions and scores of the scored tokens, ascending; every other token costs drift.
    """
    found: list[list] = []  # first, last, total before, total after
    total, at = 0.0, -1
    for position, score in items:
        total -= drift * (position - at - 1)
        at = position
        if score <= 0:
            total += score
            continue
        new = [position, position, total, total + score]
        total += score
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new = [*new[:4], j]
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(f[0], f[1], f[3] - f[2]) for f in found]


def statistic(segments: list[tuple[int, int, float]], n_tokens: int, decay: float) -> float:
    """The strongest evidence of the r best segments together: normalised scores less the log of the search space and of r!."""
    best, total, penalty = 0.0, 0.0, 0.0
    for r, score in enumerate(sorted((s for *_, s in segments), reverse=True), 1):
        total += decay * score - np.log(n_tokens + 1.0)
        penalty += np.log(r)
        best = max(best, total - penalty)
    return best


def parts(token: str) -> list[str]:
    """What a token is scored by: itself and its beginnings, so that compounds and inflected forms share their stem's evidence."""
    return [token, *(token[:n] + "*" for n in STEMS if n < len(token))]


class Scorer:
    """Positions and scores of a text's telling tokens. A token has the highest score of its parts; those seen are remembered."""

    def __init__(self, scores: dict[str, float] | None):
        self.scores, self.known = scores, {}

    def __call__(self, text: str, own: list[dict] | None = None) -> tuple[list[tuple[int, float]], int]:
        """own: token and score of the text's telling tokens where they come with it."""
        tokens, known = _TOKEN.findall(text.lower()), self.known
        if self.scores is None:
            known = {t["token"]: t["score"] for t in own or ()}
        else:
            if len(known) > _KNOWN:
                known.clear()
            for t in set(tokens):
                if t not in known:
                    known[t] = max((self.scores[p] for p in parts(t) if p in self.scores), default=0.0)
        return [(i, known[t]) for i, t in enumerate(tokens) if known.get(t)], len(tokens)


def with_own(docs: DataFrame, scores: DataFrame, text: str) -> DataFrame:
    """docs with a last column _own: token and score of the different telling tokens of its text, null where it has none.

    The corpus's different tokens get their scores first, each from the best of its parts; only then do the tokens of each document meet them, those of one token in
    SALTS parts. A document's list is no longer than its text.
    """
    (row_id,) = free_names(docs, "_row")
    numbered = cut(docs.withColumn(row_id, F.monotonically_increasing_id()), "numbered")

    def words(batches):
        for b in batches:
            for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = sorted(set(_TOKEN.findall((t or "").lower())))
                for at in range(0, len(own), _PIECE):
                    some = own[at : at + _PIECE]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(some), pa.int64()), pa.array(some, pa.string())], ["_row", "token"])

    said = cut(numbered.select(row_id, text).mapInArrow(words, "_row long, token string"), "said")
    stems = [F.when(F.length("token") > n, F.concat(F.substring("token", 1, n), F.lit("*"))) for n in STEMS]
    split = said.select("token").distinct().select("token", F.explode(F.array_compact(F.array("token", *stems))).alias("part"))
    best = split.join(scores.toDF("part", "score"), "part").groupBy("token").agg(F.max("score").alias("score"))
    salted = best.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = said.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(salted, ["token", "_salt"]).groupBy("_row").agg(F.collect_list(F.struct("token", "score")).alias("_own"))
    return numbered.join(own.withColumnRenamed("_row", row_id), row_id, "left").select(*(F.col(f"`{c}`") for c in docs.columns), "_own")


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled rows; labels that disagree on a doc_id count as toxic."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    if labels.count() <= BROADCAST_ROWS:
        own = F.broadcast(own)
    return docs.join(own, docs["doc_id"].cast("long") == own["label_id"]).select("doc_id", F.col("text").cast("string").alias("text"), "toxic").where("text is not null")


def _pairs(text: str) -> np.ndarray:
    """Hashes of the different word pairs of a text; a text of one word or none is one pair."""
    words = text.lower().split()
    pairs = map(" ".join, zip(words, words[1:])) if len(words) > 1 else [" ".join(words)]
    return np.unique(np.array([zlib.crc32(p.encode("utf-8", "replace")) for p in pairs], np.uint32))


def _bands(pairs: np.ndarray) -> list[int]:
    """BANDS hashes, each of IN_BAND min-hashes. Texts that share few pairs agree on none; near copies on one nearly always."""
    least = np.full(len(_ODD), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(pairs), _PIECE):
        h = pairs[at : at + _PIECE, None] * _ODD
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(13)
        least = np.minimum(least, h.min(axis=0))
    return [zlib.crc32(b.tobytes()) for b in least.reshape(BANDS, IN_BAND)]


def near_copies(rows: DataFrame) -> DataFrame:
    """(row) of rows (row, text; row begins with the toxic label) that are near copies of an earlier row with the same label.

    Bands only propose: a row meets the first row of each of its buckets, and counts as a near copy where at least COPY of their word pairs
    are the same. The first of rows that hang together never is one.
    """

    def sketch(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_bands(_pairs(t)) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["row", "bands"])

    def paired(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_pairs(t).view(np.int32) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["row", "pairs"])

    kind = rows.schema["row"].dataType.simpleString()
    named = cut(rows.mapInArrow(sketch, f"row {kind}, bands array<long>").select("row", F.posexplode("bands").alias("band", "bucket")), "bands")
    firsts = named.groupBy("band", "bucket", "row.toxic").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = (named["band"] == firsts["band"]) & (named["bucket"] == firsts["bucket"]) & (named["row.toxic"] == firsts["toxic"])
    met = cut(named.join(firsts, same).select("row", "first").where("row <> first").distinct(), "met")
    asked = met.select("row").union(met.select("first")).distinct()
    small = met.count() <= BROADCAST_ROWS
    pairs = cut(rows.join(F.broadcast(asked) if small else asked, "row", "left_semi").mapInArrow(paired, f"row {kind}, pairs array<int>"), "pairs")
    both = met.join(pairs.select(F.col("row").alias("first"), F.col("pairs").alias("of_first")), "first").join(pairs, "row")
    shared = F.size(F.array_intersect("pairs", "of_first"))
    out = cut(both.where(shared >= COPY * (F.size("pairs") + F.size("of_first") - shared)).select("row").distinct(), "copies")
    for t in (named, met, pairs):
        drop(t)
    return out


def token_counts(rows: DataFrame) -> DataFrame:
    """(token, toxic, clean): in how many labelled documents of either kind it occurs, where of copies and near copies with one label only the first counts."""
    hashes = F.xxhash64("text"), F.xxhash64("text", F.lit(1))
    rows = rows.select(F.struct("toxic", "doc_id", hashes[0].alias("h1"), hashes[1].alias("h2")).alias("row"), "text", "toxic")
    texts = rows.groupBy("row").agg(F.count("*").alias("n")).groupBy("row.toxic", "row.h1", "row.h2").agg(F.min(F.struct("row", "n")).alias("first"))
    texts = cut(texts.select("first.row", "first.n"), "texts")
    small = texts.count() <= BROADCAST_ROWS
    sent = F.broadcast if small else lambda t: t
    distinct = rows.join(sent(texts.where("n = 1").select("row")), "row", "left_semi")
    again = texts.where("n > 1").select("row")
    if again.count():  # rows that are there more than once
        distinct = distinct.unionByName(rows.join(sent(again), "row", "left_semi").dropDuplicates(["row"]))
    copies = near_copies(distinct.select("row", "text"))
    voters = distinct.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "row", "left_anti")

    def count(batches):
        both = (Counter(), Counter())

        def flush():
            keys = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([both[1][k] for k in keys], pa.int64()), pa.array([both[0][k] for k in keys], pa.int64())], ["token", "toxic", "clean"])
            both[0].clear(), both[1].clear()

        for b in batches:
            for t, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                both[bool(toxic)].update({p for w in set(_TOKEN.findall(t.lower())) for p in parts(w)})
                if len(both[0]) + len(both[1]) > _FLUSH:
                    yield from flush()
        yield from flush()

    return voters.select("text", "toxic").mapInArrow(count, "token string, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon(counts: DataFrame) -> tuple[dict[str, float] | DataFrame, float]:
    """Scores of the telling tokens (log-odds under an informative Dirichlet prior), and lambda of their law among clean tokens.

    The law is found from the tokens' shares by score, in thousandths, so the driver reads no more rows than there are such scores. The scores are a dict up to
    LEXICON_BYTES and a written table beyond.
    """
    counts = cut(counts, "counts")
    total = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("*").alias("n")).first()
    if not total.toxic or not total.clean:
        drop(counts)
        return {}, 1.0
    size = float(min(total.toxic, total.clean))  # pseudo-counts of the Dirichlet prior, dealt by overall frequency
    prior = F.lit(size) * (F.col("toxic") + F.col("clean")) / F.lit(float(total.toxic + total.clean))
    odds = lambda c, n: F.log((F.col(c) + prior) / (F.lit(n + size) - F.col(c) - prior))
    delta = odds("toxic", float(total.toxic)) - odds("clean", float(total.clean))
    z = delta / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    share = (F.col("clean") + prior) / F.lit(total.clean + size)
    telling = cut(counts.select("token", delta.alias("score"), z.alias("z"), share.alias("share")).where((F.col("z") >= LEAST_Z) & (F.col("score") > DRIFT)).select("token", "score", "share"), "telling")
    drop(counts)
    whole = (F.col("share") * 1e15).cast("decimal(38,0)")  # whole numbers: their sum does not depend on the order
    law = telling.groupBy(F.round(F.col("score") * 1000).cast("long").alias("s")).agg(F.sum(whole).alias("p"), F.sum(F.octet_length("token") + F.lit(ENTRY_BYTES)).alias("bytes")).orderBy("s").collect()
    if sum(r.bytes for r in law) > LEXICON_BYTES:
        scores = telling.select("token", "score")
    else:
        scores = {r.token: float(r.score) for r in telling.select("token", "score").collect()}
        drop(telling)
    if not law:
        return scores, 1.0
    s, p = np.array([r.s / 1000 for r in law]), np.array([float(r.p) / 1e15 for r in law])
    p = p * min(1.0, 0.5 / p.sum())
    mean = (p * s).sum() - DRIFT * (1 - p.sum())
    if mean >= 0:  # the law needs a negative drift
        return scores, 0.1
    low, high = 1e-6, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        if (p * np.exp(np.clip(mid * s, None, 700))).sum() + (1 - p.sum()) * np.exp(-mid * DRIFT) > 1:
            high = mid
        else:
            low = mid
    return scores, low


def calibrate(hist: np.ndarray) -> tuple[float, float, float]:
    """K of the extreme-value law (by the mean of the clean documents), and slope and offset of a logistic curve, from counts by bin and label."""
    x = (np.arange(BINS) + 0.5) * BIN
    x[0] = 0.0
    clean, toxic = hist[0].astype(float), hist[1].astype(float)
    mean = (x * clean).sum() / max(1.0, clean.sum())
    scale = float(np.clip(np.exp(mean - 0.5772), 1e-4, 1.0))
    a, b = 0.5, -3.0
    n = clean + toxic
    for _ in range(200):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        w = n * p * (1 - p)
        g = np.array([((n * p - toxic) * x).sum() + 1e-2 * a, (n * p - toxic).sum() + 1e-2 * b])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return scale, float(max(a, 0.0)), float(b)


def _own(batch: pa.RecordBatch, at: int) -> Iterable:
    """The column of telling tokens, if the batch has it."""
    return batch.column(at).to_pylist() if batch.num_columns > at else repeat(None)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from all labelled rows of docs. Without toxic or without clean ones the score is the same for every text."""
    rows = _labelled(docs, labels)
    scores, decay = lexicon(token_counts(rows))

    rows, sent = (rows.select("text", "toxic"), scores) if isinstance(scores, dict) else (with_own(rows.select("text", "toxic"), scores, "text"), None)

    def bins(batches):
        hist, scored = np.zeros((2, BINS), np.int64), Scorer(sent)
        for b in batches:
            for t, toxic, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _own(b, 2)):
                items, n = scored(t, own)
                hist[int(bool(toxic)), min(BINS - 1, int(statistic(maximal_segments(items), n, decay) / BIN))] += 1
        kind, at = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(hist[kind, at])], ["kind", "bin", "n"])

    hist = np.zeros((2, BINS))
    for r in rows.mapInArrow(bins, "kind long, bin long, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect():
        hist[r.kind, r.bin] = r.n
    return Model(scores, decay, *calibrate(hist))


def score(docs: DataFrame, model: Model, keep: list[str], threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The columns keep of docs, with score, predicted (1 from threshold on), and passages: first-last token of every significant segment (expected by chance under 0.05 times in such a text), comma-joined.

    A null or empty text has no segment and the score of one that has none; texts of any length are read whole; repeated rows each have a row; other columns are not looked at.
    """

    asked = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    joined = not isinstance(model.scores, dict)
    model, table = replace(model, scores=None if joined else model.scores), model.scores  # tables do not travel

    def run(batches):
        scored = Scorer(model.scores)
        for b in batches:
            values, passages = [], []
            for t, own in zip(b.column(len(keep)).to_pylist(), _own(b, len(keep) + 1)):
                items, n = scored(t or "", own)
                segments = maximal_segments(items)
                values.append(model.probability(statistic(segments, n, model.decay)))
                passages.append(",".join(f"{i}-{j}" for i, j, s in segments if model.scale * (n + 1) * np.exp(-min(700.0, model.decay * s)) < 0.05))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(values, pa.float64()), pa.array([int(v >= threshold) for v in values], pa.int32()), pa.array(passages, pa.string())], [*keep, "score", "predicted", "passages"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return (with_own(asked, table, "_text") if joined else asked).mapInArrow(run, f"{schema}, score double, predicted int, passages string")


def held_out_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted, passages of every row of docs, learned from labelled rows outside the held-out fold.

    The fold is crc32(doc_id as text) mod folds. Rows with a null doc_id are scored, not learned from, and not held out. Labels
    without a document, with a null or with a repeated doc_id are harmless; empty tables give the scores of an unlearned model. Of repeated rows each is scored and the
    first votes; texts of any length are read whole; columns other than doc_id and text are ignored.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    model = train(docs.where(fold != held), labels)
    return score(docs.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "text"), model, ["doc_id", "held_out"])
