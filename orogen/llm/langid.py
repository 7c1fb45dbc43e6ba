"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.llm.common import cut, drop, in_slices

DIMENSIONS = 1 << 15  # hashed n-grams of 1 to 3 characters
SAMPLE_ROWS = 4096  # labelled rows that the weights are learned from; document frequencies come from all labelled rows
EPOCHS = 3
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_PIECE = 1 << 20


@dataclass
class Model:
    """languages: sorted; weights: dimensions x languages, the inverse document frequency folded in."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def grams(text: str):
    """Hashed ids of all character 1- to 3-grams of the lower-cased text, in pieces of bounded size."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    for at in range(0, len(points), _PIECE):
        p = points[at : at + _PIECE + 2]
        own = min(_PIECE, len(points) - at)
        h = np.zeros(len(p), np.uint64)
        for n in range(3):
            h = (h[: len(p) - n] + p[n:]) * _MIX[n]
            yield (h[:own] >> np.uint64(49)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def term_frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram ids and their shares among the text's n-grams."""
    counts = np.zeros(DIMENSIONS, np.int64)
    for ids in grams(text):
        counts += np.bincount(ids, minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    return at, counts[at] / max(1, counts.sum())


def ftrl(rows, n_languages: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-4, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader over (ids, values, label) rows with elastic-net penalties: weights and bias."""
    z, n = np.zeros((DIMENSIONS + 1, n_languages)), np.zeros((DIMENSIONS + 1, n_languages))

    def weights(ids):
        own, seen = z[ids], n[ids]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + np.sqrt(seen)) / alpha + l2))

    for _ in range(epochs):
        for ids, values, label in rows:
            ids, values = np.append(ids, DIMENSIONS), np.append(values, 0.1)
            w = weights(ids)
            logits = values @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            g = values[:, None] * p[None, :]
            z[ids] += g - (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha * w
            n[ids] += g * g
    w = weights(np.arange(DIMENSIONS + 1))
    return w[:-1], 0.1 * w[-1]


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log likelihood on rows that the weights have not seen."""
    if not len(labels):
        return 1.0

    def loss(t):
        x = logits / t
        x = x - x.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(labels)), labels]))

    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", order: Column | None = None) -> Model | None:
    """Learn from the rows of labelled whose text has a letter and whose language is known; None if there are none.

    Document frequencies are summed over all those rows. Weights come from the SAMPLE_ROWS rows with the smallest order (a
    hash of the text unless given), a fifth of which is kept for the temperature.
    """
    order = F.xxhash64(F.col(text)) if order is None else order
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"), order.alias("h"))
    smallest = rows.select("h").orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    if smallest is None:
        return None
    schema = pa.schema([("h", pa.int64()), ("l", pa.string()), ("ids", pa.binary()), ("values", pa.binary()), ("n", pa.int64())])

    def run(batches):
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for b in in_slices(batches, 0):
            out: list[tuple] = []
            for t, lang, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if not has_letter(t):
                    continue
                n += 1
                if h <= smallest:
                    ids, values = term_frequencies(t)
                    out.append((h, lang, ids.astype("<u2").tobytes(), values.astype("<f4").tobytes(), 0))
                    seen[ids] += 1
                else:
                    here = np.zeros(DIMENSIONS, bool)
                    for ids in grams(t):
                        here[ids] = True
                    seen += here
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else pa.RecordBatch.from_pydict({k: [] for k in schema.names}, schema)
        if n:
            yield pa.RecordBatch.from_pydict({"h": [None], "l": [None], "ids": [None], "values": [seen.astype("<i8").tobytes()], "n": [n]}, schema)

    got = rows.mapInArrow(run, "h long, l string, ids binary, values binary, n long").where(F.col("n").isNotNull())
    # A partition's frequencies are one row of fixed size; Spark adds them up by dimension.
    got = cut(got, "langid")
    counts = got.where("n > 0")
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return None

    def spread(batches):
        for b in batches:
            sums = sum((np.frombuffer(v.as_py(), "<i8") for v in b.column(0)), np.zeros(DIMENSIONS, np.int64))
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["i", "c"])

    df = np.zeros(DIMENSIONS)
    for r in counts.select("values").mapInArrow(spread, "i long, c long").groupBy("i").agg(F.sum("c")).collect():
        df[r[0]] = r[1]
    idf = np.log((1 + total) / (1 + df)) + 1
    sample = sorted(got.where("n = 0").orderBy("h").limit(SAMPLE_ROWS).collect(), key=lambda r: (r.h, r.l, r.ids, r["values"]))
    drop(got)
    languages = sorted({r.l for r in sample})
    data = []
    for r in sample:
        ids = np.frombuffer(r["ids"], "<u2").astype(np.int64)
        v = np.frombuffer(r["values"], "<f4").astype(np.float64)
        data.append((ids, v * idf[ids], languages.index(r.l)))
    fit = [d for i, d in enumerate(data) if i % 5] or data
    held = data[::5]
    weights, bias = ftrl(fit, len(languages))
    logits = np.array([v @ weights[ids] + bias for ids, v, _ in held])
    return Model(languages, weights * idf[:, None], bias, best_temperature(logits, np.array([d[2] for d in held])))


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns keep of docs, with lang_pred and score (the calibrated probability of lang_pred), or under other names.

    A text that is null or has no letter is `und` with score 0, and so is every text where nothing could be learned.
    Of languages with equal probability the first by name wins.
    """
    table = None if model is None else np.ascontiguousarray(model.weights, np.float32)
    at = keep.index(text) if text in keep else len(keep)  # the text is sent once

    def run(batches):
        for b in in_slices(batches, at):
            pred, score = [], []
            for t in b.column(at).to_pylist():
                if table is None or not has_letter(t):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                total, n = np.zeros(table.shape[1]), 0
                for ids in grams(t):
                    total += np.bincount(ids, minlength=DIMENSIONS) @ table if len(ids) > 4 * DIMENSIONS else table[ids].sum(axis=0, dtype=np.float64)
                    n += len(ids)
                x = (total / max(1, n) + model.bias) / model.temperature
                p = np.exp(x - x.max())
                k = int(np.argmax(p))
                pred.append(model.languages[k])
                score.append(float(p[k] / p.sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, *names])

    kept = [F.col(f"`{c}`") for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    sent = docs.select(*kept) if text in keep else docs.select(*kept, F.col(text).cast("string").alias("_text"))
    return sent.mapInArrow(run, f"{schema}, `{names[0]}` string, `{names[1]}` double")


def held_out_identification(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs, learned from the rows outside the held-out fold.

    The fold is crc32(doc_id as text) mod folds; rows whose doc_id is null belong to no fold: they are predicted, not learned from,
    and held_out is false. Repeated rows each stay a row, and a language that only held-out rows have is never predicted.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    model = train(docs.where(fold != held), order=F.xxhash64(F.col("doc_id"), F.lit("sample")))
    named = docs.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "text")
    return predict(named, model, ["doc_id", "held_out"])
