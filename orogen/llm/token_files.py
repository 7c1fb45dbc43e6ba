"""Token ids in flat binary files with 64-bit document offsets, written and read back by Spark tasks."""

from __future__ import annotations

import os
import zlib
from itertools import accumulate
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.common import cut, new_folder
from orogen.llm.tokens import Encoder, in_groups, tokenizer, words

KINDS = {2: "<u2", 4: "<u4"}  # by bytes an id
DOCS = 20_000  # documents of a range that is read at once


def _create(path: str):
    """A binary output stream at a URL: a plain file where the scheme is file, else Arrow's file system of the scheme."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        os.makedirs(os.path.dirname(at.path), exist_ok=True)
        return open(at.path, "wb")
    from pyarrow.fs import FileSystem

    fs, inner = FileSystem.from_uri(path)
    fs.create_dir(os.path.dirname(inner), recursive=True)
    return fs.open_output_stream(inner)


class _Numbers:
    """The numbers of a file: memory-mapped where it is a plain file, else only the asked ranges are read."""

    def __init__(self, path: str, kind: str):
        at, self.kind = urlparse(path), np.dtype(kind)
        if at.scheme in ("", "file"):
            self.mapped = np.memmap(at.path, kind, "r") if os.path.getsize(at.path) else np.zeros(0, kind)
        else:
            from pyarrow.fs import FileSystem

            fs, inner = FileSystem.from_uri(path)
            self.mapped, self.file = None, fs.open_input_file(inner)

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[at]
        return np.frombuffer(self.file.read_at((at.stop - at.start) * self.kind.itemsize, at.start * self.kind.itemsize), self.kind)


def width_of(tokenizer_path: str, end_id: int | None = None) -> int:
    """Bytes of an id: 2 where all ids of the vocabulary (and the end) are under 65,536, else 4."""
    return 2 if max(tokenizer(tokenizer_path).get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 > (end_id or 0) else 4


def write(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, width: int | None = None, folder: str | None = None) -> DataFrame:
    """Encode docs.text in ascending doc_id order into files below folder; returns the manifest.

    One file set a partition: NAME.ids (unsigned little-endian integers of width bytes), NAME.offsets (unsigned 64-bit:
    start of every document and the end, within the file), NAME.docs (signed 64-bit doc_ids) and NAME.nulls (a byte a
    document, 1 where doc_id is null). width: as the vocabulary needs, unless given. Manifest rows: part, path, n_docs, n_tokens, width, base (ids in all files before it).
    Names hold the task attempt, and only the manifest says which files count, so retried tasks do no harm.
    Null texts are empty; null doc_ids sort first; documents with the same doc_id follow one another by their text's hash.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    width = width or width_of(tokenizer_path, end_id)
    kind = KINDS[width]

    def run(batches):
        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        encoder = Encoder(tokenizer_path, words)
        offsets, ids, nulls, at = [0], [], [], 0
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        with _create(f"{name}.ids") as f:
            for b in batches:
                texts = [t or "" for t in b.column(1).to_pylist()]
                for some in in_groups(texts):
                    for coded in encoder.batch(some):
                        coded = np.frombuffer(coded + tail, "<u4")
                        f.write(coded.astype(kind).tobytes())
                        at += len(coded)
                        offsets.append(at)
                own = b.column(0)
                ids.append(own.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                nulls.append(own.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        for ending, data in (("offsets", np.array(offsets, "<u8")), ("docs", np.concatenate([*ids, np.zeros(0, "<i8")])), ("nulls", np.concatenate([*nulls, np.zeros(0, np.uint8)]))):
            with _create(f"{name}.{ending}") as f:
                f.write(data.tobytes())
        yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "path": [name], "n_docs": [len(offsets) - 1], "n_tokens": [at], "width": [width]}, pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int64())]))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("at")).repartitionByRange(parts, "doc_id", "at").sortWithinPartitions("doc_id", "at")
    made = cut(placed.select("doc_id", "text").mapInArrow(run, "part long, path string, n_docs long, n_tokens long, width long"), "manifest")
    rows = sorted(r for r in made.collect() if r.n_docs)  # a row a partition
    bases = accumulate((r.n_tokens for r in rows), initial=0)
    return spark.createDataFrame([(*r, base) for r, base in zip(rows, bases)], "part long, path string, n_docs long, n_tokens long, width long, base long")


def read(manifest: DataFrame) -> DataFrame:
    """Documents of token files: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers). A task reads ranges of DOCS documents, each document's ids by its offsets."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches):
        for b in batches:
            for path, base, width, first, last in zip(*(c.to_pylist() for c in b.columns)):
                ids, offsets = _Numbers(f"{path}.ids", KINDS[width]), _Numbers(f"{path}.offsets", "<u8")[first : last + 1].astype(np.int64)
                docs, nulls = _Numbers(f"{path}.docs", "<i8")[first:last], _Numbers(f"{path}.nulls", "u1")[first:last]
                crc = np.fromiter((zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())), np.int64, last - first)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(docs), pa.int64(), mask=np.array(nulls, bool)), pa.array(offsets[:-1] + base), pa.array(np.diff(offsets)), pa.array(crc)], names)

    ranges = manifest.select("path", "base", "width", "n_docs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(DOCS).cast("long"))).alias("first")).select("path", "base", "width", "first", F.least("n_docs", F.col("first") + DOCS).alias("last"))
    n = max(1, manifest.agg(F.sum(F.ceil(F.col("n_docs") / DOCS))).first()[0] or 0)
    return ranges.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1) -> DataFrame:
    """write() and read(): a row per document, of whatever text. An empty table gives no row."""
    return read(write(docs, tokenizer_path, end_id))
