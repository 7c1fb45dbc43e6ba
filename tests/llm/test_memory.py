import tracemalloc
from types import SimpleNamespace

import pyarrow as pa

from orogen.llm import pii
from orogen.llm.common import in_slices


def test_a_worker_holds_few_texts_at_once():
    """Masking a batch of 16 MB of different texts: what Python holds at most, and every text masked as alone."""
    texts = [f"mail a{i}@here.org " + f"{i} " * (8000 // len(f"{i} ")) for i in range(2000)] + [None, "", "ask Mr b@c.org"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    kept = {}
    docs = SimpleNamespace(columns=["doc_id", "text"], schema=None, mapInArrow=lambda run, schema: kept.update(run=run))
    model = pii.train([], rounds=1)
    pii.mask(docs, model)
    tracemalloc.start()
    out = []
    for b in kept["run"](iter([batch])):
        out.append(b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = pa.Table.from_batches(out)
    assert got["doc_id"].to_pylist() == list(range(len(texts)))
    assert got["text"].to_pylist() == [None if t is None else t.replace(f"a{i}@here.org", "<EMAIL>").replace("b@c.org", "<EMAIL>") for i, t in enumerate(texts)]
    assert peak < 40e6, peak


def test_slices_hold_every_row_once():
    for texts in ([], [None], ["", None, ""], ["a" * 10, "b", None, "c" * 3, "d" * 50, "e"], ["é" * 6] * 5):
        for kind in (pa.string(), pa.large_string()):
            batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, kind)], ["i", "t"])
            parts = list(in_slices(iter([batch, batch]), 1, 12))
            assert [x for p in parts for x in p.column(1).to_pylist()] == texts * 2 and [x for p in parts for x in p.column(0).to_pylist()] == list(range(len(texts))) * 2
            assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 12 for p in parts)
