import re
from pathlib import Path

import numpy as np
import pyarrow as pa

from addrloom.llm import substring_dedup
from addrloom.llm.common import caches, slices


def _held_mb() -> float:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_what_a_slice_took_is_given_back():
    batch, before = pa.RecordBatch.from_arrays([pa.array(range(2000))], ["x"]), _held_mb()
    for part in slices([batch]):
        made = [np.ones(1 << 14, np.int8) for _ in range(16_000)]  # 250 MB in pieces that malloc keeps when they are freed
        last = made[-1]
        del made
    assert len(part) == 500 and last.all() and _held_mb() - before < 100


def test_other_stages_caches_go(monkeypatch):
    kept = {"word": b"ids"}
    monkeypatch.setitem(caches, "packing", kept)
    list(substring_dedup._anchors(35)([pa.RecordBatch.from_arrays([pa.array(["a b"])], ["text"])]))
    assert not kept


def test_a_text_is_carried_once(spark):
    docs = spark.createDataFrame([(1, "a  text\nas it is", 16, "e"), (2, None, None, "e")], "doc_id long, text string, n_chars long, e string")
    carried = substring_dedup._removed(docs, 35, joined=False)
    assert carried.schema["row"].dataType.names == ["doc_id", "n_chars", "e"]
    assert sorted(map(tuple, substring_dedup.deduped_documents(docs).collect())) == sorted(map(tuple, docs.collect()))
