import random

import numpy as np
import pyarrow as pa
import pytest
from brute import words

from flowscope.llm import tokens as T


@pytest.mark.parametrize("slice_bytes", [10, 50, 2_000_000])
def test_words_and_windows(monkeypatch, slice_bytes):
    monkeypatch.setattr(T, "SLICE_BYTES", slice_bytes)
    rng = random.Random(slice_bytes)
    for _ in range(200):
        texts = [rng.choice([None, "", "".join(rng.choice("aébB \n\t中") for _ in range(rng.randint(0, 30)))]) for _ in range(rng.randint(0, 8))]
        found, want = T.words(pa.array(texts, pa.string())), [words(t) for t in texts]
        assert found.counts.tolist() == [len(w) for w in want]
        flat = [x for w in want for x in w]
        assert [found.data[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends, strict=True)] == flat
        for hashes, items in ((found.hashes, flat), (found.windows(3)[1], [tuple(w[i : i + 3]) for w in want for i in range(len(w) - 2)])):
            assert len(hashes) == len(items)
            pairs = set(zip(hashes.tolist(), items, strict=True))
            assert len(pairs) == len({h for h, _ in pairs}) == len({x for _, x in pairs})


def test_packing():
    for kind in (np.uint32, np.uint64):
        for n in (0, 1, 1000):
            values = np.sort(np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64)).astype(kind)
            assert (T.unpacked(T.packed(values), kind) == values).all()


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 5, None, "b" * 20, "", "c"])], names=["text"])
    assert [b.num_rows for b in T.sliced(batch, "text", 6)] == [2, 1, 2]
