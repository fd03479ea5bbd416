"""What tasks leave in a Python worker, and how much text they work on at a time."""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers

from plumbline.llm import bpe, minhash

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_a_task_of_another_operator_drops_the_codec():
    bpe.codec(PATH, public_tokenizers.PATTERN)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": ["one two three four five six", None]})
    (out,) = minhash._sketches(iter([batch]))
    assert out.column(1).to_pylist() == [2, 0]
    assert not bpe._CODECS


def test_caches_of_the_own_operator_stay():
    from plumbline.llm.common import lean

    codec = bpe.codec(PATH, public_tokenizers.PATTERN)
    with lean("bpe"):
        assert bpe.codec(PATH, public_tokenizers.PATTERN) is codec
    with lean():
        assert not bpe._CODECS


def test_digests_work_on_slices_and_lose_nothing(monkeypatch):
    codec = bpe.Codec(PATH, public_tokenizers.PATTERN)
    texts = [f"word{i} " * 3000 + f"end{i}" for i in range(100)] + [None, ""]
    slices, ids = [], codec.words.ids
    monkeypatch.setattr(codec.words, "ids", lambda part: (slices.append(sum(len(t) for t in part.to_pylist())), ids(part))[1])
    n, told, decoded = codec.digests(pa.array(texts))
    assert len(slices) > 1 and max(slices) < (1 << 20) + max(len(t or "") for t in texts) and sum(slices) == sum(len(t or "") for t in texts)
    each = [codec.digests(pa.array([t], pa.string())) for t in texts]
    assert (n, told, decoded) == tuple([x for e in each for x in e[k]] for k in range(3))
