"""A worker remembers the pre-tokens it has merged; ids of many texts are decoded together."""

import public_tokenizers as p
import pyarrow as pa

from lakefind.llm import bpe


def test_merged_once():
    b = bpe.Bpe({bytes([i]): i for i in range(256)}, p.PATTERN)
    calls, merge = [], b.merge
    b.merge = lambda piece: calls.append(1) or merge(piece)
    text = " ".join(f"{i:06d}" for i in range(180_000))
    first = b.encode(text)
    n = len(calls)
    assert b.encode(text) == first and len(calls) == n


def test_decoded_together():
    b = bpe.Bpe({bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 300}, p.PATTERN)
    for texts in ([], [""], ["", ""], ["abc", "", "é abab\n", ""]):
        out = b.decoded([b.encode(t) for t in texts])
        assert out.type == pa.binary() and out.to_pylist() == [t.encode() for t in texts]
