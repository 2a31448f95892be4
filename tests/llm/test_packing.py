import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import documents
from tokenizers import Tokenizer

from wayfold.llm.packing import crc_join, pack

FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_checksums_join():
    a, b = b"some bytes", b"and more of them"
    assert crc_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@pytest.mark.parametrize("capacity", [64, 1024])
def test_every_id_once(spark, capacity):
    texts = {1: None, 2: "", 3: "a b  c\n\n d", 4: "<|endoftext|> ½   x", 5: "long words " * 4000, None: "no id"}
    texts |= {i: "the thing is " * (i % 37) + "end" for i in range(10, 200)}
    rows = [*texts.items(), (3, "a b  c\n\n d")]
    tok = Tokenizer.from_file(FILE)
    pieces = [r.asDict() for r in pack(documents(spark, rows), FILE, capacity=capacity, grain=8).collect()]
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    for d, text in texts.items():
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        times = 2 if d == 3 else 1
        assert sum(p["length"] for p in by_doc[d]) == times * len(ids)
        for p in by_doc[d]:
            assert p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= capacity
    assert sum(p["length"] for p in pieces) > 0.95 * (capacity * (len(sequences) - 1))


def test_empty(spark):
    assert pack(documents(spark, []), FILE).collect() == []
