"""Ids of pre-tokens that a worker keeps: within any room they are the library's, and blocks of them stay as they were."""

import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from inkwell.llm import _text, entry, mixcoder, packing


def encoded(own, texts):
    ids, at = own.encode(*_text.buffers(pa.array(texts)))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def test_what_comes_again_is_spelled_once(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 40)
    own, spelled = packing.Encoder(entry.tokenizer_path()), []
    fresh, real = Tokenizer.from_file(entry.tokenizer_path()), own.tokenizer.model.tokenize
    own.tokenizer = SimpleNamespace(model=SimpleNamespace(tokenize=lambda x: spelled.append(x) or real(x)))
    for i in range(30):
        text = f"the usual words{''.join(f' rare{chr(97 + i % 26)}{chr(97 + k)}{i // 26 * chr(122)}' for k in range(6))}"
        assert encoded(own, [text]) == [fresh.encode(text, add_special_tokens=False).ids]
    assert spelled.count("Ġusual") == spelled.count("Ġwords") == 1
    assert len(spelled) == len(set(spelled)) == 3 + 30 * 6
    assert own.kept <= 40


@pytest.mark.parametrize("kept", [1, 7, 50, 400])
def test_any_room_gives_the_library_s_ids(monkeypatch, kept):
    monkeypatch.setattr(packing, "KEPT", kept)
    own, fresh, r = packing.Encoder(entry.tokenizer_path()), Tokenizer.from_file(entry.tokenizer_path()), np.random.default_rng(kept)
    words = [*(f"w{chr(97 + i % 26)}{i}" for i in range(500)), "<|endoftext|>", "don't", "  ", "\n", "é漢", "'s", "ab" * 300]
    for _ in range(30):
        texts = [" ".join(words[i] for i in r.permutation(np.minimum(r.zipf(1.2, r.integers(0, 300)), len(words)) - 1)) for _ in range(3)]
        assert encoded(own, texts) == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("n", "vocabulary", "size", "checksum"), [(1, 1, 32, 184365254), (3000, 300, 3024, 1569414694), (70001, 50257, 136964, 1751671393), (1100003, 50257, 2065988, 732988285), (40000, 262144, 88980, 1003664179)])
def test_blocks_keep_their_format(n, vocabulary, size, checksum):
    at = np.arange(n, dtype=np.int64)
    ids = (at * 7919 // (1 + at % 7) + at // 1000) % (1 + at % 13 * (vocabulary // 13))
    block = mixcoder.encode(ids, vocabulary)
    assert (len(block), zlib.crc32(block[:-4])) == (size, checksum)
    assert (mixcoder.decode(block) == ids).all()
