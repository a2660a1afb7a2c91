import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkwell.llm import _text, entry, packing
from tests.llm.test_operators import rows

LITERAL = "<|endoftext|>"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([LITERAL, "<|endoftext", "|>", ">", " ", "  ", "\n", "a", "'s", "'", "s", "1", "\u00e9", "\u6f22"]), max_size=9).map("".join), min_size=1, max_size=6))
def test_added_tokens_in_texts_are_the_library_s(texts):
    fresh = Tokenizer.from_file(entry.tokenizer_path())
    ids, at = packing.encoder(entry.tokenizer_path()).encode(*_text.buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == fresh.encode(t, add_special_tokens=False).ids


def test_packing_of_a_text_with_an_added_token(spark):
    text = f"a {LITERAL} b"
    ids = [*Tokenizer.from_file(entry.tokenizer_path()).encode(text, add_special_tokens=False).ids, 0]
    assert ids == [64, 220, 50256, 275, 0]
    found = rows(packing.pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), entry.tokenizer_path()))
    assert [(r["length"], r["ids_crc32"]) for r in found] == [(5, zlib.crc32(np.array(ids, dtype="<u4").tobytes()))]
