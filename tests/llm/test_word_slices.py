"""The word tokenizer on slices of a longer Arrow column."""

import numpy as np
import pyarrow as pa

from corpusflow.llm.common import read_bytes, row_slices, tokenizer_path
from corpusflow.llm.word_tokens import WordTokenizer


def test_slices_of_a_column_give_the_ids_of_their_texts():
    texts = ["Ça VA, the Cat's 2nd été!! ", "", " x Y z ", "ÀÉÎ ünï ABC.", "éT̈ <|endoftext|> ok.", "a" * 90] * 50
    tok = WordTokenizer(read_bytes(tokenizer_path("word_bpe_49k.json")))
    column = pa.array(texts, pa.string())
    want = [e.ids for e in tok.tok.encode_batch_fast(texts, add_special_tokens=False)]
    for size in (60, 1000, 1 << 20):
        got = []
        for a, b in row_slices(column, size):
            ids, sizes = tok.encode_column(column.slice(a, b - a))
            got += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == want


def test_null_texts_have_no_ids():
    tok = WordTokenizer(read_bytes(tokenizer_path("word_bpe_49k.json")))
    ids, sizes = tok.encode_column(pa.array([None, "cat", None], pa.string()))
    assert sizes.tolist() == [0, len(ids), 0] and len(ids)
    ids, sizes = tok.encode_column(pa.array([], pa.string()))
    assert len(ids) == len(sizes) == 0
