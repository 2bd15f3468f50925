"""Encoding whole texts with a ``tokenizers`` file whose pieces never cross
white space: each distinct word is encoded once per worker and kept.

The library spends most of its time per call and per piece of text, so new
words are not encoded one by one: those of plain Latin letters, digits and
signs are cut as the file's own pre-tokenizer cuts them (runs of letters,
single digits, runs of signs), and the new parts go through the library
together, apart by spaces; the word-end marks in its answer part them again.
Parts are in normal form already, so this copy of the file's model goes without
its normalizer and splits at spaces only.
"""

from __future__ import annotations

import json
import os
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from corpusflow.llm.common import byte_list

_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"       # composed letters whose lower case is among them
_PLAIN = re.compile(f"[!-&(-~{_LATIN}]+")      # no apostrophe: the file knows contractions
_PARTS = re.compile(f"[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+")
_SIGNS = frozenset(string.punctuation.replace("'", "").encode())
_CACHE_WORDS = 1_000_000


class WordTokenizer:
    """``encode(texts)`` equals the library's ``encode`` of each whole text
    with ``add_special_tokens=False``: the file's pre-tokenizer splits at white
    space and drops it, so a text's ids are those of its words in order."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(data.decode())
        lean = json.loads(data)
        lean["normalizer"] = None
        lean["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [
            {"type": "WhitespaceSplit"},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.lean = Tokenizer.from_str(json.dumps(lean))
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.vocab <= 1 << 16 else np.dtype("<u4")
        self.word_end = np.zeros(self.vocab, bool)
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.word_end[i] = token.endswith("</w>")
        self.cache: dict[bytes, bytes] = {b"": b""}        # by word, as it stands in a text
        self.parts: dict[bytes, bytes] = {}     # by part of a plain word

    def _learn(self, words: list[bytes]) -> None:
        bare = [w for w in words if w.isalpha()]                       # ASCII letters only
        signed = [w for w in words if w[-1] in _SIGNS and w[:-1].isalpha()]
        known = set(bare).union(signed)
        cut: dict[bytes, list[bytes]] = {}
        rest = []
        for w in words:
            if w not in known:
                text = w.decode()
                if _PLAIN.fullmatch(text) and "<|" not in text:
                    low = text.lower()
                    cut[w] = [low.encode()] if low.isalpha() else [p.encode() for p in _PARTS.findall(low)]
                else:
                    rest.append(w)
        heads, stems = [w.lower() for w in bare], [w[:-1].lower() for w in signed]
        signs = [w[-1:] for w in signed]
        wanted = set(heads).union(stems, signs, *cut.values())
        new = list(wanted.difference(self.parts))
        if len(self.parts) + len(new) > _CACHE_WORDS:
            self.parts = {p: self.parts[p] for p in wanted.intersection(self.parts)}
        for at in range(0, len(new), 2_000):
            self._learn_parts(new[at:at + 2_000])
        part = self.parts.__getitem__
        self.cache.update(zip(bare, map(part, heads)))
        self.cache.update(zip(signed, map(bytes.__add__, map(part, stems), map(part, signs))))
        self.cache.update((w, b"".join(map(part, ps))) for w, ps in cut.items())
        for at in range(0, len(rest), 2_000):
            self.cache.update(zip(rest[at:at + 2_000], self._one_by_one([w.decode() for w in rest[at:at + 2_000]])))

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes()
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_parts(self, parts: list[bytes]) -> None:
        ids = np.array(self.lean.encode_batch_fast([b" ".join(parts).decode()], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) != len(parts):             # not one word end for each part
            self.parts.update(zip(parts, self._one_by_one([p.decode() for p in parts])))
            return
        flat = ids.astype(self.dtype).tobytes()
        size = self.dtype.itemsize
        self.parts.update((p, flat[a * size:b * size]) for p, a, b in zip(parts, [0, *ends[:-1].tolist()], ends.tolist()))

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words; new ones are learnt and kept."""
        known = self.cache.keys()
        new = list(set(words).difference(known))
        if len(known) + len(new) > _CACHE_WORDS:
            self.cache = {w: self.cache[w] for w in known & words}
            self.cache[b""] = b""               # a text that begins or ends with white space
        self._learn(new)
        got = list(map(self.cache.__getitem__, words))
        for w in new:
            if len(w) > 64:
                del self.cache[w]
        return got

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, one after the other, and how many each
        text has (none if null).  Arrow cuts and numbers the words; only distinct
        ones meet Python, and their ids are laid out by the numbers.  ASCII letters
        go in lower case first, so that there are fewer; not where combining marks
        stand, whose composition may depend on case."""
        # an array of its own: Arrow's lower-casing is wrong on a slice of a longer one
        texts = pc.fill_null(pa.concat_arrays([texts, texts.slice(0, 0)]).cast(pa.large_string()), "")
        if not any(b"\xcc" in t or b"\xcd" in t for t in byte_list(texts)):
            texts = pc.ascii_lower(texts)
        cut = pc.ascii_split_whitespace(texts)
        words = cut.flatten().dictionary_encode()
        ids = self._ids_of(byte_list(words.dictionary))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        number = words.indices.to_numpy(zero_copy_only=False)
        size = sizes[number]
        ends = np.cumsum(size)
        flat = np.frombuffer(b"".join(ids), self.dtype)
        out = flat[np.arange(int(size.sum())) + np.repeat(starts[number] - ends + size, size)]
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))]]
        return out, np.diff(bounds)

    def encode(self, texts: list) -> list[bytes]:
        """The ids of each text as little-endian integers of ``dtype``."""
        ids, sizes = self.encode_column(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        ends = np.cumsum(sizes)
        return [ids[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist())]


_tokenizers: dict[int, WordTokenizer] = {}


def tokenizer_of(data: bytes) -> WordTokenizer:
    """The tokenizer of a file's bytes, kept (with its words) from task to task."""
    key = xxhash.xxh3_64_intdigest(data)
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = WordTokenizer(data)
    return _tokenizers[key]
