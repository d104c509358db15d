"""Token ids of whole texts, word by word through the tokenizers library.

White space never lies inside a token of the tokenizers used here, so the ids of a text
are the ids of its words one after the other. Each worker asks the library for a word
and remembers the answer; the memory is bounded, words not met for long are dropped.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from sys import byteorder

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
END = 2
#: Words that a worker remembers, about 200 bytes each.
REMEMBERED = 800_000
#: Words of Latin letters, which are one word to the tokenizer and have one small form each (that of U+0130 has two letters).
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: ASCII marks that end a word; none of them is part of the special ids' names at its end, as > and | are.
_MARKS = b"!\"#$%&'()*+,-./:;<=?@[\\]^_`{}~"
#: The sign that stands for each byte in the vocabulary: itself where it is printable, else one from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SIGNS = {b: 0x100 + n for n, b in enumerate(b for b in range(0x100) if b not in _PRINTABLE)}


class _Words(dict):
    """The ids of words, found when first asked for; what was not asked for lately is dropped."""

    def __init__(self, find, most: int):
        super().__init__()
        self.find, self.most, self.older = find, most, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.find(word)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """``ids(text)``: the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer: str = TOKENIZER, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.exists(tokenizer):
            import public_tokenizers

            tokenizer = public_tokenizers.path(tokenizer)
        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.model = self.tokenizer.model
        self.known = _Words(self._find, max(remembered // 2, 1))

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.known.__getitem__, text.split()))

    def all_ids(self, texts: pa.Array) -> list[bytes]:
        """For a batch of texts; null is empty. Its words are told apart first, and each is looked up once."""
        words = pc.ascii_split_whitespace(texts)
        each = pc.list_flatten(words).dictionary_encode()
        found = [self.known[w] for w in each.dictionary.cast(pa.large_binary()).to_pylist()]
        ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)).tolist()
        at = each.indices.to_numpy()
        return [b"".join(map(found.__getitem__, at[a:b].tolist())) for a, b in zip([0, *ends], ends)]

    def _find(self, word: bytes) -> bytes:
        """The ids of one word; those of its small form and of the marks after it are remembered too."""
        if word.isalpha():
            low = word.lower()
            return _packed([t.id for t in self.model.tokenize(word.decode())]) if low == word else self.known[low]
        base = word.rstrip(_MARKS)
        if base and len(base) < len(word) and (base[-1:].isalpha() or base.decode()[-1].lower()[-1].isalpha()):
            return self.known[base] + self.known[word[len(base):]]  # a token never spans a letter and such a mark
        text = word.decode()
        if _LATIN.fullmatch(text):
            low = text.lower()
            if low == text:
                return _packed([t.id for t in self.model.tokenize(word.decode("latin-1").translate(_SIGNS))])
            return self.known[low.encode()]
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if byteorder != "little":
        packed.byteswap()
    return packed.tobytes()


@lru_cache(maxsize=2)
def encoder(tokenizer: str = TOKENIZER, remembered: int = REMEMBERED) -> Encoder:
    """One for each worker process."""
    return Encoder(tokenizer, remembered)
