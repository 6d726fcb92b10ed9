"""Exact tokenisation with a public tokenizer file, one library call per distinct word.

The tokenizer of ``word_bpe_49k.json`` lower-cases, splits at white space and merges inside words only, so the
ids of a text are the ids of its white-space separated words, joined.  A worker therefore keeps the ids of words
it has met in a bounded table and asks the library for new words only.  ASCII letters are lower-cased first (the
tokenizer does the same), which makes the table smaller.  A text that holds ``<|`` could spell a special token,
which the library looks for before it lower-cases: such a text goes to the library whole.
"""

from __future__ import annotations

import gc

from tokenizers import Tokenizer

TOKENIZER = "word_bpe_49k.json"
#: Words kept by a worker (about 200 bytes each); beyond it words are encoded each time they occur, same result.
MAX_WORDS = 700_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder(dict):
    """Word (lower-cased UTF-8 bytes) -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.marks = {m: self._ids(m.decode()) for m in (b".", b",")}

    def _ids(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.library.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        # a plain ASCII word and the one mark after it are two pre-tokens
        if len(word) > 1 and word[-1:] in self.marks and word[:-1].isalpha():
            ids = self[word[:-1]] + self.marks[word[-1:]]
        else:
            ids = self._ids(word.decode())
        if len(self) < MAX_WORDS:
            self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text (UTF-8) as little-endian unsigned 32-bit integers, without special tokens."""
        if b"<|" in text:
            return self._ids(text.decode())
        return b"".join(map(self.__getitem__, text.lower().split()))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file; kept while the Python worker lives."""
    if path not in _ENCODERS:
        gc.freeze()  # the table holds only bytes: nothing in it for the garbage collector
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
