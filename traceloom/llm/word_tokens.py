"""Token ids of whole texts, each word encoded once.

The tokenizer drops white space and never joins what it separates, so the pieces between ASCII white space
can be encoded alone and remembered. A worker keeps at most MAX_WORDS words; beyond that it forgets the less frequent half.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import chain

import numpy as np

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
MAX_WORDS = 300_000
_END = b"\xff"  # in no text: stands for the id that ends a document
_BETWEEN = b" \xff "
# Kinds of bytes: 0 any other, 1 small letters, 2 marks, 3 digits, 4 the apostrophe; and between which a piece always ends.
_KIND = np.zeros(256, np.uint8)
_KIND[33:48] = _KIND[58:65] = _KIND[91:97] = _KIND[123:127] = 2
_KIND[97:123], _KIND[48:58], _KIND[39] = 1, 3, 4
_ENDS = np.zeros((5, 5), bool)
_ENDS[1, 2:], _ENDS[2, [1, 3]], _ENDS[3, 1:], _ENDS[4, 3] = True, True, True, True
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
# The tokenizer's characters for bytes: visible Latin-1 ones stand for themselves, the others for 256 and on, in order.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(_OTHERS)}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder(dict):
    """From a word to its slot; lens and ids have each slot's ids, one slot after the other."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self[_END] = 0
        self.pending: list[bytes] = []
        self.ids, self.lens, self.hits = np.array([END_ID], np.uint32), np.array([1], np.int64), np.array([1], np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = slot = len(self)
        self.pending.append(word)
        return slot

    def forget(self) -> None:
        """Keeps the more frequent half of the slots."""
        words, keep = list(self), np.ones(len(self), bool)
        keep[1:] = self.hits[1:] > max(1, int(np.partition(self.hits, -(MAX_WORDS // 2))[-(MAX_WORDS // 2)]))
        self.ids = self.ids[np.repeat(keep, self.lens)]
        self.lens, self.hits = self.lens[keep], self.hits[keep] // 2
        self.clear()
        self.update((words[i], k) for k, i in enumerate(np.flatnonzero(keep)))

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        """Each word's ids. In words of small letters alone, ASCII or Latin-1, the tokenizer changes and splits nothing, so its model is asked directly."""
        plain = [_PLAIN(w) is not None for w in words]
        others = iter(self.tokenizer.encode_batch_fast([w.decode() for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False))
        ask = self.tokenizer.model.tokenize
        return [[t.id for t in ask(w.decode("latin-1").translate(_BYTE_CHARS))] if p else next(others).ids for w, p in zip(words, plain, strict=True)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each ended by END_ID; where each text starts, and the end)."""
        if len(self) > MAX_WORDS:
            self.forget()
        words = _words(texts)
        slots = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.pending:
            new = self._encode(self.pending)
            self.lens = np.concatenate([self.lens, np.fromiter(map(len, new), np.int64, len(new))])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(new), np.uint32)])
            self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
            self.pending = []
        self.hits += np.bincount(slots, minlength=len(self.hits))
        lens, firsts = self.lens[slots], (np.cumsum(self.lens) - self.lens)[slots]
        upto = np.cumsum(lens)
        ids = self.ids[np.repeat(firsts - (upto - lens), lens) + np.arange(upto[-1] if len(upto) else 0)]
        return ids, np.concatenate([[0], upto[slots == 0]])


def _words(texts: list[str]) -> list[bytes]:
    """Pieces of the texts that give their ids one after the other, and _END after each text.

    In a text without the marks of special tokens case does not count, and the tokenizer's own pieces end where
    ASCII letters, marks and digits meet, after every digit, and before an apostrophe that follows a letter; so
    there are far fewer different pieces than words.
    """
    raw = [t.encode() for t in texts]
    special = [b"<|" in r for r in raw]
    if any(special):
        raw = [r if s else _parted(r.lower()) for r, s in zip(raw, special, strict=True)]
        return _BETWEEN.join([*raw, b""]).split()
    return _parted(_BETWEEN.join([*raw, b""]).lower()).split()


def _parted(text: bytes) -> bytes:
    b = np.frombuffer(text, np.uint8)
    kind = _KIND[b]
    return np.insert(b, np.flatnonzero(_ENDS.ravel()[kind[:-1] * np.uint8(5) + kind[1:]]) + 1, 32).tobytes()


@cache
def encoder(path: str) -> WordEncoder:
    """One a worker process."""
    return WordEncoder(path)


def slices(texts: list[str], chars: int = 2_000_000):
    """Ranges of texts of about so many characters; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
