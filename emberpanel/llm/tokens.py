"""Exact token ids of a public ``tokenizers`` file, cached by word so that a corpus costs little more than its rare words.

White space always ends a token of this tokenizer, so a text's ids are those of its words, one after another. A word of
plain Latin text is lower-cased and cut by the tokenizer's own rule, and each part goes to the tokenizer's model once;
whatever else occurs (other scripts, special strings, unusual spaces) goes through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

from emberpanel.llm.common import hold

#: Parts of a lower-cased word, as the tokenizer file states them, over the characters that _PLAIN admits.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Characters for which Python's classes and the tokenizer's agree.
_PLAIN = re.compile(r"[!-~¡-±´-¸º»¿-įĲ-ɏ]+")
_ODD_SPACES = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


_LETTERS = _byte_letters()
_BYTES = str.maketrans({chr(b): c for b, c in _LETTERS.items()})


class Merges:
    """Byte-pair merging of many words at once: each step merges every word's leftmost pair of lowest rank."""

    NONE = np.int32(2**31 - 1)
    LONGEST = 40

    def __init__(self, spec: dict):
        vocab, end = spec["vocab"], spec["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["merges"]]
        self.inner = np.array([vocab[_LETTERS[b]] for b in range(256)], np.uint32)
        self.final = np.array([vocab[_LETTERS[b] + end] for b in range(256)], np.uint32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        self.tables, left, odd = [], np.arange(len(keys)), 0x9E3779B1
        while len(left):  # a pair whose slot is taken goes to the next table
            slots = self._slots(keys[left], np.uint32(odd))
            _, first = np.unique(slots, return_index=True)
            held, ranks = np.full(1 << 20, 2**32 - 1, np.uint32), np.full(1 << 20, self.NONE, np.int32)
            held[slots[first]], ranks[slots[first]] = keys[left[first]], left[first]
            self.tables.append((np.uint32(odd), held, ranks))
            left, odd = np.delete(left, first), (odd * 5 + 2) % 2**32 | 1

    @staticmethod
    def _slots(keys: np.ndarray, odd: np.uint32) -> np.ndarray:
        return (keys * odd) >> np.uint32(12)

    def _ranks(self, symbols: np.ndarray) -> np.ndarray:
        keys = symbols[:, :-1] << np.uint32(16) | symbols[:, 1:]
        out = None
        for odd, held, ranks in self.tables:
            slots = self._slots(keys, odd)
            found = np.where(held[slots] == keys, ranks[slots], self.NONE)
            out = found if out is None else np.minimum(out, found)
        return out

    def ids(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            letters = np.frombuffer(b"".join([words[r] for r in rows]), np.uint8).reshape(-1, n)
            symbols = self.inner[letters]
            symbols[:, -1] = self.final[letters[:, -1]]
            while len(rows):
                width = symbols.shape[1]
                if width > 1:
                    ranks = self._ranks(symbols)
                    at = ranks.argmin(1)
                    best = ranks[np.arange(len(rows)), at]
                    done = best == self.NONE
                else:
                    done = np.ones(len(rows), bool)
                ended = symbols[done].tobytes()
                for k, r in enumerate(rows[done]):
                    out[r] = ended[4 * width * k : 4 * width * (k + 1)]
                rows, symbols = rows[~done], symbols[~done]
                if len(rows):
                    at, here = at[~done], np.arange(len(rows))
                    symbols[here, at] = self.made[best[~done]]
                    stay = np.ones(symbols.shape, bool)
                    stay[here, at + 1] = False
                    symbols = symbols[stay].reshape(len(rows), width - 1)
        return out


class WordIds:
    """Token ids of texts as little-endian unsigned 32-bit bytes. ``limit`` bounds each cache's entries."""

    def __init__(self, tokenizer_json: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(tokenizer_json)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.model = self.whole.model
        self.merges = Merges(json.loads(tokenizer_json)["model"])
        self.limit = limit
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Put the ids of new words into the cache."""
        cut: dict[str, list[bytes]] = {}
        for word in words:
            if _PLAIN.fullmatch(word) and "<|" not in word and (word.isascii() or unicodedata.is_normalized("NFC", word)):
                cut[word] = [p.encode() for p in _PARTS.findall(word.lower())]
            else:
                self.words[word] = self._whole(word)
        parts = self.parts
        if len(parts) > self.limit:
            parts.clear()
        new = list({p for own in cut.values() for p in own}.difference(parts))
        short = [p for p in new if len(p) <= self.merges.LONGEST]
        parts.update(zip(short, self.merges.ids(short), strict=True))
        for p in new:
            if len(p) > self.merges.LONGEST:
                parts[p] = np.array([t.id for t in self.model.tokenize(p.decode("latin-1").translate(_BYTES))], "<u4").tobytes()
        for word, own in cut.items():
            self.words[word] = parts[own[0]] if len(own) == 1 else b"".join([parts[p] for p in own])

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if _ODD_SPACES.search(t) else t.split() for t in texts]
        words = self.words
        if len(words) > self.limit:
            words.clear()
        self._learn(set().union(*filter(None, split)).difference(words))
        get = words.__getitem__
        return [self._whole(t) if w is None else b"".join(map(get, w)) for t, w in zip(texts, split, strict=True)]


_LOADED: dict[int, WordIds] = {}


def word_ids(tokenizer_json: str) -> WordIds:
    """One instance a Python worker, kept across tasks."""
    hold("tokens", _LOADED.clear)
    key = hash(tokenizer_json)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordIds(tokenizer_json)
    return _LOADED[key]
