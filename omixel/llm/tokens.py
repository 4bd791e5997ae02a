"""Token ids of a lower-casing word BPE tokenizer, with a cache of words.

The tokenizer splits a text into words before it merges bytes, and the last token of a word is marked as such; so
a word has the same ids wherever it stands.  Texts of plain Latin-1 characters are split here, each new word is
encoded once, and known words come from the cache.  Any other text goes through the tokenizer as a whole.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xff]*")
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\t\n\r {_LETTERS}{_DIGITS}]+").findall
_CACHED_WORDS = 400_000
_LEARNT_AT_ONCE = 5000


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), _LEARNT_AT_ONCE):
            some = words[i : i + _LEARNT_AT_ONCE]
            lines = [" ".join(some[j : j + 50]) for j in range(0, len(some), 50)]
            ids = np.array([x for e in self.whole.encode_batch_fast(lines, add_special_tokens=False) for x in e.ids], "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                flat, edges = ids.tobytes(), [0, *(4 * stops).tolist()]
                self.known.update(zip(some, [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], strict=True))
            else:
                for w in some:
                    self.known[w] = self._encode(w)

    def _encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        """Ids of each text, then the id `end`; a null text counts as empty."""
        words = [_SPLIT(t.lower()) if t and _PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        here = set().union(*(w for w in words if w))
        if len(self.known) > _CACHED_WORDS:  # keep what this batch needs, the common words among it
            self.known = {w: self.known[w] for w in here.intersection(self.known)}
        new = here.difference(self.known)  # looks up what is here, not all that is known
        if new:
            self._learn(list(new))
        get, last = self.known.__getitem__, np.uint32(end).tobytes()
        found = (b"".join(map(get, w)) if w is not None else self._encode(t) if t else b"" for t, w in zip(texts, words, strict=True))
        return [np.frombuffer(x + last, "<u4") for x in found]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
