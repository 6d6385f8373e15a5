"""Per-text WordPiece in plain Python: a small helper behind the SQL UDF
surface (U1-U3) and the brute-force reference in tests.  Table-scale
tokenisation uses the relational plan in ``operators.wordpiece``."""

from __future__ import annotations

import re

from ..constants import (CLS_FALLBACK_ID, CLS_TOKEN, CONTINUATION_PREFIX,
                         MAX_CHUNKS, MAX_SEQ, SEP_FALLBACK_ID, SEP_TOKEN,
                         UNK_FALLBACK_ID, UNK_TOKEN)

_ISOLATE = re.compile("([\u4e00-\u9fff\u3400-\u4dbf\U00020000-\U0002a6df!-/:-@\\[-`{-~])")
_SPACES = re.compile("[ \t\n\r\u3000]+")


class PyWordPiece:
    def __init__(self, vocab: dict[str, int]):
        self.vocab = vocab
        self.max_len = max((len(t) for t in vocab), default=1)
        self.unk = vocab.get(UNK_TOKEN, UNK_FALLBACK_ID)
        self.cls = vocab.get(CLS_TOKEN, CLS_FALLBACK_ID)
        self.sep = vocab.get(SEP_TOKEN, SEP_FALLBACK_ID)
        self._cache: dict[str, list[str]] = {}

    @staticmethod
    def basic(text: str, max_chunks: int | None = MAX_CHUNKS) -> list[str]:
        text = text.split("\0", 1)[0]
        chunks = [c for c in _SPACES.split(_ISOLATE.sub(r" \1 ", text)) if c]
        return chunks if max_chunks is None else chunks[:max_chunks]

    def word(self, w: str) -> list[str]:
        hit = self._cache.get(w)
        if hit is not None:
            return hit
        pieces, start = [], 0
        while start < len(w):
            end = min(len(w), start + self.max_len)
            found = None
            while end > start:
                cand = (CONTINUATION_PREFIX if start else "") + w[start:end]
                if cand in self.vocab:
                    found = cand
                    break
                end -= 1
            if found is None:
                pieces = [UNK_TOKEN]
                break
            pieces.append(found)
            start = end
        if len(self._cache) < 200_000:
            self._cache[w] = pieces
        return pieces

    def tokens(self, text: str) -> list[str]:
        return [p for c in self.basic(text) for p in self.word(c)]

    def encode(self, text: str, max_seq: int = MAX_SEQ, truncate: bool = True) -> list[int] | None:
        """ids with CLS/SEP; None when over length and ``truncate`` is off."""
        if max_seq < 2:
            raise ValueError("max_seq must be at least 2")
        body = self.tokens(text)
        if len(body) > max_seq - 2:
            if not truncate:
                return None
            body = body[:max_seq - 2]
        return [self.cls] + [self.vocab.get(t, self.unk) for t in body] + [self.sep]
