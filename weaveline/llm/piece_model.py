"""Vocabulary view of a SentencePiece BPE model, and the chunking that both token operators share."""

from __future__ import annotations

import functools
import re

import sentencepiece

SPACE = "▁"
#: A chunk is a run of space marks and the marks-free run behind it; no piece crosses from the
#: second into the first, which Vocabulary checks, so chunks are tokenised one by one.
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Vocabulary:
    """Pieces that merges may form, with the rank (lower merges first) that the model's scores give."""

    def __init__(self, blob: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.text: list[str | None] = []
        self.raw: list[int] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.text.append(None)
            self.raw.append(-1)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw[i] = int(piece[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece spans two words; chunks would not be independent")
                self.rank[piece] = -sp.get_score(i)
                self.id[piece] = i
                self.text[i] = piece
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        self.longest = max(map(len, self.rank))
        #: Neighbouring characters that some piece holds; merges never cross any others.
        self.bigrams = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}

    def parts(self, text: str) -> list[str]:
        """Text cut where no piece can cross; the parts are tokenised one by one."""
        bigrams, out, start = self.bigrams, [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in bigrams:
                out.append(text[start:i])
                start = i
        out.append(text[start:])
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(blob: bytes) -> Vocabulary:
    """One per worker process."""
    return Vocabulary(blob)


def chunks(text: str) -> list[str]:
    """Text as the model normalises it (identity, one space mark in front), cut where no piece can cross."""
    if not text:
        return []
    marked = SPACE + text.replace(" ", SPACE)
    return CHUNK.findall(marked)


class Memo(dict):
    """Memo of a function of a short chunk, bounded in bytes: two generations, the older dropped when the younger is full.

    An entry is taken to cost `each` bytes beside those of its key and a value of bytes.
    """

    def __init__(self, compute, most_bytes: int = 32 << 20, longest: int = 64, each: int = 100):
        super().__init__()
        self.compute, self.half, self.longest, self.each, self.held, self.old = compute, most_bytes // 2, longest, each, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            self.put(key, value)
        return value

    def find(self, key):
        """The value if it is held, else None."""
        value = self.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(key) <= self.longest:
            self.put(key, value)

    def put(self, key, value) -> None:
        if self.held >= self.half:
            self.old = None
            self.old = dict(self)
            self.clear()
            self.held = 0
        self.held += self.each + len(key) + (len(value) if isinstance(value, bytes) else 0)
        self[key] = value
