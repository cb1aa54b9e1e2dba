"""SentencePiece encoding and decoding by a streaming Viterbi pass.

One path over prefixes: at each position the lattice holds the pieces that may end there, each
with a backpointer to where it starts. A transition is allowed (score 0, else minus infinity)
when the piece and the last piece of the path it extends stay apart under the model's own
merges, so that the one surviving path to the end is the model's encoding. Only a window of
the longest piece's length is kept; as soon as the paths to all positions in it run through
one common boundary, the identifiers before that boundary are committed and forgotten.

Whether two pieces stay apart is decided by undoing their merges from the last to the first, and
memoised in a bounded table. Texts are cut where no piece can cross, and the parts that no memo
holds are passed over in order: equal prefixes have equal lattice columns, so that each part goes
on where it differs from the one before. Characters outside the vocabulary become byte pieces.

Defined cases: null and empty texts have no identifiers and decode to the empty text; texts of
any length need memory for their identifiers only; repeated rows are encoded one by one; an empty
table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections import Counter
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_model import SPACE, Memo, Vocabulary, vocabulary
from .shared import bound_batches, by_bytes, kept_in_worker


def merge_pieces(text: str, vocab: Vocabulary, least: int = 1) -> list[str]:
    """The model's merges on a short text, as a list of pieces (used for pieces and pairs of pieces only), down to least pieces."""
    parts, get = list(text), vocab.rank.get
    ranks = [get(a + b, inf) for a, b in zip(parts, parts[1:])]
    while len(parts) > least and ranks and (first := min(ranks)) < inf:
        i = ranks.index(first)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del ranks[i]
        if i:
            ranks[i - 1] = get(parts[i - 1] + parts[i], inf)
        if i < len(ranks):
            ranks[i] = get(parts[i] + parts[i + 1], inf)
    return parts


class Encoder:
    """Encodes and decodes whole texts under one vocabulary."""

    #: So many pairs are memoised.
    PAIRS = 1 << 18
    #: Characters of a text that are cut at a time, or one longer part.
    PIECE = 1 << 20

    def __init__(self, vocab: Vocabulary, memo_bytes: int = 128 << 20):
        self.vocab = vocab
        #: Pieces that their own characters merge to, by rising rank, single characters first.
        self.pieces = [p for p in vocab.rank if len(p) == 1]
        ranks = Counter(r for p, r in vocab.rank.items() if len(p) > 1)
        halves: dict[str, list[str]] = {}
        for p in sorted((p for p in vocab.rank if len(p) > 1), key=lambda p: (vocab.rank[p], len(p))):
            if len(two := merge_pieces(p, vocab, 2)) == 2:
                halves[p] = two
                self.pieces.append(p)
        self.number = number = {p: i for i, p in enumerate(self.pieces)}
        #: The two pieces that a piece's last merge joins; a single character is its own halves.
        self.left = [number[halves[p][0]] if p in halves else i for i, p in enumerate(self.pieces)]
        self.right = [number[halves[p][1]] if p in halves else i for i, p in enumerate(self.pieces)]
        self.joined = {(self.left[i], self.right[i]): i for i, p in enumerate(self.pieces) if p in halves}
        #: Whether merges of equal rank made a piece; ranks then don't tell in which order.
        self.tied: list[bool] = []
        for i, p in enumerate(self.pieces):
            self.tied.append(p in halves and (ranks[vocab.rank[p]] > 1 or self.tied[self.left[i]] or self.tied[self.right[i]]))
        self.pairs: dict[int, bool] = {}
        #: The longest piece that ends with three characters.
        self.reach: dict[str, int] = {}
        for p in self.pieces:
            if len(p) > 2:
                self.reach[p[-3:]] = max(len(p), self.reach.get(p[-3:], 0))
        #: Kinds of characters by code point (0: in no piece of two or more), and which kinds neighbour in a piece.
        self.kind = np.zeros(0x110000, np.int32)
        chars = sorted({c for two in vocab.bigrams for c in two})
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.meets = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in vocab.bigrams:
            self.meets[self.kind[ord(a)], self.kind[ord(b)]] = True
        self.memo = Memo(None, memo_bytes, each=140)
        self.bytes_of = [b"" if t is None and r < 0 else bytes([r]) if r >= 0 else t.encode() for t, r in zip(vocab.text, vocab.raw)]
        self.table = pa.array(self.bytes_of, pa.binary())

    def apart(self, a: int, b: int) -> bool:
        """Whether merges keep pieces a and b apart: undoes both pieces' merges, last one first, and looks what could have joined across."""
        left, right, joined = self.left, self.right, self.joined.get
        if self.tied[a] or self.tied[b]:
            return merge_pieces(self.pieces[a] + self.pieces[b], self.vocab) == [self.pieces[a], self.pieces[b]]
        before = len(left)  # a merge across that ranks before this one would have come first
        while True:
            if (over := joined((a, b))) is not None and over < before:
                return False
            if (a > b and left[a] != a) or left[b] == b:
                if left[a] == a:
                    return True
                before, a = a, right[a]
            else:
                before, b = b + 1, left[b]  # of equal ranks the leftmost comes first

    def viterbi(self, text: str, last: dict[int, tuple[int, int]], known: int = 0) -> list[int]:
        """Identifiers of text (space marks in place), committed boundary by boundary.

        last: end -> (start, number of the piece) of the surviving path's last step, told for the first `known` ends already.
        """
        longest = self.vocab.longest
        out: list[int] = []
        base = 0  # everything before base is committed
        for end in range(known + 1, len(text) + 1):
            last[end] = self._column(text, end, last)
            if end - base > 4 * longest:
                # Where do the paths to all positions of the window meet? No later piece starts before it.
                at = set(range(max(base, end - longest), end + 1))
                while len(at) > 1:
                    far = max(at)
                    at.discard(far)
                    at.add(last[far][0] if far > base else base)
                meet = at.pop()
                if meet > base:
                    self._commit(text, last, base, meet, out)
                    for p in [p for p in last if p < meet]:
                        del last[p]  # the step that ends at meet stays: it decides what may follow
                    base = meet
        self._commit(text, last, base, len(text), out)
        return out

    def _column(self, text: str, end: int, last) -> tuple[int, int]:
        """The surviving path's last step at end."""
        number, pairs, n = self.number.get, self.pairs, len(self.pieces)
        for start in range(max(0, end - self.reach.get(text[end - 3 : end], 2) if end > 2 else 0), end):
            piece = number(text[start:end])
            if piece is not None:
                if not start:
                    return 0, piece
                if start in last:
                    before = last[start][1]
                    sound = before < 0 or pairs.get(before * n + piece)
                    if sound is None:
                        if len(pairs) >= self.PAIRS:
                            pairs.clear()
                        sound = pairs[before * n + piece] = self.apart(before, piece)
                    if sound:
                        return start, piece
        return end - 1, -1  # outside the vocabulary: bytes

    def _commit(self, text: str, last, base: int, end: int, out: list[int]) -> None:
        path = []
        while end > base:
            start, piece = last[end]
            path.append((start, end, piece))
            end = start
        for start, end, piece in reversed(path):
            if piece >= 0:
                out.append(self.vocab.id[self.pieces[piece]])
            else:
                out.extend(self.vocab.byte_id[b] for b in text[start:end].encode())

    def parts(self, text: str) -> list[str]:
        """A text with space marks in place, cut where no piece can cross."""
        out, lo, size = [], 0, self.PIECE
        while lo < len(text):
            piece = text[lo : lo + size]
            kind = self.kind[np.frombuffer(piece.encode("utf-32-le"), np.uint32)]
            cuts = [0, *(np.flatnonzero(~self.meets[kind[:-1], kind[1:]]) + 1).tolist(), len(piece)]
            if lo + len(piece) < len(text):
                cuts.pop()  # the last part may go on
            if len(cuts) == 1:
                size *= 2
                continue
            out.extend([piece[a:b] for a, b in zip(cuts, cuts[1:])])
            lo, size = lo + cuts[-1], self.PIECE
        return out

    def ids(self, parts) -> dict[str, bytes]:
        """Identifiers of each part; fresh ones in order, so that each takes over the lattice columns of the prefix it shares with the one before."""
        out: dict[str, bytes] = {}
        fresh = []
        for part in parts:
            if (ids := self.memo.find(part)) is None:
                fresh.append(part)
            else:
                out[part] = ids
        short, last, before = 4 * self.vocab.longest, {}, ""
        for part in sorted(fresh):
            if len(part) > short:
                ids = array("i", self.viterbi(part, {})).tobytes()
            else:
                same, most = 0, min(len(part), len(before))
                while same < most and part[same] == before[same]:
                    same += 1
                ids = array("i", self.viterbi(part, last, same)).tobytes()
                before = part
            self.memo.keep(part, ids)
            out[part] = ids
        return out

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Identifiers of each text as packed int32; equal parts of all texts are encoded once."""
        rows = [self.parts(SPACE + t.decode().replace(" ", SPACE)) if t else [] for t in texts]
        ids = self.ids(set().union(*rows))
        return [b"".join(map(ids.__getitem__, row)) for row in rows]

    def encode(self, text: bytes) -> bytes:
        """Identifiers as packed int32."""
        return self.encode_all([text])[0]

    def decode_all(self, flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Texts of identifiers that follow each other, each row's from one of ends to the next."""
        joined = self.table.take(pa.array(flat))
        _, offsets, data = joined.buffers()
        at = np.frombuffer(offsets, np.int32)[ends].tolist()
        rows = [data.slice(a, b - a).to_pybytes() if b > a else b"" for a, b in zip(at[:-1], at[1:])]
        return [self._spaced(raw) for raw in rows]

    def decode(self, ids) -> bytes:
        """Text of identifiers: pieces and bytes joined, marks back to spaces, the mark in front dropped."""
        return self._spaced(b"".join(map(self.bytes_of.__getitem__, ids)))

    def _spaced(self, raw: bytes) -> bytes:
        raw = raw.replace(SPACE.encode(), b" ")
        return raw[1:] if raw[:1] == b" " else raw


@kept_in_worker
@functools.lru_cache(maxsize=1)
def coder_of(blob: bytes) -> Encoder:
    """One per worker process, so that a task finds what earlier ones of this operator have worked out."""
    return Encoder(vocabulary(blob))


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, n_tokens, text_sha256 (of the given text), decoded_sha256, round_trip.

    round_trip tells whether the decoded text equals the given one; it fails only where the text
    itself holds the model's space mark, which decodes to a space.
    """
    bound_batches(docs.sparkSession)
    blob = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        coder = coder_of(blob.value)
        for whole in batches:
            for batch in by_bytes(whole, 1, 2 << 20, 1000):
                texts = [t or b"" for t in batch.column(1).to_pylist()]
                packed = coder.encode_all(texts)
                flat = np.frombuffer(b"".join(packed), np.int32)
                ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                back = coder.decode_all(flat, ends)
                sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
                given = sha(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.diff(ends).astype(np.int64)), given, sha(back), pa.array([a == b for a, b in zip(texts, back)], pa.bool_())],
                    ["id", "ids", "n_tokens", "text_sha256", "decoded_sha256", "round_trip"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(
        run, "id long, ids array<int>, n_tokens long, text_sha256 string, decoded_sha256 string, round_trip boolean"
    )
    return rows.withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text for rows of identifiers; null identifiers give the empty text."""
    bound_batches(encoded.sparkSession)
    blob = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        coder = coder_of(blob.value)
        for batch in batches:
            texts = [coder.decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
