"""Language identification by string-kernel classification.

The kernel of two texts is the number of byte n-grams (n = 1..3, blended) that both hold,
presence only, over the square root of the product of their numbers of n-grams; n-grams that
no landmark holds are left out. Nystrom landmarks reduce kernel ridge regression, one language
against the rest, to a small linear system. As the kernel is linear in presence vectors, the
landmarks and weights fold into one matrix, and batches of whole texts are scored by a matrix
product.

The classifier is fitted on a bounded sample: at most per_lang rows of each language with at
most longest characters, the smallest by a hash of the identifier. Everything else reads all
rows and whole texts.

Defined cases: a null or empty text or one without letters is `und` with score 0; without any
labelled row every text is `und`; a null doc_id is neither held out nor learned from; repeated
rows are judged one by one; of equal scores the first language by name wins; a very long text is
read whole, in pieces, so that memory beyond the text itself is bounded; an empty table gives no
rows; columns of any name may follow, those named in keep are carried along under their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, by_bytes, trimmed

UNKNOWN = "und"
#: Bytes to symbols: A-Z as a-z 1..26, bytes from 128 up 27..154, any other byte 0 (a gap).
SYMBOL = np.zeros(256, np.int32)
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[128:] = np.arange(27, 155)
N = 155
LATIN = re.compile(rb"[A-Za-z]")

#: Bytes whose n-grams are worked out at a time.
PIECE = 1 << 20


def _codes(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, n-gram code) of the n-grams that end after the first two bytes, and of the pair and letter before; owner belongs to data[1:]."""
    s = SYMBOL[data]
    one, two, three = s[1:], s[:-1] * N + s[1:], (s[:-2] * N + s[1:-1]) * N + s[2:]
    # A gap lies between texts, so an n-gram is its last byte's, or its centre's.
    letter2, letter3 = (s[:-1] > 0) | (s[1:] > 0), s[1:-1] > 0
    return (
        np.concatenate([owner[s[1:] > 0], owner[letter2], owner[: len(three)][letter3]]),
        np.concatenate([one[one > 0], N + two[letter2], N + N * N + three[letter3]]),
    )


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram code) of all n-grams of a batch; none crosses texts."""
    joined = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    return _codes(joined, np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts]))


def grams_in_pieces(texts: list[bytes]):
    """grams of a batch, of texts above PIECE piece by piece; n-grams at a cut come with the piece behind it, which goes two bytes back."""
    short = [i for i, t in enumerate(texts) if len(t) <= PIECE]
    if short:
        who, code = grams([texts[i] for i in short])
        yield np.array(short)[who], code
    for i, text in enumerate(texts):
        if len(text) > PIECE:
            whole = np.frombuffer(text, np.uint8)
            for lo in range(0, len(text), PIECE):
                part = whole[max(0, lo - 2) : lo + PIECE]
                part = np.concatenate([[32] if not lo else [], part, [32] if lo + PIECE >= len(text) else []]).astype(np.uint8)
                yield _codes(part, np.full(len(part) - 1, i))


class Kernel:
    """Fitted classifier: n-gram columns, folded weights (n-grams x languages) and the languages."""

    def __init__(self, langs: list[str], column: np.ndarray, weights: np.ndarray):
        self.langs, self.column, self.weights = langs, column, weights

    @staticmethod
    def presence(texts: list[bytes], column: np.ndarray, width: int) -> np.ndarray:
        x = np.zeros((len(texts), width + 1), np.float32)
        for who, code in grams_in_pieces(texts):
            x[who, column[code]] = 1
        return x[:, :width]

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[str], landmarks: int = 256, ridge: float = 1.0) -> Kernel:
        langs = sorted(set(labels))
        column = np.full(N + N * N + N**3, -1, np.int32)
        if not langs:
            return cls([], column, np.zeros((0, 0), np.float32))
        by = {c: [i for i, x in enumerate(labels) if x == c] for c in langs}
        chosen = [i for c in langs for i in by[c][: max(1, landmarks // len(langs))]]
        codes = np.unique(grams([texts[i] for i in chosen])[1])
        column[codes] = np.arange(len(codes))
        column[column < 0] = len(codes)  # the last column takes what no landmark holds
        x = cls.presence(texts, column, len(codes))
        x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        marks = x[chosen]
        k_nm, k_mm = (x @ marks.T).astype(float), (marks @ marks.T).astype(float)
        target = np.array([[1.0 if y == c else -1.0 for c in langs] for y in labels])
        # Each language weighs the same, however many rows it has.
        weight = np.array([1.0 / len(by[y]) for y in labels])[:, None] * len(labels) / len(langs)
        alpha = np.linalg.solve(k_nm.T @ (weight * k_nm) + ridge * k_mm + 1e-6 * np.eye(len(chosen)), k_nm.T @ (weight * target))
        return cls(langs, column, (marks.T @ alpha).astype(np.float32))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Texts x languages, about -1..1."""
        x = self.presence(texts, self.column, len(self.weights))
        return (x @ self.weights) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def has_letter(text: bytes) -> bool:
    if LATIN.search(text):
        return True
    return any(c.isalpha() for lo in range(0, len(text), PIECE) for c in text[max(0, lo - 3) : lo + PIECE].decode("utf-8", "ignore"))


def held_out(id_col: str):
    """Rows that are never learned from: crc32 of the identifier's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, per_lang: int, longest: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[bytes], list[str]]:
    """The bounded training sample, in a fixed order."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest) & ~held_out("id"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, 1.3 * per_lang / n)).otherwise(share)
    picked = rows.where(F.pmod(F.col("h"), F.lit(1 << 30)) < share * float(1 << 30)).select("lang", "h", "id", F.col("text").cast("binary")).collect()
    texts, labels, have = [], [], dict.fromkeys(counts, 0)
    for lang, _, _, text in sorted((r[0], r[1] % (1 << 30), r[2], bytes(r[3])) for r in picked):
        if have[lang] < per_lang:
            have[lang] += 1
            texts.append(text)
            labels.append(lang)
    return texts, labels


def identify(docs: DataFrame, per_lang: int = 300, longest: int = 20_000, landmarks: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, held_out, lang_pred, score for every row, learned from the labelled rows that are not held out.

    keep: columns of docs to carry along after these. The text goes to the executors' Python once, also where it is kept.
    """
    bound_batches(docs.sparkSession)
    texts, labels = sample(docs, per_lang, longest, id_col, text_col, lang_col)
    fitted = Kernel.fit(texts, labels, landmarks)
    used = np.flatnonzero(fitted.column < len(fitted.weights)) if len(fitted.langs) else np.zeros(0, np.int64)
    model = docs.sparkSession.sparkContext.broadcast((fitted.langs, used, fitted.column[used], fitted.weights))
    first = 0 if text_col in keep else 1

    def run(batches):
        langs, at, place, weights = model.value
        column = np.full(N + N * N + N**3, len(weights), np.int32)
        column[at] = place
        kernel = Kernel(langs, column, weights)
        for whole in batches:
            names, scores = [], []
            for batch in by_bytes(whole, 0, PIECE, 64):
                texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
                best = kernel.score(texts) if langs else np.zeros((len(texts), 1))
                for text, s, k in zip(texts, best.max(1).tolist(), best.argmax(1).tolist()):
                    known = bool(langs) and has_letter(text)
                    names.append(langs[k] if known else UNKNOWN)
                    scores.append(min(1.0, max(0.0, (s + 1) / 2)) if known else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), *whole.columns[first:]], ["lang_pred", "score", *whole.schema.names[first:]])

    carried = {c: f"__k{i}" for i, c in enumerate(keep) if c != text_col}
    kept = docs.select(F.col(text_col).cast("string").alias("__t"), F.col(id_col).alias("__id"), held_out(id_col).alias("__held"), *[F.col(c).alias(k) for c, k in carried.items()])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[first:])
    rows = kept.mapInArrow(trimmed(run), f"lang_pred string, score double, {fields}")
    text = F.col("__t").cast(docs.schema[text_col].dataType) if not first else None
    return rows.select(F.col("__id").alias(id_col), F.col("__held").alias("held_out"), "lang_pred", "score", *[(text if c == text_col else F.col(carried[c])).alias(c) for c in keep])
