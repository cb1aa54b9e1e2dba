"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a chunk form a doubly linked list; a heap holds the adjacent pairs whose
concatenation is a piece, lowest rank first and leftmost among equals. Each popped pair that
is still current merges. The count is the number of initial symbols less the merges (a symbol
outside the vocabulary counts as its UTF-8 bytes); no identifiers are made.

Defined cases: null counts as the empty text and has 0 bytes and 0 tokens; special strings in
a text are ordinary text; repeated rows are counted one by one; an empty table gives an empty table;
a very long text is counted whole, chunk by chunk; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_model import SPACE, Memo, Vocabulary, chunks, vocabulary
from .shared import bound_batches, by_bytes


def count_merged(chunk: str, vocab: Vocabulary) -> int:
    """Tokens of one chunk."""
    rank = vocab.rank
    n = len(chunk)
    size = [1] * n  # characters of the symbol that starts at i, 0 when merged away
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(chunk[i : i + 2])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, width = heapq.heappop(heap)
        if not size[i] or (j := after[i]) >= n or size[i] + size[j] != width:
            continue  # a neighbour has changed since the pair was pushed
        merges += 1
        size[i], size[j] = width, 0
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank.get(chunk[i : k + size[k]])) is not None:
                heapq.heappush(heap, (r, i, width + size[k]))
        if (h := before[i]) >= 0 and (r := rank.get(chunk[h : i + width])) is not None:
            heapq.heappush(heap, (r, h, size[h] + width))
    symbols = n
    for c in set(chunk):
        if c not in vocab.id:  # never part of a merge, as every piece's characters are pieces
            symbols += chunk.count(c) * (len(c.encode()) - 1)
    return symbols - merges


class Counter:
    """Counts whole texts given as UTF-8 bytes."""

    def __init__(self, vocab: Vocabulary, memo_bytes: int = 160 << 20):
        self.parts = Memo(lambda part: count_merged(part, vocab), memo_bytes // 3)
        self.words = Memo(lambda word: self.count(SPACE + word.decode()), memo_bytes - memo_bytes // 3)
        self.cut = vocab.parts

    def count(self, marked: str) -> int:
        return sum(map(self.parts.__getitem__, self.cut(marked)))

    def __call__(self, text: bytes) -> int:
        if not text:
            return 0
        if b"  " not in text and text[:1] != b" " and text[-1:] != b" " and b"\xe2\x96\x81" not in text:
            return sum(map(self.words.__getitem__, text.split(b" ")))  # one space mark before each word
        return sum(map(self.count, chunks(text.decode())))


def count_tokens(docs: DataFrame, model: bytes, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row; the model travels to the executors as one 0.5 MB broadcast."""
    bound_batches(docs.sparkSession)
    blob = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        counter = Counter(vocabulary(blob.value))
        for whole in batches:
            for batch in by_bytes(whole, 1, 4 << 20):
                texts = [t or b"" for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([counter(t) for t in texts], pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(count, "id long, n_bytes long, n_tokens long")
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
