"""Exact dedup on an extendible-hash index in shared files.

Keys are the leading KEY_BITS bits of the SHA-256 of the normalised text. A directory of
2**depth slots maps key prefixes to buckets; a bucket above its capacity splits on the next
bit, and the directory doubles when the bucket is as deep as it. Each task folds its own
copies first (so a text that fills a third of the table sends one row a task), then owner
tasks take the buckets, that is key ranges, in key order, chain texts whose keys collide and
compare their bytes. The index, one entry for each distinct text, lies in the shared folder;
all documents look their entry up.

Defined cases: null counts as the empty text; of equal texts the row with the largest doc_id
stays, null doc_ids below all others; rows repeated with the same doc_id and text are all
marked as the one that stays (keep_one keeps one of them); an empty table gives an empty index
and no rows; a very long text is one row like any other, read whole; columns of any other name,
those of the result included, are carried through keep_one as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import FOLD, bound_batches, by_bytes, fold_ascii, publish, shuffle_width, trimmed

KEY_BITS = 60


class Directory:
    """Extendible-hash directory: slots for key prefixes, each pointing to a bucket (prefix, depth)."""

    def __init__(self):
        self.depth = 0
        self.slots: list[tuple[int, int]] = [(0, 0)]

    def double(self) -> None:
        self.slots = [b for b in self.slots for _ in (0, 1)]
        self.depth += 1

    def split(self, bucket: tuple[int, int]) -> list[tuple[int, int]]:
        prefix, depth = bucket
        if depth == self.depth:
            self.double()
        halves = [(2 * prefix, depth + 1), (2 * prefix + 1, depth + 1)]
        first, width = prefix << (self.depth - depth), 1 << (self.depth - depth)
        self.slots[first : first + width] = [halves[0]] * (width // 2) + [halves[1]] * (width // 2)
        return halves

    def buckets(self) -> list[tuple[int, int]]:
        return list(dict.fromkeys(self.slots))

    def starts(self) -> np.ndarray:
        """First key of each bucket, ascending: a bucket owns a range of keys."""
        return np.array([p << (KEY_BITS - d) for p, d in self.buckets()], np.int64)


def build_directory(keys: DataFrame, capacity: int, step: int = 6) -> Directory:
    """Split buckets until none is above capacity (bytes) or one key fills it.

    keys: distinct key, bytes. Loads are counted by Spark for 2**step parts of each overfull
    bucket at a time; the driver sees those sums, never keys.
    """
    directory = Directory()
    level, overfull = 0, {0}
    while overfull and level + step <= KEY_BITS:
        level += step
        part = F.shiftright("key", KEY_BITS - level)
        rows = keys.withColumn("part", part)
        if level > step:
            rows = rows.join(F.broadcast(keys.sparkSession.createDataFrame([(int(p),) for p in sorted(overfull)], "up long")), F.shiftright("part", step) == F.col("up"), "left_semi")
        loads = {r[0]: (r[1], r[2]) for r in rows.groupBy("part").agg(F.sum("bytes"), F.count("*")).collect()}

        def load(prefix: int, depth: int) -> tuple[int, int]:
            lo, hi = prefix << (level - depth), (prefix + 1) << (level - depth)
            found = [loads[p] for p in range(lo, hi) if p in loads]
            return sum(x for x, _ in found), sum(x for _, x in found)

        pending = [(p, level - step) for p in overfull]
        overfull = set()
        while pending:
            bucket = pending.pop()
            size, count = load(*bucket)
            if size <= capacity or count <= 1:
                continue
            if bucket[1] == level:
                overfull.add(bucket[0])
            else:
                pending.extend(directory.split(bucket))
    return directory


class Chain:
    """Texts under one key: collisions are chained and told apart by their bytes."""

    def __init__(self):
        self.entries: list[list] = []  # text, largest id, rows, rows with that id

    def add(self, text: bytes, doc_id: int | None, rows: int, ties: int) -> None:
        for entry in self.entries:
            if entry[0] == text:
                if entry[1] == doc_id:
                    entry[3] += ties
                elif entry[1] is None or (doc_id is not None and doc_id > entry[1]):
                    entry[1], entry[3] = doc_id, ties
                entry[2] += rows
                return
        self.entries.append([text, doc_id, rows, ties])


def key_of(text: bytes) -> int:
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "big") >> (64 - KEY_BITS)


ENTRY = "bucket long, key long, text binary, id long, n long, ties long"
INDEX = "bucket long, key long, chain int, text_sha256 string, keep_id long, group_size long, n_keep long"


def _entries(found: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["bucket", "key", "text", "id", "n", "ties"])


def fold_copies(starts: np.ndarray, flush_bytes: int = 12 << 20):
    """mapInArrow function: normalise, and fold the copies that one task meets, in bounded memory."""

    def run(batches):
        table: dict[int, Chain] = {}
        held = 0

        def drain():
            found, size = [], 0
            for k, c in table.items():
                bucket = int(np.searchsorted(starts, k, "right")) - 1
                for e in c.entries:
                    found.append((bucket, k, *e))
                    size += len(e[0]) + 200
                    if size > 2 << 20:
                        yield _entries(found)
                        found, size = [], 0
            table.clear()
            if found:
                yield _entries(found)

        for whole in batches:
            for batch in by_bytes(whole, 1, 2 << 20):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    text = (text or b"").translate(FOLD)
                    key = key_of(text)
                    if key not in table:
                        table[key] = Chain()
                        held += len(text) + 200
                    table[key].add(text, doc_id, 1, 1)
                    if held > flush_bytes:
                        yield from drain()
                        held = 0
        yield from drain()

    return run


def own_buckets(batches):
    """mapInArrow function of an owner task: rows come by bucket and key; each key's chain is closed in turn."""
    names = ["bucket", "key", "chain", "text_sha256", "keep_id", "group_size", "n_keep"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    at, chain, out = None, Chain(), []

    def close():
        out.extend((*at, i, hashlib.sha256(e[0]).hexdigest(), e[1], e[2], e[3]) for i, e in enumerate(chain.entries))

    for batch in (part for whole in batches for part in by_bytes(whole, 2, 2 << 20)):
        for bucket, key, text, doc_id, n, ties in zip(*(c.to_pylist() for c in batch.columns)):
            if (bucket, key) != at:
                if at:
                    close()
                at, chain = (bucket, key), Chain()
            chain.add(text, doc_id, n, ties)
        if len(out) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
            out = []
    if at:
        close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def build_index(docs: DataFrame, bucket_bytes: int = 2 << 20, most_buckets: int = 1 << 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index of distinct normalised texts, published to the shared folder: columns of INDEX.

    Buckets hold bucket_bytes, or as much more as keeps the directory near most_buckets, so the
    directory that tasks receive has a bounded size.
    """
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    folded = fold_ascii(F.col("text"))
    key = F.conv(F.substring(F.sha2(folded.cast("binary"), 256), 1, KEY_BITS // 4), 16, 10).cast("long")
    keys = publish(rows.select(key.alias("key"), F.octet_length(folded).cast("long").alias("size")).groupBy("key").agg(F.max("size").alias("bytes")), "dedup-keys")
    total = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    directory = build_directory(keys, max(bucket_bytes, total // most_buckets))
    starts = directory.starts()
    entries = rows.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(trimmed(fold_copies(starts)), ENTRY)
    owners = entries.repartition(max(shuffle_width(spark), 1), "bucket").sortWithinPartitions("bucket", "key")
    return publish(owners.mapInArrow(trimmed(own_buckets), INDEX), "dedup-index")


def _looked_up(docs: DataFrame, index: DataFrame, id_col: str, text_col: str, columns: dict[str, str]) -> DataFrame:
    """__id, __sha and the columns (new name: old name) of every row, beside its entry of the index."""
    rows = docs.select(F.col(id_col).alias("__id"), F.sha2(fold_ascii(F.col(text_col)).cast("binary"), 256).alias("__sha"), *[F.col(old).alias(new) for new, old in columns.items()])
    return rows.join(index, F.col("__sha") == F.col("text_sha256"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256, n_keep for every row.

    n_keep: rows that carry the keep_id with this text; above 1 only where rows repeat.
    """
    index = build_index(docs, id_col=id_col, text_col=text_col, **options).select("text_sha256", "keep_id", "group_size", "n_keep")
    return _looked_up(docs, index, id_col, text_col, {}).select(F.col("__id").alias(id_col), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_keep")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with all their columns."""
    index = build_index(docs, id_col=id_col, text_col=text_col, **options).select("text_sha256", "keep_id", "n_keep")
    columns = {f"__c{i}": c for i, c in enumerate(docs.columns)}
    kept = _looked_up(docs, index, id_col, text_col, columns).where(F.col("__id").eqNullSafe(F.col("keep_id")))
    named = [F.col(new).alias(old) for new, old in columns.items()]
    if not index.where("n_keep > 1").take(1):
        return kept.select(named)
    return kept.where("n_keep = 1").select(named).union(kept.where("n_keep > 1").dropDuplicates(["text_sha256"]).select(named))
