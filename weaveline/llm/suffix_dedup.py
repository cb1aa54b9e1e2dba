"""Substring dedup on bytes with suffix arrays: bytes covered by a repeated LENGTH-byte string go.

Every window of LENGTH bytes is filed under its minimiser, the least hash of its GRAM-byte
strings, and the minimiser's distance from the window's start, in bins of BIN distances. The
windows of one bin share their core, all bytes that lie in each of them; equal windows lie in
equal cores. Per minimiser and bin a document sends one row with hashes of core and hull.

* Rows with equal hulls are copies: all their windows repeat. Each task folds its own first.
* Rows with equal cores and different hulls lie at the ends of repeats. Their hulls go to the
  task that owns the core, which builds a suffix array over them with LCP and the
  longest-previous-factor test from previous and next smaller positions in suffix order.
* A core with more than `most` such hulls is refined: its bin is halved until groups are small
  (a bin of one distance has only copies), so no group is too large for a task.

keep_first removes only what repeats an earlier place (by doc_id and offset); the default
removes every copy.

Defined cases: null counts as empty; texts shorter than LENGTH keep all; matches never cross
rows; rows that repeat doc_id and text are copies of each other; a doc_id that comes with
several texts pools their spans; rows with a null doc_id are told apart by their text; very
long texts are cut into overlapping stretches for the minimisers only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, publish, shuffle_width
from .word_sets import _BASE, _INVERSE, _VALUE, mix, powers

LENGTH = 400
GRAM = 32
BIN = 93
STRETCH = 4 << 20
#: A document's row: core and hull hashes, document, minimiser, least and greatest distance of its windows in the bin, start of the bin.
ROW = "core long, hull long, doc long, at long, low int, high int, bin int"
#: Rows leave the grouping either as a span to remove (kind 0) or as a hull to compare (kind 1).
OUT = f"kind int, {ROW}"
SPAN = "doc long, start long, stop long"


class Ranges:
    """Hashes of byte ranges of one text."""

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * powers(_BASE, len(data))[: len(data)], out=self.total[1:])
        self.inverse = powers(_INVERSE, len(data) + 1)

    def __call__(self, start, stop, salt=0) -> np.ndarray:
        return mix((self.total[stop] - self.total[start]) * self.inverse[start] + (np.asarray(stop - start).astype(np.uint64) << np.uint64(20)) + np.asarray(salt).astype(np.uint64))


def minimisers(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, last window) for the runs of windows with the same leftmost least n-gram."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty
    if len(data) > STRETCH:  # positions take the low bits of the keys below
        parts = []
        for lo in range(0, len(data) - length + 1, STRETCH - length + 1):
            parts.append(tuple(x + lo for x in minimisers(data[lo : lo + STRETCH], length)))
        return tuple(np.concatenate(x) for x in zip(*parts))
    h = Ranges(data)
    n, width = len(data) - GRAM + 1, length - GRAM + 1
    at = np.arange(n)
    key = (h(at, at + GRAM) & ~np.uint64((1 << 23) - 1)) | at.astype(np.uint64)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(n - width + 1)
    least = (np.minimum(back[start], ahead[start + width - 1]) & np.uint64((1 << 23) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return least[first], first, np.append(first[1:], len(least)) - 1


def rows_of(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """core, hull, at, low, high, bin of each minimiser and bin of a text."""
    data = np.frombuffer(text, np.uint8)
    at, first, last = minimisers(data, length)
    if not len(at):
        return (np.zeros(0, np.int64),) * 6
    h, out = Ranges(data), []
    for lo in range(0, length - GRAM + 1, BIN):
        low, high = np.maximum(at - last, lo), np.minimum(at - first, lo + BIN - 1)
        has = low <= high
        a, low, high = at[has], low[has], high[has]
        core = h(a - lo, a - (lo + BIN - 1) + length, lo)
        hull = h(a - high, a - low + length, low * 512 + high)
        out.append((core.astype(np.int64), hull.astype(np.int64), a, low, high, np.full(len(a), lo)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _batch(schema: str, columns) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    to = {"long": np.int64, "int": np.int32}
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(to[k])) for c, k in zip(columns, kinds)], list(names))


def _file(length: int, keep_first: bool, most_bytes: int = 16 << 20):
    """mapInArrow function: rows of all texts, copies inside the task folded. Kind 0 rows are spans already certain."""

    def run(batches):
        held, size = [], 0

        def drain():
            doc = np.concatenate([np.full(len(r[0]), d, np.int64) for d, r in held])
            core, hull, at, low, high, bins = (np.concatenate([r[k] for _, r in held]) for k in range(6))
            order = np.lexsort((at, doc, hull, core))
            core, hull, doc, at, low, high, bins = (x[order] for x in (core, hull, doc, at, low, high, bins))
            again = np.zeros(len(core), bool)
            again[1:] = (core[1:] == core[:-1]) & (hull[1:] == hull[:-1])
            copied = again.copy()
            copied[:-1] |= again[1:]
            gone = again if keep_first else copied
            for pick, kind in ((gone, 0), (~again, 1)):
                at_once = np.flatnonzero(pick)
                for lo in range(0, len(at_once), 50_000):
                    k = at_once[lo : lo + 50_000]
                    yield _batch(OUT, (np.full(len(k), kind), core[k], hull[k], doc[k], at[k], low[k], high[k], bins[k]))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and len(text) >= length:
                    held.append((doc, rows_of(text, length)))
                    size += len(text)
                    if size > most_bytes:
                        yield from drain()
                        held, size = [], 0
        if held:
            yield from drain()

    return run


def _match(keep_first: bool):
    """mapInArrow function over rows sorted by kind, core, hull, doc, at: copies become spans, lone cores drop out.

    Of each hull one row goes on, if its core has another hull. Memory is one batch.
    """

    def run(batches):
        last = None  # the last row, not yet decided
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            ready = columns[0] == 0
            if ready.any():
                yield _batch(OUT, [c[ready] for c in columns])
            columns = [c[~ready] for c in columns]
            if not len(columns[0]):
                continue
            if last is not None:
                columns = [np.concatenate([a, b]) for a, b in zip(last[0], columns)]
            yield from decide(columns, last[1] if last else (False, False), False)
            core, hull = columns[1], columns[2]
            n = len(core)
            # What is known of the row held back: does it have a neighbour of its core, of its hull, above it?
            flags = (bool(n > 1 and core[-1] == core[-2]), bool(n > 1 and core[-1] == core[-2] and hull[-1] == hull[-2])) if n > 1 else last[1] if last else (False, False)
            last = ([c[-1:] for c in columns], flags)
        if last is not None:
            yield from decide(last[0], last[1], True)

    def decide(columns, before, final):
        core, hull = columns[1], columns[2]
        n = len(core)
        same_core, same_hull = np.zeros(n, bool), np.zeros(n, bool)
        same_core[1:] = core[1:] == core[:-1]
        same_hull[1:] = same_core[1:] & (hull[1:] == hull[:-1])
        same_core[0], same_hull[0] = before
        copied, grouped = same_hull.copy(), same_core.copy()
        copied[:-1] |= same_hull[1:]
        grouped[:-1] |= same_core[1:]
        upto = n if final else n - 1
        inside = np.arange(n) < upto
        gone = (same_hull if keep_first else copied) & inside
        onward = grouped & ~same_hull & inside
        for pick, kind in ((gone, 0), (onward, 1)):
            if pick.any():
                yield _batch(OUT, [np.full(int(pick.sum()), kind), *[c[pick] for c in columns[1:]]])

    return run


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, LCP with the suffix before) up to depth, by prefix doubling."""
    n = len(symbols)
    ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int64)]
    step = 1
    while step < depth and ranks[-1].max() < n - 1:
        second = np.zeros(n, np.int64)
        second[:-step] = ranks[-1][step:] + 1
        ranks.append(np.unique(ranks[-1] * (n + 1) + second, return_inverse=True)[1].astype(np.int64))
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    p, q = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, np.int64)
    for level in range(len(ranks) - 1, -1, -1):  # each level once is enough below twice the top level
        inside = (p < n) & (q < n)
        same = inside.copy()
        same[inside] = ranks[level][p[inside]] == ranks[level][q[inside]]
        p, q = p + (same << level), q + (same << level)
        lcp[1:] += same.astype(np.int64) << level
    return order, lcp


def earlier(order: np.ndarray, lcp: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(repeats anywhere, repeats an earlier position) for every position, matches of at least length.

    Longest previous factors: the match with an earlier position is longest with the previous
    or the next smaller position in suffix order. Only suffixes next to a match of that length
    can have one, so the two scans pass over runs of these.
    """
    n = len(order)
    long = lcp >= length
    some = long.copy()
    some[:-1] |= long[1:]
    anywhere = np.zeros(n, bool)
    anywhere[order[some]] = True
    before = np.zeros(n, bool)
    places = np.flatnonzero(some)
    for scan, link in ((places, 0), (places[::-1], 1)):  # previous, then next smaller
        stack: list[int] = []  # rising positions of this run
        for r in scan.tolist():
            if not (long[r] if not link else r + 1 < n and long[r + 1]):
                stack.clear()
            here = int(order[r])
            while stack and stack[-1] > here:
                stack.pop()
            if stack:
                before[here] = True
            stack.append(here)
    return anywhere, before


def repeated_windows(groups: list[list[bytes]], length: int, keep_first: bool) -> list[list[np.ndarray]]:
    """For each string of each group a mask over its windows; strings of other groups don't count.

    The strings of a group come in the order that decides which copy is the first.
    """
    parts, starts, at = [], [], 0
    for g, strings in enumerate(groups):
        starts.append([])
        for s in strings:
            starts[-1].append(at)
            parts.append(np.frombuffer(s, np.uint8).astype(np.int64) + 256 * g)
            parts.append(np.array([-1 - at]))  # a symbol of its own
            at += len(s) + 1
    order, lcp = suffix_order(np.concatenate(parts), length)
    anywhere, before = earlier(order, lcp, length)
    hit = before if keep_first else anywhere
    return [[hit[a : a + len(s) - length + 1] for a, s in zip(at_, strings)] for at_, strings in zip(starts, groups)]


def _compare(length: int, keep_first: bool, at_once: int = 1 << 17):
    """mapInArrow function over hulls sorted by core, doc, at: spans of the windows that repeat."""

    def run(batches):
        waiting, size, core_now = [], 0, None  # groups of (doc, first byte, bytes)

        def drain():
            groups = [g for g in waiting if len(g) > 1]
            if not groups:
                return
            out = []
            for g, masks in zip(groups, repeated_windows([[b for _, _, b in g] for g in groups], length, keep_first)):
                for (doc, start, _), mask in zip(g, masks):
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                    out.extend((doc, start + a, start + b - 1 + length) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()))
            if out:
                yield _batch(SPAN, zip(*out))

        for batch in batches:
            for core, doc, start, hull in zip(*(c.to_pylist() for c in batch.columns)):
                if core != core_now:
                    if size > at_once:
                        yield from drain()
                        waiting, size = [], 0
                    core_now = core
                    waiting.append([])
                waiting[-1].append((doc, start, hull))
                size += len(hull)
        if waiting:
            yield from drain()

    return run


def repeated_spans(rows: DataFrame, length: int, keep_first: bool, most: int = 256) -> DataFrame:
    """Spans (doc, start, stop) of rows (doc, t) to remove; they may overlap."""
    width = shuffle_width(rows.sparkSession)
    filed = rows.mapInArrow(_file(length, keep_first), OUT).repartition(width, "core").sortWithinPartitions("kind", "core", "hull", "doc", "at")
    found = publish(filed.mapInArrow(_match(keep_first), OUT), "suffix-rows")
    span = lambda df: df.select("doc", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + length).alias("stop"))
    spans = [span(found.where("kind = 0"))]

    ends = found.where("kind = 1")
    several = ends.groupBy("core").agg(F.min("hull").alias("a"), F.max("hull").alias("b")).where("a <> b").select("core")
    ends = ends.join(several, "core")
    hulls = ends.join(rows, "doc").select("core", "hull", "doc", "at", "low", "high", "bin", F.lit(BIN).alias("wide"), F.substring(F.col("t"), (F.col("at") - F.col("high") + 1).cast("int"), F.col("high") - F.col("low") + length).alias("bytes"))
    hulls = publish(hulls.dropDuplicates(["core", "doc", "at", "low", "high"]), "suffix-hulls")
    small = []
    while True:
        sizes = publish(hulls.groupBy("core").agg(F.count("*").alias("n")).where("n > 1"), "suffix-sizes")
        small.append(hulls.join(sizes.where(F.col("n") <= most), "core", "left_semi"))
        if not sizes.where(F.col("n") > most).take(1):
            break
        large = hulls.join(sizes.where(F.col("n") > most), "core", "left_semi")
        half = F.ceil(F.col("wide") / 2).cast("int")
        pieces = F.array(F.struct(F.col("bin").alias("lo"), half.alias("w")), F.struct((F.col("bin") + half).alias("lo"), (F.col("wide") - half).alias("w")))
        cut = large.withColumn("p", F.explode(pieces)).withColumn("lo2", F.greatest("low", F.col("p.lo"))).withColumn("hi2", F.least(F.col("high"), F.col("p.lo") + F.col("p.w") - 1)).where("p.w > 0 and lo2 <= hi2")
        cut = cut.withColumn("bytes", F.substring(F.col("bytes"), F.col("high") - F.col("hi2") + 1, F.col("hi2") - F.col("lo2") + length))
        inner = F.substring(F.col("bytes"), F.col("hi2") - F.col("p.lo") + 1, F.lit(length + 1) - F.col("p.w"))
        cut = cut.select(F.xxhash64("core", "p.lo", inner).alias("core"), F.xxhash64("lo2", "hi2", "bytes").alias("hull"), "doc", "at", F.col("lo2").alias("low"), F.col("hi2").alias("high"), F.col("p.lo").alias("bin"), F.col("p.w").alias("wide"), "bytes")
        cut = publish(cut, "suffix-cut")
        classes = cut.groupBy("core", "hull").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("first"))
        marked = cut.join(classes, ["core", "hull"])
        is_first = (F.col("doc") == F.col("first.doc")) & (F.col("at") == F.col("first.at"))
        spans.append(span(marked.where((F.col("n") > 1) & (~is_first if keep_first else F.lit(True)))))
        hulls = publish(marked.where(is_first).select(hulls.columns), "suffix-hulls")
    for part in small:
        compared = part.select("core", "doc", "at", (F.col("at") - F.col("high")).alias("start"), "bytes").repartition(width, "core").sortWithinPartitions("core", "doc", "at")
        spans.append(compared.select("core", "doc", "start", "bytes").mapInArrow(_compare(length, keep_first), SPAN))
    out = spans[0]
    for more in spans[1:]:
        out = out.union(more)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 for every row; with_text adds the bytes that stay."""
    bound_batches(docs.sparkSession)
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62)) - F.pmod(F.xxhash64(text_col), F.lit(1 << 61)))
    rows = docs.select(doc.alias("doc"), F.col(text_col).cast("binary").alias("t"))
    spans = repeated_spans(rows, length, keep_first).distinct().groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    spans = spans.select("doc", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                size, removed, count, sha, kept = [], [], [], [], []
                for text, starts, stops in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                    text = text or b""
                    stays, at, gone, runs, end = [], 0, 0, 0, -1
                    for a, b in zip(starts or [], stops or []):
                        a, b = min(a, len(text)), min(b, len(text))
                        if a > end:
                            runs += 1
                            stays.append(text[at:a])
                            gone += b - a
                            at = end = b
                        elif b > end:
                            gone += b - end
                            at = end = b
                    stays.append(text[at:])
                    rest = b"".join(stays)
                    for column, value in ((size, len(text)), (removed, gone), (count, runs), (sha, hashlib.sha256(rest).hexdigest()), (kept, rest if with_text else None)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (size, removed, count)], pa.array(sha), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = docs.select(F.col(id_col).cast("long").alias("id"), doc.alias("doc"), F.col(text_col).cast("binary").alias("t")).join(spans, "doc", "left").select("id", "t", "starts", "stops")
    out = joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept")
