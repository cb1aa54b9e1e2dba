"""N-gram Jaccard join of documents: exact components of links with Jaccard >= 0.8 of 5-word shingles.

1. Shingles that many documents hold are counted in every task and summed. They steer work only.
2. Every task joins its own documents in a prefix tree (prefix_tree.py) and sends keys once for
   each local component, so a text copied or varied many times sends few rows for each key. A
   key is an n-gram with the next one of its set in the order of their hashes: two sets that
   merely share a passage hold other n-grams between, so they share few keys, while similar
   sets still share most (key_prefix). Keys have a global order, those of common n-grams last;
   a prefix of it is sent, and SLACK more.
3. Components that hold a key are tied to the first that does; a task tells of each component that
   it met once, by a spanning forest. A document alone in its component that shares no more keys
   than SLACK gave has no partner and leaves, though others may stay tied through it. Ties form candidate clusters; two similar documents always lie in
   one cluster.
4. Round one joins one representative of each component, cluster by cluster. Round two joins
   all documents of the clusters that ties between components still apart form.
   A cluster above block_bytes is cut into blocks whose pairs are joined by different tasks.
5. Links of all steps make up the components.

Defined cases: null and empty texts have no shingles and stand alone; a text of fewer words is
one shingle; rows that repeat a doc_id count as one node; a null doc_id links with nothing and
has a null component_id; an empty table gives no rows; a very long text is one set like any other,
cut into words piece by piece; of equal sets the smallest doc_id stands for all; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .prefix_tree import Groups, join_block
from .shared import bound_batches, by_bytes, publish, shuffle_width, trimmed
from .word_sets import mix, sets_of

#: Kinds of rows: key and component, or a component and the first of those it is tied to; document and component; document and number of shingles; document and equal document.
TIE, MEMBER, SIZE, COPY = range(4)
#: Hundredths of a set's keys that are sent beyond its prefix; more of them let more documents without a partner leave.
SLACK = 3
#: So many ties of a task are held at a time.
TIES_HELD = 1 << 20
#: Shuffle partitions for each task that ties keys: a component is told of once a task, so that fewer tasks send less.
WIDE = 4
ROW = "kind int, key long, value long"
#: What leaves step 3; n: keys that a tied component shares.
MET = f"{ROW}, n long"
TOP = np.uint64(1) << np.uint64(63)
_THIS, _NEXT = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xABC98388FB8FAC03)


class Order:
    """Global order of keys: by hash, but keys of two common n-grams last, the commonest at the very end."""

    def __init__(self, common: np.ndarray):
        self.sorted = np.argsort(common)  # common: by rising count
        self.common = common[self.sorted]

    def first_keys(self, s: np.ndarray, most: int) -> np.ndarray:
        """The first keys of an ascending set: each of its n-grams with the next one, the last with the first."""
        after = np.roll(s, -1)
        keys = mix(s * _THIS + after * _NEXT) >> np.uint64(1)
        if len(self.common) and len(s):
            place = np.minimum(np.searchsorted(self.common, s), len(self.common) - 1)
            rank = np.where(self.common[place] == s, self.sorted[place], -1)
            rank = np.minimum(rank, np.roll(rank, -1))
            keys = np.where(rank < 0, keys, TOP | rank.astype(np.uint64) << np.uint64(40) | keys >> np.uint64(23))
        if most < len(keys):
            keys = np.partition(keys, most)[:most]
        return keys


def key_prefix(n: int) -> int:
    """So many first keys of a set of n n-grams must meet those of any partner.

    An n-gram that only this set holds breaks two of its keys, one that only the partner holds
    breaks one; ten times the former and eight times the latter sum to at most 2 n.
    """
    return min(n, 2 * n // 5 + 1)


def sent_length(n: int) -> int:
    """Similar sets have more than n * SLACK // 100 sent keys in common, n being the larger size.

    That the smaller set sends fewer is made up for by its prefix, of which it needs at most a third then.
    """
    return key_prefix(n) + n * SLACK // 100


def _rows(kind, key, value) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(np.asarray(key).astype(np.int64)), pa.array(np.asarray(value).astype(np.int64))], ["kind", "key", "value"])


def _slices(batches, most_bytes: int = 8 << 20):
    """(ids, texts) of bounded total size."""
    ids, texts, held = [], [], 0
    for batch in (part for whole in batches for part in by_bytes(whole, 1, most_bytes)):
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t or b"")
            held += len(texts[-1]) + 100
            if held > most_bytes:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def common_ngrams(rows: DataFrame, least_in_task: int = 4, most: int = 1 << 16) -> np.ndarray:
    """The n-grams that most documents hold, by rising count: at most `most`, which bounds only the order's tail."""

    def count(batches):
        for _, texts in _slices(batches):
            sets = sets_of(list(dict.fromkeys(texts)))
            h, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = n >= least_in_task
            yield pa.RecordBatch.from_arrays([pa.array(h[often].astype(np.int64)), pa.array(n[often].astype(np.int64))], ["h", "n"])

    found = rows.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most).toPandas()
    return found["h"].to_numpy(np.int64).astype(np.uint64)[::-1].copy()


def _local(order_of):
    """mapInArrow function of step 2."""

    def run(batches):
        order = Order(order_of.value)
        for ids, texts in _slices(batches):
            sets = sets_of(texts)
            ids = np.array(ids, np.int64)
            yield _rows(SIZE, ids, [len(s) for s in sets])
            first: dict[bytes, int] = {}
            copies = []
            for i, s in sorted(enumerate(sets), key=lambda x: ids[x[0]]):
                if len(s) and (j := first.setdefault(s.tobytes(), i)) != i:
                    copies.append((ids[i], ids[j]))
            if copies:
                yield _rows(COPY, *zip(*copies))
            own = list(first.values())  # by rising id
            label = join_block([sets[i] for i in own])
            moved = [(ids[own[k]], ids[own[r]]) for k, r in enumerate(label) if k != r]
            if moved:
                yield _rows(MEMBER, *zip(*moved))
            keys = [order.first_keys(sets[i], sent_length(len(sets[i]))) for i in own]
            token = np.concatenate(keys or [np.zeros(0, np.uint64)])
            comp = np.repeat(ids[[own[r] for r in label]], [len(k) for k in keys]) if own else np.zeros(0, np.int64)
            pick = np.lexsort((comp, token))
            token, comp = token[pick], comp[pick]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (comp[1:] != comp[:-1])
            token, comp = token[new].astype(np.int64), comp[new]
            for lo in range(0, len(token), 100_000):
                yield _rows(TIE, token[lo : lo + 100_000], comp[lo : lo + 100_000])

    return run


class Forest:
    """Ties between components, and how many keys each shares: a spanning forest of what a task has met."""

    def __init__(self):
        self.ties, self.shares, self.held = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)], 0

    def add(self, a: np.ndarray, b: np.ndarray, share: np.ndarray) -> None:
        self.ties.append(np.stack([a, b]))
        self.shares.append(np.stack([share, np.ones(len(share), np.int64)]))
        self.held += len(a)

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(component, the smallest it is tied to in steps, keys it shares) of all that were met; held in place of the ties."""
        a, b = np.concatenate(self.ties, axis=1)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        node, place = np.unique(np.concatenate([a[new], b[new]]), return_inverse=True)
        groups = Groups(len(node))
        for x, y in zip(*place.reshape(2, -1).tolist()):
            groups.join(x, y)
        root = node[[groups.find(x) for x in range(len(node))]] if len(node) else node
        who, n = np.concatenate(self.shares, axis=1)
        count = np.zeros(len(node), np.int64)
        np.add.at(count, np.searchsorted(node, who), n)
        self.ties, self.shares, self.held = [np.stack([node, root])], [np.stack([node, count])], len(node)
        return node, root, count


def _ties(batches):
    """mapInArrow function of step 3 over rows sorted by kind, key, value.

    Ties each component to the first that holds its key, and counts the keys a component shares.
    Other kinds pass. Memory is bounded, whatever the size of a key's group.
    """
    at = low = None
    spans = False  # whether a second component holds the key `at`
    forest = Forest()

    def rows(kind, key, value, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key), pa.array(value), pa.array(n)], ["kind", "key", "value", "n"])

    def tell(node, root, count):
        for lo in range(0, len(node), 100_000):
            part = slice(lo, lo + 100_000)
            yield rows(np.full(len(node[part]), TIE), node[part], root[part], count[part])

    for batch in batches:
        kind, key, value = (c.to_numpy() for c in batch.columns)
        other = kind != TIE
        if other.any():
            yield rows(kind[other], key[other], value[other], np.zeros(int(other.sum()), np.int64))
        key, value = key[~other], value[~other]
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        run = np.cumsum(new) - 1
        first = value[new]
        spanned = np.zeros(len(first), bool)
        if key[0] == at:
            first[0], spanned[0] = low, spans
        apart = value != first[run]
        spanning = spanned.copy()
        spanning[run[apart]] = True
        at, low, spans = key[-1], first[-1], bool(spanning[-1])
        if apart.any():
            forest.add(value[apart], first[run[apart]], np.concatenate([value[apart], first[spanning & ~spanned]]))
        if forest.held > TIES_HELD:
            told = forest.settle()
            if forest.held > TIES_HELD // 2:
                yield from tell(*told)
                forest = Forest()
    yield from tell(*forest.settle())


def _sets_from(texts: list[bytes]) -> list[np.ndarray]:
    """sets_of texts, which are let go."""
    sets = sets_of(texts)
    texts.clear()
    return sets


def _join_groups(batches):
    """mapInArrow function of step 4: rows sorted by cluster and block pair; links of each group."""
    at, ids, comps, texts = None, [], [], []

    def close():
        place: dict[int, int] = {}
        known = [place.setdefault(c, i) for i, c in enumerate(comps)]
        label = join_block(_sets_from(texts), known)
        pairs = {(ids[i], ids[r]) for i, r in enumerate(label) if i != r}
        if pairs:
            a, b = zip(*sorted(pairs))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for cluster, i, j, doc, comp, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (cluster, i, j) != at:
                if len(ids) > 1:
                    yield from close()
                at, ids, comps, texts = (cluster, i, j), [], [], []
            if not ids or ids[-1] != doc:
                ids.append(doc)
                comps.append(comp)
                texts.append(text or b"")
    if len(ids) > 1:
        yield from close()


def _exact(members: DataFrame, block_bytes: int) -> DataFrame:
    """Links (a, b) among members (cluster, doc, comp, t) of each cluster."""
    sizes = members.groupBy("cluster").agg(F.ceil(F.sum(F.length("t") + 200) / block_bytes).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    rows = members.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.when(F.col("blocks") <= 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    rows = rows.select("cluster", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "doc", "comp", "t")
    width = shuffle_width(members.sparkSession)
    return rows.repartition(width, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "doc").mapInArrow(trimmed(_join_groups), "a long, b long")


def link_components(docs: DataFrame, block_bytes: int = 12 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id for every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    rows = every.where("id is not null")
    order = spark.sparkContext.broadcast(common_ngrams(rows))
    width = shuffle_width(spark)

    local = rows.mapInArrow(trimmed(_local(order)), ROW).repartition(max(1, width // WIDE), "kind", "key").sortWithinPartitions("kind", "key", "value")
    found = publish(local.mapInArrow(trimmed(_ties), MET), "ngram-ties")
    of = lambda kind, a, b: found.where(F.col("kind") == kind).select(F.col("key").alias(a), F.col("value").alias(b))
    member = of(MEMBER, "id", "comp")

    n = F.col("n")
    shares = found.where(F.col("kind") == TIE).groupBy(F.col("key").alias("comp")).agg(F.sum("n").alias("keys"))
    many = member.select("comp").distinct().withColumn("many", F.lit(True))
    held = shares.join(of(SIZE, "comp", "n").distinct(), "comp").join(many, "comp", "left")
    stays = publish(held.where(F.col("many") | (F.col("keys") > F.floor(n * SLACK / 100))).select("comp").distinct(), "ngram-stays")
    every_tie = publish(of(TIE, "a", "b").where("a <> b").distinct(), "ngram-distinct-ties")  # written, as Catalyst moves a semi-join below distinct
    ties = every_tie.join(stays, F.col("a") == F.col("comp"), "left_semi")

    def cluster(ties: DataFrame, label: str) -> DataFrame:
        return publish(components(ties, label).select(F.col("node").alias("comp"), F.col("root").alias("cluster")), label)

    clusters = cluster(ties, "ngram-clusters").join(stays, "comp", "left_semi")
    wanted = clusters.join(member, "comp").select("id", "comp", "cluster").union(clusters.select(F.col("comp").alias("id"), "comp", "cluster"))
    members = publish(wanted.join(rows, "id").select(F.col("id").alias("doc"), "comp", "cluster", "t"), "ngram-members")

    first = publish(_exact(members.where("doc = comp"), block_bytes), "ngram-links")
    roots = components(first, "ngram-round1")
    named = lambda df: df.join(roots, F.col("comp") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "comp")).drop("node", "root")
    rooted = ties
    for end in ("a", "b"):
        rooted = named(rooted.withColumnRenamed(end, "comp")).withColumnRenamed("comp", end)
    again = cluster(rooted, "ngram-again")
    rest = named(members.drop("cluster")).join(again, "comp").select("cluster", "doc", "comp", "t")
    second = _exact(rest, block_bytes)

    links = first.union(second).union(of(MEMBER, "a", "b")).union(of(COPY, "a", "b"))
    final = components(links, "ngram-final")
    out = of(SIZE, "id", "n_shingles").join(final, F.col("id") == F.col("node"), "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("root", "id").alias("component_id"))

    def count_only(batches):
        for ids, texts in _slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets_of(texts)], pa.int64()), pa.nulls(len(ids), pa.int64())], [id_col, "n_shingles", "component_id"])

    return out.unionByName(every.where("id is null").mapInArrow(count_only, f"{id_col} long, n_shingles long, component_id long"))
