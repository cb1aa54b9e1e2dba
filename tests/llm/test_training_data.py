"""Training-data operators against brute force on small tables, with the edge cases of their docstrings."""

import collections
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from weaveline.llm.chain_dedup import Fenwick, _runs, align, chain, common, fuzzy_passages, passage_links, passages
from weaveline.llm.decontaminate import contaminated
from weaveline.llm.exact_dedup import Chain, Directory, exact_groups, keep_one
from weaveline.llm.html_text import extract_pages, main_text
from weaveline.llm.language_id import identify
from weaveline.llm.ngram_join import SIZE, SLACK, TIE, Order, _ties, key_prefix, link_components, sent_length
from weaveline.llm.piece_codec import Encoder, coder_of, decode_documents, encode_documents, merge_pieces
from weaveline.llm.piece_model import vocabulary
from weaveline.llm.prefix_tree import join_block
from weaveline.llm.queries import piece_model
from weaveline.llm.shared import trimmed
from weaveline.llm.suffix_dedup import remove_repeats, repeated_windows
from weaveline.llm.token_counts import Counter, count_tokens
from weaveline.llm.url_filter import RULES, judge_urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = random.Random(11)
VOCAB = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 6))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(text, k, rng=RNG):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = "x" + rng.choice(VOCAB)
    return " ".join(w)


def corpus():
    base = [prose(n) for n in (3, 8, 40, 120, 300, 900)]
    texts = [None, "", "   ", "\n\t", "one", "One", "éa ÉA", *base, *base, base[3].upper()]
    texts += [edited(b, k) for b in base[2:] for k in (1, 2, 4, 9, 30)] * 2
    passage = prose(90)
    texts += [f"{prose(40)} {passage} {prose(30)}" for _ in range(12)] + ["a " * 700, "a" * 900, prose(6000)]
    RNG.shuffle(texts)
    return [(i, t, ("en", "fr", None)[i % 3], f"s{i % 2}", 0) for i, t in enumerate(texts)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns whose names clash with results.
    return spark.createDataFrame(ROWS, DOCS).repartition(5).withColumn("kept", F.lit("x")).withColumn("n_tokens", F.lit(1)).withColumn("key", F.lit(2)).withColumn("id", F.lit(3))


def null_rows(spark):
    return spark.createDataFrame([(None, None, None, None, None), (None, "b c", None, None, None), (1, "b c", None, None, None), (1, "b c", "en", None, None)], DOCS)


def test_exact(spark, docs):
    by = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        by[(t or "").translate(AZ)].append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in by.items() for i in g}
    for options in ({}, {"bucket_bytes": 50}):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(docs, **options).collect()}
        assert got == want
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == sorted(max(g) for g in by.values())
    assert keep_one(docs).columns == docs.columns
    assert keep_one(null_rows(spark)).count() == 2
    assert exact_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_slices_by_bytes():
    from weaveline.llm.shared import by_bytes

    batch = pa.record_batch({"t": pa.array(["", None, "abc", "d" * 50, "e", "ff"])})
    for most in (1, 3, 20, 99):
        parts = list(by_bytes(batch, 0, most))
        assert sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist()
        assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= most for p in parts)
    assert list(by_bytes(batch.slice(0, 0), 0, 9)) == []


def test_directory_and_chain():
    d = Directory()
    a, b = d.split((0, 0))
    d.split(b)
    assert d.depth == 2 and d.buckets() == [(0, 1), (2, 2), (3, 2)] and d.slots[:2] == [(0, 1)] * 2
    c = Chain()
    for text, i in ((b"x", 1), (b"y", 5), (b"x", None), (b"x", 3), (b"x", 3)):
        c.add(text, i, 1, 1)
    assert c.entries == [[b"x", 3, 4, 2], [b"y", 5, 1, 1]]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


STRANGE = ["a", "e", "th", "the", " ", "  ", "\n", "é", "▁", "日本", "🙂", "<s>", "<0x0A>", "tion", "    ", "\t", "\x00", "ﬁ", "aaaa"]


def test_pieces(library):
    vocab = vocabulary(piece_model())
    count, coder = Counter(vocab, 9000), Encoder(vocab, 30_000)
    for _ in range(1500):
        text = "".join(RNG.choice(STRANGE) for _ in range(RNG.randint(0, 40)))
        ids = library.encode(text)
        assert count(text.encode()) == len(ids)
        assert np.frombuffer(coder.encode(text.encode()), np.int32).tolist() == ids
        assert coder.decode(ids).decode() == library.decode(ids)
    long = "".join(RNG.choice("abcdefghtionre") for _ in range(5000))
    assert np.frombuffer(coder.encode(long.encode()), np.int32).tolist() == library.encode(long)


def test_token_queries(spark, docs, library):
    want = {i: library.encode(t or "") for i, t, *_ in ROWS}
    for r in count_tokens(docs, piece_model(), limit=100).collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((ROWS[r.doc_id][1] or "").encode()), len(want[r.doc_id]), len(want[r.doc_id]) > 100)
    out = encode_documents(docs, piece_model())
    assert {r.doc_id: list(r.ids) for r in out.collect()} == want and out.where("not round_trip").count() == 0
    assert all(r.text == (ROWS[r.doc_id][1] or "") for r in decode_documents(out, piece_model()).collect())
    assert count_tokens(null_rows(spark), piece_model()).count() == encode_documents(null_rows(spark), piece_model()).count() == 4
    assert count_tokens(spark.createDataFrame([], DOCS), piece_model()).count() == 0


def test_urls(spark):
    cases = [
        ("http://A.Example.com/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://example.com/fr", "example.com", "/fr", "com/", "allow"), ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"), ("http://x.net/es", "x.net", "/es", None, "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"), ("a://b://c.net/fr/", "b:", "//c.net/fr/", None, "allow"), ("http://com?x", "com", "", None, "allow"), ("", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "t") for i, c in enumerate(cases)] * 2, "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = judge_urls(pages, rules).collect()
    assert len(got) == 2 * len(cases) and all(tuple(r)[1:] == cases[r.page_id][1:] for r in got)
    assert judge_urls(pages, rules.limit(0)).where("rule is null and verdict = 'allow'").count() == 2 * len(cases)


def test_html(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>home</a></nav><div class='ad'>Buy now, it is cheap and good for you all.</div><article><h1>Old&amp;new</h1><p><b>First  <i>pa</i>rt.<br>more<p>Of.</p><script>if (a<b) track('</p>')</script></article><aside><p>Most read stories of the week, in a long line of many words here.</p></aside><section class=comments><p>I liked this one very much, thank you all for it.</p></section><footer>&copy; all</footer>"
    assert main_text(page) == "Old&new First part. more Of."
    assert main_text(None) == main_text("") == main_text("<p></p><!-- x") == ""
    got = extract_pages(spark.createDataFrame([(1, None, None), (1, "u", page), (None, "u", "")], "page_id long, url string, html string")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 28]


def test_html_tree():
    from weaveline.llm import html_text, html_training

    x, y = html_text.labelled(html_training.pages(200, seed=99))  # held out: another seed
    tree = html_text.trained()
    got = tree.predict(x) >= 0.5
    right = x[:, 0] * (got & (y == 1))
    f1 = 2 * right.sum() / ((x[:, 0] * got).sum() + (x[:, 0] * y).sum())
    bare = x[:, 6] == 0.5
    right_bare = 2 * (right[bare]).sum() / ((x[:, 0] * got)[bare].sum() + (x[:, 0] * y)[bare].sum())
    splits = collections.Counter(tree.splits())
    print(f1, right_bare, splits)
    text = sum(n for k, n in splits.items() if k.startswith(("words", "links")))
    assert f1 > 0.98 and right_bare > 0.95
    assert text > sum(splits.values()) / 2 and any(splits[k] for k in ("words_before", "links_before")) and any(splits[k] for k in ("words_behind", "links_behind"))


def test_html_names_do_not_decide():
    body = "<p>The council agreed on Monday to repair the old bridge over the river.</p><p>Nobody objected.</p><p>Work will begin in spring and last until autumn, said the mayor.</p>"
    want = "The council agreed on Monday to repair the old bridge over the river. Nobody objected. Work will begin in spring and last until autumn, said the mayor."
    for tag, name in (("article", "post social-policy"), ("article", "comment"), ("main", "sidebar")):
        assert main_text(f"<nav><a href=x>home</a></nav><{tag} class='{name}'>{body}</{tag}><footer>all rights</footer>") == want
    assert main_text(f"<nav><ul><li><a href=x>home</a><li><a href=y>away</a></ul></nav><article><div class='article-related-law'>{body}</div></article><footer>all rights</footer>") == want


def article_of(page):
    """The article of a page of the tables' shape, by its markup."""
    import html
    import re

    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(" ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner) if x.strip())


def test_html_of_the_tables(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article_of(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in extract_pages(pages).collect()} == want
    assert extract_pages(pages.limit(0).withColumn("text", F.lit(1)).withColumn("id", F.lit(2))).count() == 0


def test_language(spark):
    words = {"en": "the and of that with for this ing", "fr": "le la les des que pour est une", "de": "der die und das ist nicht ein schon"}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(30)), lang, "s", 0) for i in range(300) for lang in [("en", "fr", "de")[i % 3]]]
    rows += [(1000, None, "en", None, None), (1001, "12 3!", None, None, None), (1002, "", "fr", None, None)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows)
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang, *_ in rows[:300])
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1001].score == 0
    assert {r.lang_pred for r in identify(spark.createDataFrame([(1, "abc", None, None, None)], DOCS)).collect()} == {"und"}
    assert identify(spark.createDataFrame([], DOCS)).count() == 0


def test_language_of_long_texts():
    from weaveline.llm import language_id as L

    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab \xc3\xa9z") for _ in range(n)) for n in (0, 1, 99, 100, 101, 102, 350, 5)]
    whole = sorted(zip(*(x.tolist() for x in L.grams(texts))))
    piece, L.PIECE = L.PIECE, 100
    try:
        parts = [p for who, code in L.grams_in_pieces(texts) for p in zip(who.tolist(), code.tolist())]
        assert set(parts) == set(whole)  # an n-gram at a cut may come twice
        assert L.has_letter("é".encode() * 99) and not L.has_letter(b"\xe2\x82\xac" * 99)
    finally:
        L.PIECE = piece
    long = ("the and of that " * 70_000).encode()
    kernel = L.Kernel.fit([b"the and of that", b"der die und das"], ["en", "de"])
    assert len(long) > L.PIECE and np.allclose(kernel.score([long, b"the and of that the"]), kernel.score([b"the and of that the"] * 2), atol=1e-6)


def test_words_of_long_texts(monkeypatch):
    from weaveline.llm import word_sets

    texts = [(t or "").encode() for _, t, *_ in ROWS] + [b"x" * 3000, b" " * 900]
    whole = word_sets.words_of(texts)
    monkeypatch.setattr(word_sets, "PIECE", 500)
    assert all((a == b).all() for a, b in zip(whole, word_sets.words_of(texts)))


def shingle_set(text):
    w = [x for x in (text or "").translate(AZ).replace("\n", " ").replace("\t", " ").split(" ") if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if o and 100 * o >= 80 * (len(a) + len(sets[j]) - o):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def brute_groups(n, pairs):
    """For each of n nodes the smallest that it hangs together with."""
    root = list(range(n))
    for a, b in pairs:
        x, y = sorted((root[a], root[b]))
        root = [x if r == y else r for r in root]
    return root


def test_ngram_keys_meet_within_the_prefix():
    rng = np.random.default_rng(5)
    order = Order(rng.integers(1, 2**63, 50, np.uint64))
    met = 0
    for _ in range(4000):
        n = int(rng.integers(1, 120))
        pool = np.concatenate([order.common[: rng.integers(0, 40)], rng.integers(1, 2**63, n, np.uint64)])
        x = np.unique(pool)
        y = np.unique(np.concatenate([x[rng.random(len(x)) > rng.choice([0, 0.05, 0.1, 0.2])], rng.integers(1, 2**63, int(rng.integers(0, 1 + len(x) // 4)), np.uint64)]))
        same = len(np.intersect1d(x, y))
        if 5 * same < 4 * (len(x) + len(y) - same):
            continue
        met += 1
        kx, ky = (order.first_keys(s, key_prefix(len(s))) for s in (x, y))
        assert len(np.intersect1d(kx, ky)) > 0
        kx, ky = (order.first_keys(s, sent_length(len(s))) for s in (x, y))
        assert len(np.intersect1d(kx, ky)) > max(len(x), len(y)) * SLACK // 100
    assert met > 500


@pytest.mark.parametrize("size,kept", [(1, 1), (3, 4), (1000, 1 << 20)])
def test_ngram_ties(monkeypatch, size, kept):
    monkeypatch.setattr("weaveline.llm.ngram_join.TIES_HELD", kept)
    rng = np.random.default_rng(size)
    rows = sorted({(int(k), int(v)) for k, v in zip(rng.integers(0, 40, 150), rng.integers(0, 12, 150))})
    holders: dict = {}
    for k, v in rows:
        holders.setdefault(k, []).append(v)
    shares = collections.Counter(v for vs in holders.values() if len(vs) > 1 for v in vs)
    table = pa.table({"kind": pa.array([TIE] * len(rows) + [SIZE], pa.int32()), "key": [k for k, _ in rows] + [7], "value": [v for _, v in rows] + [9]})
    out = [r for b in _ties(table.to_batches(max_chunksize=size)) for r in b.to_pylist()]
    told = [r for r in out if r["kind"] == TIE]
    assert kept < 12 or len(told) == len(shares)  # once each
    join = lambda pairs: brute_groups(12, pairs)
    assert join((r["key"], r["value"]) for r in told) == join((v, vs[0]) for vs in holders.values() for v in vs)
    got: collections.Counter = collections.Counter()
    for r in told:
        got[r["key"]] += r["n"]
    assert got == shares
    assert [(r["key"], r["value"]) for r in out if r["kind"] == SIZE] == [(7, 9)]


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    from weaveline.llm.components import components

    rng = random.Random(2)
    edges = {"path": [(k, k + 1) for k in range(40)], "star": [(39, k) for k in range(39)], "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], "none": [(3, 3)]}[shape]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_groups(60, edges)
    assert got == {n: want[n] for a, b in edges if a != b for n in (a, b)}


def test_ngram_join(spark, docs):
    sets = [shingle_set(t) for _, t, *_ in ROWS]
    want = brute_components(sets)
    for size in (24 << 20, 20_000):  # one block, and many pairs of blocks
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in link_components(docs, block_bytes=size).collect()}
        assert got == {i: (len(sets[i]), want[i]) for i in range(len(sets))}
    nulls = link_components(null_rows(spark)).collect()
    assert len(nulls) == 4 and sum(r.component_id is None for r in nulls) == 2
    assert link_components(spark.createDataFrame([], DOCS)).count() == 0


def test_join_block():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 1 << 62, n)).astype(np.uint64) for n in (1, 5, 9, 10, 40, 200)]
    sets = []
    for _ in range(150):
        s = base[rng.integers(len(base))].copy()
        k = rng.integers(0, max(1, len(s) // 5) + 1)
        s[rng.choice(len(s), min(k, len(s)), replace=False)] = rng.integers(0, 1 << 62, min(k, len(s))).astype(np.uint64)
        sets.append(np.unique(s))
    assert join_block(sets) == brute_components([frozenset(s.tolist()) for s in sets])


def test_join_block_memory():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, (25, 4000)).astype(np.uint64)
    make = lambda: [np.unique(np.append(base[i % 25, 40:], rng.integers(0, 1 << 62, 40).astype(np.uint64))) for i in range(200)]
    tracemalloc.start()
    try:
        label = join_block(make())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert label == [i % 25 for i in range(200)]
    assert peak < 50 * 200 * 4000


def test_other_operators_drop_what_the_codec_keeps():
    coder_of(piece_model()).encode(b"some text")
    assert list(trimmed(lambda batches: batches)(iter([1]))) == [1]
    assert coder_of.cache_info().currsize == 0


def brute_repeats(rows, length):
    seen = collections.Counter(b[s : s + length] for _, b in rows for s in range(len(b) - length + 1))
    out = {}
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        runs = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_repeats(spark, docs):
    want = brute_repeats([(i, (t or "").encode()) for i, t, *_ in ROWS], 400)
    assert sum(w[1] for w in want.values()) > 10_000
    assert {r.doc_id: tuple(r)[1:] for r in remove_repeats(docs).collect()} == want
    assert remove_repeats(null_rows(spark)).count() == 4
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_repeats_but_the_first(spark, docs):
    seen, want = set(), {}
    for i, t, *_ in sorted(ROWS):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 399):
            if b[s : s + 400] in seen:
                gone[s : s + 400] = b"\1" * 400
            seen.add(b[s : s + 400])
        want[i] = bytes(x for x, g in zip(b, gone) if not g)
    got = {r.doc_id: bytes(r.kept) for r in remove_repeats(docs, keep_first=True, with_text=True).collect()}
    assert got == want and sum(map(len, want.values())) < sum(len((t or "").encode()) for _, t, *_ in ROWS)


def test_repeated_windows():
    strings = [bytes(RNG.choice(b"ab") for _ in range(60)) for _ in range(6)]
    strings.append(strings[0][5:40] + b"zz" + strings[1][:30])
    masks = repeated_windows([strings, [strings[0]]], 12, False)
    first = repeated_windows([strings], 12, True)[0]
    seen = collections.Counter(s[k : k + 12] for s in strings for k in range(len(s) - 11))
    met = set()
    for s, mask, late in zip(strings, masks[0], first):
        for k in range(len(s) - 11):
            assert mask[k] == (seen[s[k : k + 12]] > 1) and late[k] == (s[k : k + 12] in met)
            met.add(s[k : k + 12])
    assert len(masks[1][0]) == 49


def test_decontamination(spark, docs):
    items = [(1, prose(20)), (2, prose(45)), (3, None), (4, ""), (5, prose(3)), (6, "Alpha beta gamma delta " + prose(16))]
    rows = [(0, prose(50) + " " + items[0][1].upper() + " " + prose(9)), (1, edited(items[1][1], 1)), (2, prose(80)), (3, None), (4, items[4][1]), (5, items[5][1] + "\n" + items[0][1]), (5, items[5][1]), (None, items[0][1])]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = contaminated(frame, spark.createDataFrame([*items, (9, items[0][1])], "item_id long, text string")).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert {(0, 1), (4, 5), (5, 6), (5, 1), (None, 1)} <= pairs <= {(0, 1), (1, 2), (4, 5), (5, 6), (5, 1), (None, 1)}
    assert len(got) == len(pairs) and all(0.8 <= r.similarity <= 1 for r in got)
    assert contaminated(frame, spark.createDataFrame(items[2:4], "item_id long, text string")).count() == 0


def test_decontamination_against_all_windows(spark):
    """Items of 5 to 40 words, edited to about the threshold, against the similarity of every window."""
    rng = random.Random(21)
    items = [(k, prose(rng.randint(5, 40), rng)) for k in range(60)]
    rows = []
    for k, item in items:
        for edits in (0, 1, 1, 2):
            rows.append((len(rows), f"{prose(rng.randint(0, 20), rng)} {edited(item, edits, rng)} {prose(rng.randint(0, 20), rng)}".strip()))

    def weights(w):
        return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])

    want = set()
    for i, t in rows:
        w = t.lower().split()
        for k, item in items:
            b = item.lower().split()
            for at in range(len(w) - len(b) + 1):
                x, y = weights(w[at : at + len(b)]), weights(b)
                if 5 * sum((x & y).values()) >= 4 * sum((x | y).values()):
                    want.add((i, k))
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).withColumn("item", F.lit(1)).withColumn("m", F.lit(2))
    got = {(r.doc_id, r.item_id) for r in contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 60 and got == want
    assert contaminated(frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontamination_of_short_items(spark):
    items = [(k, " ".join(f"q{k}{i}" for i in range(k))) for k in (1, 2, 3, 4)]
    rows = [(k, f"{prose(20)} {item.upper()} {prose(7)}") for k, item in items] + [(5, f"{items[2][1]} x"), (6, "q40 q41 q43 q42 y"), (7, f"{items[1][1]} {prose(5)} {items[1][1]}"), (8, items[3][1])]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = {(r.doc_id, r.item_id, r.start_word, r.n_words, r.similarity, r.n_windows) for r in contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k, 20, k, 1.0, 1) for k in (1, 2, 3, 4)} | {(5, 3, 0, 3, 1.0, 1), (7, 2, 0, 2, 1.0, 2), (8, 4, 0, 4, 1.0, 1)}


def test_fuzzy_passages(spark, docs):
    got = fuzzy_passages(docs).collect()
    first, need = {}, set()
    for i, t, *_ in ROWS:
        w = (t or "").translate(AZ).split()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) != i:
                need.add(i)
    assert need and need <= {r.doc_id for r in got}
    sets = [shingle_set(t) for _, t, *_ in ROWS]
    assert all(r.source_id < r.doc_id and r.n_words >= 50 and r.similarity >= 0.8 and sets[r.doc_id] & sets[r.source_id] for r in got)
    assert fuzzy_passages(null_rows(spark)).count() == 0
    assert fuzzy_passages(spark.createDataFrame([], DOCS)).count() == 0


def test_alignment():
    def longest(a, b):
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
        return size[-1][-1]

    rng = random.Random(5)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in range(2))
        assert len(common(a, b)) == longest(a, b)
        for pairs in (common(a, b), *(align(a, b, block) for block in (1, 2, 5, 1024))):
            assert all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_chain():
    rng, tree, put = random.Random(6), Fenwick(9), []
    for time in range(200):
        put.append((rng.randrange(9), time // 3, (rng.random(), time)))
        tree.put(*put[-1])
        place, since = rng.randrange(10), time // 3 - 8
        assert tree.best(place, since) == max([v for p, t, v in put if p < place and t >= since], default=(-1e18, -1))
    line = [(k * 6, 100 + k * 6) for k in range(8)]
    found = chain([*line, (20, 900), (300, 110)])
    assert [line.index((k * 6, 100 + k * 6)) for k in range(8)] == found[0]


def test_chain_after_a_long_gap():
    matches = [(k, k) for k in (*range(0, 500, 7), *range(560, 960, 7))]
    found = sorted([matches[i] for i in path] for path in chain(matches))
    assert found == [matches[:72], matches[72:]]


def test_chains_against_all_predecessors():
    from weaveline.llm.chain_dedup import GAP_COST, MAX_GAP, chain_runs

    rng = random.Random(9)
    for _ in range(300):
        runs = []
        for _ in range(rng.randrange(1, 12)):
            x, y, n = rng.randrange(120), rng.randrange(120), rng.randrange(12)
            runs.append((x, y, x + n, y + n, 5.0 + n))
        best: dict[int, float] = {}

        def total(i):
            if i not in best:
                x, y = runs[i][:2]
                before = [total(j) - GAP_COST * (x - u + y - v) / 2 for j, (_, _, u, v, _) in enumerate(runs) if 0 < x - u <= MAX_GAP and 0 < y - v <= MAX_GAP]
                best[i] = runs[i][4] + max([0.0, *before])
            return best[i]

        found = chain_runs(runs)
        gained = sum(runs[i][4] for i in found[0]) - sum(GAP_COST * (runs[j][0] - runs[i][2] + runs[j][1] - runs[i][3]) / 2 for i, j in zip(found[0], found[0][1:]))
        assert gained == pytest.approx(max(map(total, range(len(runs))))) and sorted(sum(found, [])) == list(range(len(runs)))


def test_passages_do_not_depend_on_partitions(spark, docs):
    got = [sorted(map(repr, fuzzy_passages(docs.repartition(n)).collect())) for n in (1, 8, 40)]
    assert got[0] and got[0] == got[1] == got[2]


def test_recall_of_fuzzy_passages(spark):
    rng = random.Random(12)
    rows = []
    for k in range(120):
        p = prose(rng.randint(60, 200), rng).split()
        other = list(p)
        for at in rng.sample(range(len(p)), len(p) * 15 // 100):
            other[at] = "y" + rng.choice(VOCAB)
        rows += [(2 * k, " ".join([prose(30, rng), *p, prose(30, rng)])), (2 * k + 1, " ".join([prose(50, rng), *other, prose(20, rng)]))]
    got = {r.doc_id for r in fuzzy_passages(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)).collect()}
    assert not any(i % 2 == 0 for i in got) and len(got) >= 0.9 * 120


def test_every_passage_of_an_alignment():
    new = iter(range(1000, 10000))

    def text(parts, between):
        words = []
        for k, part in enumerate(parts):
            words += [next(new) for _ in range(between if k else 0)] + part
        return words

    equal = [list(range(k, k + 50)) for k in (0, 100, 200)]
    for parts, between in ((equal[:2], 25), (equal, 20), (equal, 60)):
        a, b = text(parts, between), text(parts, between)
        found = passages(a, b)
        assert all(agree >= 0.8 for *_, agree in found)
        for at in range(0, len(a), 50 + between):
            assert any(i <= at and at + 50 <= i + n and j <= at and at + 50 <= j + m for i, n, j, m, _ in found)
    assert passages([], [1]) == [] and passages(equal[0][:49], equal[0][:49]) == []


def test_passages_of_long_words(spark):
    rng = random.Random(3)

    def long_words(n):
        return ["".join(rng.choice("abcdef") for _ in range(60)) for _ in range(n)]

    rows = []
    for k in range(20):
        shared = long_words(50)
        rows += [(2 * k + i, " ".join(long_words(30) + shared + long_words(30)), None, None, None) for i in range(2)]
    got = {(r.doc_id, r.source_id, r.n_words) for r in fuzzy_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(2 * k + 1, 2 * k, 50) for k in range(20)}


def uncovered(spark, rows):
    """Runs of 50 words that an earlier document holds and no reported span, or spans of one source that meet, cover."""
    spans, first, missing = collections.defaultdict(list), {}, []
    got = fuzzy_passages(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)).collect()
    for r in sorted(got, key=lambda r: (r.doc_id, r.source_id, r.start_byte)):
        span, have = [r.source_id, r.start_byte, r.stop_byte if r.stop_byte is not None else 1 << 60], spans[r.doc_id]
        if have and have[-1][0] == span[0] and span[1] <= have[-1][2] + 1:
            have[-1][2] = max(have[-1][2], span[2])
        else:
            have.append(span)
    for i, t in sorted(rows):
        w, ends = t.split(" "), [-1]
        for x in w:
            ends.append(ends[-1] + 1 + len(x))
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) != i and not any(a <= ends[k] + 1 and ends[k + 50] <= b for _, a, b in spans[i]):
                missing.append((i, k))
    return missing


def test_passages_whose_parts_have_other_holders(spark):
    rng = random.Random(8)
    rows, at = [], 0
    for size in (60, 60, 50, 55, 75):
        p = prose(size, rng).split()
        for part in (p[:30], p[25:], p, p[:30], p[25:], p, p[:40], p[20:], p):
            rows.append((at, " ".join([prose(40, rng), *part, prose(40, rng)])))
            at += 1
    assert uncovered(spark, rows) == []
    again = [(0, "b " * 300 + prose(30, rng)), (1, prose(30, rng) + " b" * 300), (2, prose(9, rng) + " b c d" * 90), (3, "c d b " * 120 + prose(9, rng))]
    assert uncovered(spark, again) == []
    assert 0 < fuzzy_passages(spark.createDataFrame([(i, t, None, None, None) for i, t in again], DOCS)).count() < 30


def test_links_of_all_holders_of_a_passage(spark):
    rng, rows = random.Random(21), []
    for size in (60, 75, 130, 52):
        p = prose(size, rng).split()
        wider = prose(70, rng).split() + p + prose(70, rng).split()
        near = list(wider)
        for at in range(70, 70 + size, 9):
            near[at] = "z" + near[at]
        parts = [p[:30], p[:30], p[25:], p[25:], p, near, wider, wider, p[:51], p, p[-51:], wider[40:130]]
        rows += [" ".join([prose(rng.randint(5, 40), rng), *part, prose(rng.randint(5, 40), rng)]) for part in parts]
    unit = prose(20, rng).split()
    rows += [" ".join([*(unit * n)[cut:], prose(30, rng)]) for n in (4, 9, 30) for cut in (0, 7, 13)] + ["b " * 300 + prose(9, rng), prose(9, rng) + " b" * 90]
    held = collections.defaultdict(set)
    for i, t in enumerate(rows):
        w = t.split()
        for k in range(len(w) - 49):
            held[tuple(w[k : k + 50])].add(i)
    need = {(b, a) for docs in held.values() for a in docs for b in docs if a < b}
    found = fuzzy_passages(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(rows)], DOCS))
    runs = found.where("source_word is not null")
    assert need == {tuple(r) for r in passage_links(runs).collect()} <= {tuple(r) for r in passage_links(found).collect()}
    assert len(need) > 100 and runs.count() < 120


def test_runs_keep_each_place_of_the_source():
    places = [*range(100, 110), *range(40, 60), *range(200, 260), *range(40, 60)]
    rows = [(2, 1, k, k, k + 50, y, y, y + 50) for k, y in enumerate(places)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc", "other", "word", "byte", "stop", "other_word", "other_byte", "other_stop"])
    got = [(r["start"], r["other_word"], r["n_words"]) for part in _runs([batch]) for r in part.to_pylist()]
    assert got == [(0, 100, 59), (10, 40, 69), (30, 200, 109), (90, 40, 69)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    clean = [prose(60) for _ in range(20)]
    item = prose(30)
    texts = [*clean, clean[0].upper(), edited(clean[1], 1), f"{prose(20)} {item} {prose(20)}", None, "123 456"]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept == (set(range(20)) - {0}) | {20}


def test_codec_parts(library):
    """Pieces undone from the last merge on; parts cut, shared prefixes and rows decoded at once."""
    vocab = vocabulary(piece_model())
    coder = Encoder(vocab, 30_000)
    some = [p for p in coder.pieces if len(p) < 4] + coder.pieces[-20:]
    for _ in range(4000):
        a, b = RNG.choice(some), RNG.choice(some)
        assert coder.apart(coder.number[a], coder.number[b]) == (merge_pieces(a + b, vocab) == [a, b]), (a, b)
    texts = ["".join(RNG.choice(STRANGE) for _ in range(RNG.randint(0, 60))) for _ in range(300)] + ["", " ", "▁", "a" * 3000, " " * 3000]
    for piece in (1 << 20, 7):
        coder.PIECE = piece
        assert all("".join(coder.parts(t)) == t and coder.parts(t) == vocab.parts(t) for t in texts if t)
        packed = coder.encode_all([t.encode() for t in texts])
        assert [np.frombuffer(p, np.int32).tolist() for p in packed] == [library.encode(t) for t in texts]
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
    assert coder.decode_all(np.frombuffer(b"".join(packed), np.int32), ends) == [library.decode(library.encode(t)).encode() for t in texts]
    assert coder.decode_all(np.zeros(0, np.int32), np.zeros(2, np.int64)) == [b""]
    assert len(coder.memo) + len(coder.memo.old) < 400
