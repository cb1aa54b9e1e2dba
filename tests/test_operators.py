import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weaveline.functions import normalize as N
from weaveline.functions import strings as S
from weaveline.operators import decide as D
from weaveline.operators import pairs as P
from weaveline.operators import records as R

TEXT = st.text("abc d", max_size=12)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


def test_house_number(spark):
    cases = {"Fl 1, Hillsboro, OR, 4544 Cornell Road": "4544", "393-D LAKE POINTE DR, MIDDLE ISLAND, NY": "393", "No 17 Impasse Scalbert, Lille": "17", "Lille, Nord": "", "": "", "007, 12 Elm St": "12", "№5 Main St": "5", "Plot No. 7-B, Sector 4": "7", "H.No. (12) Lane": "12", "P.O. Box 9 Town, 3 Oak Rd": "3", "#4b, 9 Elm": "9", "# 12 Elm": "12", "Lotus 5 Road": "", "n° 8 rue Bleue": "8", "N 8 Main": "", "No: 5 Main": "", "Улица 5 дом": "", "12": "", "Apt-5 Block, 0012 Rd": "12"}
    rows = spark.createDataFrame(list(cases.items()), "a string, e string").select("a", "e", N.house_number(F.col("a")).alias("h")).collect()
    assert [(r.a, r.h) for r in rows] == [(r.a, r.e) for r in rows]


def test_core_name(spark):
    core = lambda c: F.array_join(N.core_tokens(N.name_tokens(c)[0]), " ")
    assert one(spark, "Ear Nose & Throat P.C.", core) == "ear nose throat"
    assert one(spark, "Group", core) == "group"
    assert one(spark, "www.blue-sky.co.in", core) == "blue sky"
    assert one(spark, None, core) == ""
    full = lambda c: F.array_join(N.name_tokens(c)[0], " ")
    assert one(spark, "Gym/Spa Centre", full) == "gym spa center"
    assert one(spark, "Farm/Shop Ltd", full) == "farm shop limited"
    assert one(spark, "M/S Blue Sky", full) == "blue sky"


def test_joined_numbers(spark):
    text = lambda c: F.array_join(N.joined_numbers(N.address_text(c, F.lit("India"))), " ")
    assert one(spark, "8-2-293/83A, Road No. 44", text) == "8229383a 44"
    words = lambda c: F.array_join(N.address_tokens(N.address_text(c, F.lit("US")), F.lit("US")), " ")
    assert one(spark, "№5 Main St", words) == "5 main street"
    assert one(spark, "5th Ave, <null>, h. no. 3 n/a", words) == "5 avenue 3"


def test_house_relation(spark):
    cases = [("", "", 5), ("12", "", 4), ("12", "12", 0), ("4544", "454", 1), ("100", "150", 2), ("100", "151", 3), ("7", "17", 1)]
    rows = spark.createDataFrame(cases, "a string, b string, e int").select("e", P.house_relation(F.col("a"), F.col("b")).alias("r"), P.house_relation(F.col("b"), F.col("a")).alias("q")).collect()
    assert all(r.e == r.r == r.q for r in rows)


def test_f05(spark):
    ids = spark.createDataFrame([(i,) for i in range(1, 5)], "s1 long")
    pred = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (3, 30)], "s1 long, cand long")
    truth = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "s1 long, cand long")
    got = {r.s1: round(r.f, 3) for r in D.f05(pred, truth, ids).collect()}
    assert got == {1: 0.714, 2: 0.0, 3: 0.0, 4: 1.0}


def test_expected_f(spark):
    rows = [(1, 10, 0.95), (1, 11, 0.9), (1, 12, 0.3), (2, 12, 0.6), (2, 20, 0.02), (3, 30, 0.1)]
    got = {tuple(r) for r in D.expected_f(spark.createDataFrame(rows, "s1 long, cand long, p double")).collect()}
    assert got == {(1, 10), (1, 11), (2, 12)}


def test_ids(spark):
    row = spark.createDataFrame([("S2-17",)], "s string").select(R.id_to_int(F.col("s")).alias("i")).select("i", R.int_to_id(F.col("i")).alias("s")).first()
    assert tuple(row) == (20000000017, "S2-17")


def test_tsv_round_trip(spark, tmp_path):
    from weaveline.sources.tsv import read_pairs, read_tsv, stage, write_tsv

    df = spark.createDataFrame([("S1-1", "S2-5,S3-6"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string")
    write_tsv(df, str(tmp_path / "r"))
    assert sorted(map(tuple, read_tsv(spark, str(tmp_path / "r"), df.columns).collect())) == [("S1-1", "S2-5,S3-6"), ("S1-2", "")]
    assert sorted(r.cand for r in read_pairs(spark, str(tmp_path / "r")).collect()) == [20000000005, 30000000006]
    assert stage(spark, str(tmp_path / "s"), lambda: df).count() == 2
    assert stage(spark, str(tmp_path / "s"), lambda: 1 / 0).count() == 2


def test_lcs_twin(spark):
    rows = [("kitten", "sitting"), ("", "a"), ("abc", ""), ("", ""), ("été", "tee"), ("ab" * 31, "ba" * 40), ("ab" * 40, "bca" * 5), ("abc" * 25, "cab" * 25)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.lcs_column(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == S.lcs(r.a, r.b) for r in got)


def paired(a, b):
    """Definition of the token difference, on lists of distinct tokens."""
    own = lambda x, y: [t for i, t in enumerate(x) if t not in y and t not in x[:i] and len(t) > 1]
    left, free, stay = own(b, a), own(a, b), []
    while left:
        t = left.pop(0)
        fit = max(free, key=lambda m: S.ratio(t, m), default=None)
        if fit is not None and S.ratio(t, fit) >= 70:
            free = [m for m in free if m != fit]
        else:
            stay.append(t)
    return stay, free


def test_token_diff(spark):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    rows = [("north star trading", "north star tradng group"), ("", ""), ("a bb", ""), ("x" * 70 + " y", "x" * 69 + "z yy")]
    rows += [(" ".join(word() for _ in range(rng.randint(0, 6))), " ".join(word() for _ in range(rng.randint(0, 6)))) for _ in range(200)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.token_diff(F.col("a"), F.col("b")).alias("t")).collect()
    assert [(r.t.extra, r.t.missing) for r in got] == [paired(r.a.split(), r.b.split()) for r in got]
    marked = spark.createDataFrame([("blue sky", "acme dba blue sky cafe"), (None, "one")], "a string, b string").select(S.token_diff(F.col("a"), F.col("b")).alias("t")).collect()
    assert [(r.t.extra, r.t.missing) for r in marked] == [(["cafe"], []), (["one"], [])]


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT)
def test_scores(a, b):
    for f in (S.ratio, S.token_sort, S.token_set, S.partial):
        assert 0 <= f(a, b) <= 100
    assert S.ratio(a, a) == 100
    assert S.ratio(a, b) == pytest.approx(S.ratio(b, a))
    assert S.partial(a, b) >= S.ratio(a, b) - 1e-9 or len(a) != len(b)


def test_stream_of_groups(spark, tmp_path):
    from weaveline.streaming.groups import decide_stream

    schema = "s1 long, cand long, p double"
    spark.createDataFrame([(1, 10, 0.95), (1, 12, 0.3)], schema).write.parquet(str(tmp_path / "in"))
    q = decide_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert [(r.s1, r.cand) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, 10)]
