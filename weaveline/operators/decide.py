"""Selection of matches from scored pairs (s1, cand, p), its metric, tuning and analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calibrate(p: Column, a: float | Column = 1.0, b: float | Column = 0.0) -> Column:
    p = F.greatest(F.lit(1e-7), F.least(p, F.lit(1 - 1e-7)))
    return 1 / (1 + F.exp(-((a if isinstance(a, Column) else F.lit(a)) * F.log(p / (1 - p)) + (b if isinstance(b, Column) else F.lit(b)))))


def one_owner(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each candidate stays with its best S1, ties to the smallest."""
    best = Window.partitionBy(*by, "cand").orderBy(F.desc("p"), "s1")
    return scored.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def threshold(scored: DataFrame, least: float) -> DataFrame:
    return one_owner(scored).where(F.col("p") >= least)


def expected_f(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One owner, then the prefix of each S1's candidates with the greatest expected F0.5, if that beats the empty set."""
    group = Window.partitionBy(*by, "s1")
    down = group.orderBy(F.desc("p"), "cand")
    run = one_owner(scored, by).withColumn("k", F.row_number().over(down)).withColumn("cum", F.sum("p").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("ef", 1.25 * F.col("cum") / (0.25 * F.sum("p").over(group) + F.col("k"))).withColumn("none", F.exp(F.sum(F.log1p(-F.col("p"))).over(group)))
    run = run.withColumn("best", F.max("ef").over(group)).withColumn("upto", F.min(F.when(F.col("ef") == F.col("best"), F.col("k"))).over(group))
    return run.where((F.col("k") <= F.col("upto")) & (F.col("best") > F.col("none"))).select(*by, "s1", "cand")


def _f05(tp: Column, found: Column, true: Column) -> Column:
    p, r = tp / F.greatest(found, F.lit(1)), tp / F.greatest(true, F.lit(1))
    return F.when((found == 0) & (true == 0), 1.0).when(tp == 0, 0.0).otherwise(1.25 * p * r / F.greatest(0.25 * p + r, F.lit(1e-12)))


def f05(pred: DataFrame, truth: DataFrame, ids: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """F0.5 of every S1 in ids (with the columns of `by`); 1 where there is nothing to find and nothing found."""
    key = [*by, "s1"]
    hits = pred.join(truth, ["s1", "cand"]).groupBy(*key).agg(F.count("*").alias("tp"))
    np_, nt = pred.groupBy(*key).agg(F.count("*").alias("np")), truth.groupBy("s1").agg(F.count("*").alias("nt"))
    out = ids.join(hits, key, "left").join(np_, key, "left").join(nt, "s1", "left").na.fill(0, ["tp", "np", "nt"])
    return out.select(*ids.columns, "tp", "np", "nt", _f05(F.col("tp"), F.col("np"), F.col("nt")).alias("f"))


def report(scores: DataFrame, country: str = "country") -> DataFrame:
    """Macro F overall, by country, and by whether there is anything to find: rows (part, n, f)."""
    parts = [F.lit("all"), F.concat(F.lit("country "), F.col(country)), F.when(F.col("nt") == 0, "singleton").otherwise("non-singleton")]
    return scores.select(F.explode(F.array(*parts)).alias("part"), "f").groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg("f"), 5).alias("f"))


def tune(scored: DataFrame, truth: DataFrame, ids: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """Macro F of each (a, b) of the grid, all in one job: rows (a, b, f).

    A calibration with a > 0 keeps the order of the scores, so owners are found and candidates ranked once. The grid is
    spread over the S1s, each with its ranked scores, and needs no shuffle but the last one's partial means.
    """
    if any(a <= 0 for a, _ in grid):
        raise ValueError("a calibration that turns the order of scores is not tuned")
    own = one_owner(scored.withColumn("p", _clip("p"))).join(truth.select("s1", "cand", F.lit(1).alias("hit")), ["s1", "cand"], "left")
    ranked = own.groupBy("s1").agg(F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("back"), "cand", F.coalesce("hit", F.lit(0)).alias("hit")))).alias("ranked"))
    nt = truth.groupBy("s1").agg(F.count("*").alias("nt"))
    rows = ids.join(ranked, "s1", "left").join(nt, "s1", "left")
    points = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in grid])
    rows = rows.select(F.coalesce("nt", F.lit(0)).alias("nt"), F.coalesce("ranked", F.expr("CAST(array() AS array<struct<back: double, cand: bigint, hit: int>>)")).alias("ranked"), F.explode(points).alias("at"))
    rows = rows.select("nt", "at.a", "at.b", "ranked", F.transform("ranked", lambda x: calibrate(-x["back"], F.col("at.a"), F.col("at.b"))).alias("q"))
    total = F.aggregate("q", F.lit(0.0), lambda s, x: s + x)
    none = F.exp(F.aggregate("q", F.lit(0.0), lambda s, x: s + F.log1p(-x)))
    rows = rows.withColumn("total", total).withColumn("none", none)

    def step(s: Column, i: Column) -> Column:
        k, cum, tp = i + 1, s["cum"] + F.get("q", i), s["tp"] + F.get("ranked", i)["hit"]
        ef = 1.25 * cum / (0.25 * F.col("total") + k)
        return F.when(ef > s["best"], F.struct(cum.alias("cum"), tp.alias("tp"), ef.alias("best"), k.alias("np"), tp.alias("hits"))).otherwise(F.struct(cum.alias("cum"), tp.alias("tp"), s["best"].alias("best"), s["np"].alias("np"), s["hits"].alias("hits")))

    start = F.struct(F.lit(0.0).alias("cum"), F.lit(0).alias("tp"), F.lit(-1.0).alias("best"), F.lit(0).alias("np"), F.lit(0).alias("hits"))
    rows = rows.select("a", "b", "nt", "none", F.when(F.size("q") > 0, F.aggregate(F.sequence(F.lit(0), F.size("q") - 1), start, step)).otherwise(start).alias("s"))
    takes = F.col("s.best") > F.col("none")
    rows = rows.select("a", "b", "nt", F.when(takes, F.col("s.np")).otherwise(0).alias("np"), F.when(takes, F.col("s.hits")).otherwise(0).alias("tp"))
    return rows.groupBy("a", "b").agg(F.avg(_f05(F.col("tp"), F.col("np"), F.col("nt"))).alias("f"))


def tune_thresholds(scored: DataFrame, truth: DataFrame, ids: DataFrame, grid: list[float]) -> DataFrame:
    """Macro F of each threshold of the grid, all in one job: rows (thr, f). Owners are found once; an S1 carries its scores."""
    own = one_owner(scored).join(truth.select("s1", "cand", F.lit(1).alias("hit")), ["s1", "cand"], "left")
    lists = own.groupBy("s1").agg(F.collect_list("p").alias("ps"), F.collect_list(F.when(F.col("hit") == 1, F.col("p"))).alias("hits"))
    rows = ids.join(lists, "s1", "left").join(truth.groupBy("s1").agg(F.count("*").alias("nt")), "s1", "left")
    rows = rows.select("ps", "hits", F.coalesce("nt", F.lit(0)).alias("nt"), F.explode(F.array(*map(F.lit, grid))).alias("thr"))
    at_least = lambda c: F.coalesce(F.size(F.filter(c, lambda p: p >= F.col("thr"))), F.lit(0))
    rows = rows.select("thr", "nt", F.when(F.col("ps").isNotNull(), at_least("ps")).otherwise(0).alias("np"), F.when(F.col("hits").isNotNull(), at_least("hits")).otherwise(0).alias("tp"))
    return rows.groupBy("thr").agg(F.avg(_f05(F.col("tp"), F.col("np"), F.col("nt"))).alias("f"))


def errors(pred: DataFrame, truth: DataFrame, scored: DataFrame, rec: DataFrame, most: int = 500) -> DataFrame:
    """The report of errors: the first `most` of each kind with score and both sides' names and addresses (rec: id, nf, af)."""
    part = lambda kind, a, b: a.join(b, ["s1", "cand"], "left_anti").orderBy("s1", "cand").limit(most).select(F.lit(kind).alias("kind"), "s1", "cand")
    out = part("fp", pred, truth).union(part("fn", truth, pred)).join(scored.select("s1", "cand", "p"), ["s1", "cand"], "left")
    for side in ("s1", "cand"):
        out = out.join(rec.select(F.col("id").alias(side), F.col("nf").alias(f"{side}_name"), F.col("af").alias(f"{side}_addr")), side, "left")
    return out.select("kind", "s1", "cand", "p", "s1_name", "s1_addr", "cand_name", "cand_addr")


def ensemble(models: DataFrame) -> DataFrame:
    """(s1, cand, p): sigmoid of the mean logit over a pair's rows."""
    return models.groupBy("s1", "cand").agg(F.avg(F.log(_clip("p") / (1 - _clip("p")))).alias("z")).select("s1", "cand", (1 / (1 + F.exp(-F.col("z")))).alias("p"))


def _clip(c: str) -> Column:
    return F.greatest(F.lit(1e-7), F.least(F.col(c), F.lit(1 - 1e-7)))


def compose(base: DataFrame, other: DataFrame, countries: DataFrame, add_in: list[str], drop_in: list[str]) -> DataFrame:
    """base with other's extra pairs in some countries (records already owned skipped) and its own extra pairs taken out in others."""
    of = lambda df: df.join(countries, "s1")
    removed = of(base.join(other, ["s1", "cand"], "left_anti")).where(F.col("country").isin(drop_in)).select("s1", "cand")
    kept = base.join(removed, ["s1", "cand"], "left_anti")
    added = of(other.join(base, ["s1", "cand"], "left_anti")).where(F.col("country").isin(add_in)).select("s1", "cand")
    return kept.unionByName(added.join(kept.select("cand"), "cand", "left_anti").select("s1", "cand"))


def confidence_edits(base: DataFrame, scored: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Drop pairs scored under low; add pairs scored above high whose record nobody owns."""
    kept = base.join(scored.where(F.col("p") < low), ["s1", "cand"], "left_anti")
    added = one_owner(scored.where(F.col("p") > high)).join(base.select("cand"), "cand", "left_anti").select("s1", "cand")
    return kept.unionByName(added)


def loss(pred: DataFrame, truth: DataFrame, cands: DataFrame, ids: DataFrame) -> DataFrame:
    """Macro F as it is, without false positives, with the missed candidates, with all truth: rows (edit, f)."""
    inside = truth.join(cands, ["s1", "cand"], "left_semi").select("s1", "cand")
    edits = {"as is": pred, "no false positives": pred.join(truth, ["s1", "cand"], "left_semi"), "with candidates": pred.union(inside).distinct(), "with all truth": pred.union(truth.select("s1", "cand")).distinct()}
    out = None
    for name, p in edits.items():
        row = f05(p, truth, ids).agg(F.round(F.avg("f"), 6).alias("f")).select(F.lit(name).alias("edit"), "f")
        out = row if out is None else out.union(row)
    return out
