"""Statistics against brute force, with ranges of a few rows, so that all paths across ranges are taken."""

import collections
import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glossmark.operators import stats


@pytest.fixture(params=[5, 50_000])
def ranges(request, monkeypatch):
    monkeypatch.setattr(stats, "RANGE_ROWS", request.param)
    monkeypatch.setattr(stats, "HASH_DIGITS", 1)
    return request.param


def rows_of(kind, n=200, seed=1):
    rng = random.Random(seed)
    value = {"continuous": lambda: rng.gauss(0, 100), "few": lambda: float(rng.randrange(4)), "hot": lambda: 7.0 if rng.random() < 0.5 else rng.gauss(7, 3)}
    a, b = kind.split("-")
    rows = []
    for i in range(n):
        x, y = value[a](), value[b]()
        rows.append((i, None if i % 17 == 3 else x, None if i % 19 == 5 else (y + x if b == "continuous" else y), f"g{rng.randrange(3)}" if i % 7 else None, int(rng.random() < 0.3)))
    return rows


KINDS = ["continuous-continuous", "continuous-few", "hot-continuous", "few-hot", "hot-hot"]
SCHEMA = "id long, x double, y double, g string, bad int"


def ranks(v):
    return pd.Series(v).rank(method="average").to_numpy()


def tau_b(x, y):
    s = tx = ty = 0
    n = len(x)
    for i in range(n):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            s, tx, ty = s + a * b, tx + (a == 0), ty + (b == 0)
    p = n * (n - 1) / 2
    return s / math.sqrt((p - tx) * (p - ty)) if p > tx and p > ty else None


@pytest.mark.parametrize("kind", KINDS)
def test_correlations(spark, ranges, kind):
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, SCHEMA)
    x, y = zip(*((r[1], r[2]) for r in rows if r[1] is not None and r[2] is not None))
    got = stats.kendall(df, "x", "y").head()
    assert got.n == len(x) and abs(got.tau - tau_b(x, y)) < 1e-9
    got = stats.spearman(df, "x", "y").head()
    assert got.n == len(x) and abs(got.rho - np.corrcoef(ranks(x), ranks(y))[0, 1]) < 1e-9
    by = {r.g: r.tau for r in stats.kendall(df, "x", "y", ["g"]).collect()} if kind != "few-hot" else {}
    for g in {r[3] for r in rows} - {None} if by else ():
        x, y = zip(*((r[1], r[2]) for r in rows if r[3] == g and r[1] is not None and r[2] is not None))
        assert abs(by[g] - tau_b(x, y)) < 1e-9


def test_correlation_of_nothing(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 2.0)], "id long, x double, y double")
    assert tuple(stats.kendall(df, "x", "y").head()) == (2, None) and tuple(stats.spearman(df, "x", "y").head()) == (2, None)
    assert stats.kendall(df.limit(0), "x", "y").head()[0] == 0 and stats.spearman(df.limit(0), "x", "y").head()[0] == 0
    assert tuple(stats.bootstrap(df.limit(0), "x", "y", "id", 10).head()) == (0, None, None)


@pytest.mark.parametrize("kind", ["continuous-few", "hot-continuous"])
def test_ranks_quantiles_and_lowest(spark, ranges, kind):
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, SCHEMA)
    want = dict(zip((r[0] for r in rows), pd.Series([r[1] for r in rows]).rank(pct=True)))
    got = {r.id: r.p for r in stats.with_average_rank(df, "x", "p", True).collect()}
    assert all(got[i] is None if math.isnan(p) else abs(got[i] - p) < 1e-12 for i, p in want.items())
    by = {r.g: r for r in stats.quantiles(df, "x", {"q1": 0.1, "q5": 0.5, "q9": 0.9}, ["g"]).collect()}
    for g in {r[3] for r in rows}:
        v = [r[1] for r in rows if r[3] == g and r[1] is not None]
        assert np.allclose([by[g].q1, by[g].q5, by[g].q9], np.quantile(v, [0.1, 0.5, 0.9]))
    for n in (0, 1, 20, 60, 180, 500):
        want = sorted((r[1], r[0]) for r in rows if r[1] is not None)[:n]
        assert sorted((r.x, r.id) for r in stats.lowest(df, "x", "id", n).collect()) == want
    named = df.withColumn("id", F.format_string("US-%05d", "id"))
    assert sorted(r.id for r in stats.lowest(named, "x", "id", 60).collect()) == sorted(f"US-{i:05d}" for _, i in sorted((r[1], r[0]) for r in rows if r[1] is not None)[:60])


def test_robust_z(spark, ranges):
    rows = rows_of("hot-few") + [(900 + i, 4.0, 0.0, "same", 0) for i in range(5)] + [(999, None, 0.0, "none", 0)]
    got = {r.id: r.z for r in stats.with_robust_z(spark.createDataFrame(rows, SCHEMA).filter("g is not null"), "x", ["g"], "z").collect()}
    for g in {r[3] for r in rows} - {None}:
        v = [r[1] for r in rows if r[3] == g and r[1] is not None]
        med = statistics.median(v) if v else None
        mad = statistics.median(abs(a - med) for a in v) if v else None
        for r in rows:
            if r[3] == g:
                want = 0.0 if mad == 0 else None if r[1] is None else (r[1] - med) / (1.483 * mad)
                assert got[r[0]] == want or abs(got[r[0]] - want) < 1e-9


def brute_line(s, b, target):
    for t in sorted(set(s)):
        hit = sum(k for v, k in zip(s, b) if v <= t)
        if sum(b) and hit / sum(b) >= target:
            n = sum(v <= t for v in s)
            return t, hit / sum(b), hit / n, n / len(s)


@pytest.mark.parametrize("kind", ["continuous-few", "hot-few", "few-few"])
def test_line_and_area(spark, ranges, kind):
    rows = [r for r in rows_of(kind) if r[1] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    s, b = [r[1] for r in rows], [r[4] for r in rows]
    assert np.allclose(tuple(stats.threshold(df, "x", "bad", 0.9).head()), brute_line(s, b, 0.9))
    wins = [(x < y) + (x == y) / 2 for x, k in zip(s, b) if k for y, m in zip(s, b) if not m]
    got = stats.auroc(df, "x", "bad").head()
    assert (got.n, got.n_bad) == (len(s), sum(b)) and abs(got.auroc - sum(wins) / len(wins)) < 1e-9
    assert stats.auroc(df.filter("bad = 0"), "x", "bad").head().auroc is None and stats.threshold(df.filter("bad = 0"), "x", "bad", 0.9).count() == 0


def brute_folds(rows, target, folds=5):
    """(digest, key, score, bad) to (recall, precision) of each fold."""
    fold = {}
    for cls in (0, 1):
        for place, r in enumerate(sorted(r[:2] for r in rows if r[3] == cls)):
            fold[r] = place % folds
    out = []
    if sum(r[3] for r in rows) < folds:
        return out
    for f in range(folds):
        train, test = ([r for r in rows if (fold[r[:2]] == f) == own] for own in (False, True))
        line = brute_line([r[2] for r in train], [r[3] for r in train], target)[0]
        hit, n = sum(r[3] for r in test if r[2] <= line), sum(r[2] <= line for r in test)
        out.append((hit / sum(r[3] for r in test), hit / max(n, 1)))
    return out


def digests(spark, keys):
    return {r.k: r.d for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", stats.order_hash(F.col("k")).alias("d")).collect()}


def test_resampling_equals_brute_force(spark, ranges):
    rows = [r for r in rows_of("continuous-few", 120) if r[1] is not None and r[2] is not None]
    df, n_boot = spark.createDataFrame(rows, SCHEMA), 12
    drawn = collections.defaultdict(list)
    for r in stats.replicates(df, "id", n_boot).collect():
        drawn[r.rep] += [r] * r.copies
    assert 0.9 < sum(map(len, drawn.values())) / (n_boot * len(rows)) < 1.1
    for statistic, brute in ((stats.spearman, lambda x, y: np.corrcoef(ranks(x), ranks(y))[0, 1]), (stats.kendall, tau_b)):
        want = [brute([r.x for r in d], [r.y for r in d]) for d in drawn.values()]
        got = stats.bootstrap(df, "x", "y", "id", n_boot, statistic=statistic).head()
        assert got.n_boot_used == n_boot and np.allclose([got.lo, got.hi], np.percentile(want, [2.5, 97.5]))
    places = [(r, f"{rep}:{r.id}:{k + 1}") for rep, d in drawn.items() for r, c in collections.Counter(d).items() for k in range(c)]
    digest = digests(spark, [k for _, k in places])
    runs = []
    for rep in drawn:
        folds = brute_folds([(digest[k], k, r.x, r.bad) for r, k in places if r.rep == rep], 0.9)
        runs.append(np.mean(folds, axis=0))
    got = stats.bootstrap_cv(df, "id", "x", "bad", 0.9, n_boot=n_boot).head()
    want = np.percentile(runs, [2.5, 97.5], axis=0)
    assert got.n_boot_used == n_boot and np.allclose([got.recall_lo, got.recall_hi, got.precision_lo, got.precision_hi], want.T.ravel())


def test_a_resample_is_drawn_once(spark):
    df = spark.createDataFrame(rows_of("few-hot", 60), SCHEMA)
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan(stats.replicates(df, "id", 5)).count("md5(") == 1
    given = []

    def statistic(rows, x, y, by, weight):
        given.append(rows)
        return stats.spearman(rows, x, y, by, weight)

    stats.bootstrap(df, "x", "y", "id", 5, statistic=statistic)
    assert "md5(" not in plan(given[0])  # what the statistic reads many times is a table
    assert given[0].count() == given[0].select("rep", "x", "y").distinct().count()


def test_cross_validation(spark, ranges):
    rows = [r for r in rows_of("hot-few", 150) if r[1] is not None]
    digest = digests(spark, [str(r[0]) for r in rows])
    want = brute_folds([(digest[str(r[0])], str(r[0]), r[1], r[4]) for r in rows], 0.9)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.col("id").cast("string"))
    got = [(r.recall_cv, r.precision_cv) for r in sorted(stats.cross_validated(df, "id", "x", "bad", 0.9).collect())]
    assert np.allclose(got, want)


def test_a_batch_stops_but_not_at_its_last_row(spark):
    batches = {"a": "...xxx..xxx", "b": "..xxx", "c": "xx.xx.x", "d": "xxxxx", "e": "x" * 3 + "."}
    df = spark.createDataFrame([(k, i, c == "x") for k, v in batches.items() for i, c in enumerate(v)], "batch string, place int, failed boolean")
    got = {r.batch: r.stop for r in stats.batch_stop(df, ["batch"], ["place"], F.col("failed")).collect()}
    assert got == {"a": 5, "d": 2, "e": 2}


def test_plans_hold_no_rows_in_one_task(spark):
    rows = spark.range(100).select("id", F.rand(1).alias("x"), F.rand(2).alias("y"), (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 2).alias("bad"))
    for df in (stats.kendall(rows, "x", "y"), stats.with_rank_gap(rows, "x", "y"), stats.auroc(rows, "x", "bad"), stats.threshold(rows, "x", "bad", 0.9), stats.with_robust_z(rows, "x", ["g"], "z")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
