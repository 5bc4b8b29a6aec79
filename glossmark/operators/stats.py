"""Statistics of a rated sample. Ranks, quantiles and sums come from ranges of values, so that no task holds or ranks all of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from math import e, factorial

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmark.operators.sampling import order_hash
from glossmark.sources.shared import materialize

#: Values of a range, about; ranges at least, and at most, where a range of very many values has its share of them.
RANGE_ROWS, MIN_RANGES, MAX_RANGES = 50_000, 8, 512
#: Draws that a task of a resample makes, about.
TASK_DRAWS = 1 << 20
#: Leading hex digits of a shuffled place (``sampling.order_hash``) that make its range: 4,096 ranges, even by the hash.
HASH_DIGITS = 3


def no_nan(c: Column) -> Column:
    """NaN as null, so that comparisons and aggregates skip it."""
    return F.when(~F.isnan(c.cast("double")), c)


# ---- ranges


def splits_of(rows: DataFrame, value: str) -> list[float]:
    """Values that cut ``rows`` into ranges of about ``RANGE_ROWS`` rows; a value that fills ranges by itself gets one of its own.

    One pass; the driver gets ``MAX_RANGES`` numbers at most.
    """
    points = [i / MAX_RANGES for i in range(1, MAX_RANGES)]
    n, cuts = rows.agg(F.count(value), F.percentile_approx(F.col(value).cast("double"), points, 20 * MAX_RANGES)).head()
    if not n:
        return []
    n_ranges = min(MAX_RANGES, max(MIN_RANGES, -(-n // RANGE_ROWS)))
    chosen = cuts[MAX_RANGES // n_ranges - 1 :: MAX_RANGES // n_ranges]
    own = {v for v, w in zip(chosen, chosen[1:]) if v == w}
    return sorted({float(v) for v in chosen} | {float(np.nextafter(v, np.inf)) for v in own})


def with_range(rows: DataFrame, value: str, splits: list[float], out: str) -> DataFrame:
    """Adds the number of the range that ``value`` falls into; a range begins at its split."""
    if not splits:
        return rows.withColumn(out, F.lit(0.0))
    helper = f"__as_double_{out}"
    cut = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol=helper, outputCol=out, handleInvalid="keep")
    return cut.transform(rows.withColumn(helper, F.col(value).cast("double"))).drop(helper)


def _with_parts(rows: DataFrame, by: list[str], part: str, order: list[str], sums: Mapping[str, Column]) -> DataFrame:
    """Adds for each sum ``{name}_upto`` (over the rows of the group up to the row) and ``{name}_all``; ``part`` goes up with the order.

    Windows hold the rows of a part, or one row for each part of a group.
    """
    totals = rows.groupBy(*by, part).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"__o_{k}") for k in [*by, part]], *[x for n in sums for x in (F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__o_{n}"), F.sum(n).over(group).alias(f"{n}_all"))])
    inside = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"{n}_upto": F.sum(c).over(inside) for n, c in sums.items()})
    on = F.lit(True)
    for k in [*by, part]:
        on = on & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    joined = local.join(offsets, on)
    return joined.withColumns({f"{n}_upto": F.col(f"{n}_upto") + F.col(f"__o_{n}") for n in sums}).drop(*[f"__o_{k}" for k in [*by, part, *sums]])


def with_running_sums(counts: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """Adds ``{sum}_upto`` and ``{sum}_all`` over the values of each group in rising order; ``counts`` has each value of a group once."""
    ranged = with_range(counts, value, splits_of(counts, value), "__range")
    return _with_parts(ranged, by, "__range", [value], {s: F.col(s) for s in sums}).drop("__range")


def with_hash_rank(df: DataFrame, by: list[str], digest: str, order: list[str], out: str) -> DataFrame:
    """Adds the place (from 0) of each row of a group by ``digest`` (hex digits) and ``order``, in ranges of the digest's first digits."""
    parts = df.withColumn("__part", F.substring(digest, 1, HASH_DIGITS))
    return _with_parts(parts, by, "__part", [digest, *order], {"__n": F.lit(1)}).withColumn(out, F.col("__n_upto") - 1).drop("__part", "__n_upto", "__n_all")


# ---- ranks and quantiles


def _average_ranks(rows: DataFrame, value: str, by: list[str], weight: Column) -> DataFrame:
    """by, value, __r (average rank), __n_all: one row for each value of a group."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("__n"))
    return with_running_sums(counts, by, value, ["__n"]).select(*by, value, (F.col("__n_upto") - (F.col("__n") - 1) / 2.0).alias("__r"), "__n_all")


def with_average_rank(df: DataFrame, value: str, out: str, percent: bool = False, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """Adds the average rank of ``value`` among its own non-nulls (a share of their count if ``percent``); null stays null.

    Ranks come from counts by value: partial sums on each task, then windows over ranges of values.
    """
    return _with_ranks(df, _average_ranks(df, value, by or [], F.lit(1) if weight is None else weight), value, out, percent, by)


def _with_ranks(df: DataFrame, ranks: DataFrame, value: str, out: str, percent: bool = False, by: list[str] | None = None) -> DataFrame:
    rank = F.col("__r") / F.col("__n_all") if percent else F.col("__r")
    ranks = ranks.select(*[F.col(k).alias(f"__k_{k}") for k in by or []], F.col(value).alias("__v"), rank.alias(out))
    on = F.col(value) == F.col("__v")
    for k in by or []:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(ranks, on, "left").drop("__v", *[f"__k_{k}" for k in by or []])


def with_rank_gap(df: DataFrame, a: str, b: str, out: str = "rank_gap") -> DataFrame:
    """Adds the distance of the percentile ranks of two scores, each among its own non-nulls."""
    return with_average_rank(with_average_rank(df, a, "__a", True), b, "__b", True).withColumn(out, F.abs(F.col("__a") - F.col("__b"))).drop("__a", "__b")


def quantiles(df: DataFrame, value: str, points: Mapping[str, float], groups: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """groups and a column for each of ``points``: exact quantiles (between two values in proportion) of the non-null values of every group.

    Selection from counts of values by ranges: memory follows the ranges and not the rows of a group. Groups without values have no row.
    """
    groups = groups or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__n"))
    rows = with_running_sums(counts, groups, value, ["__n"])
    upto, first = F.col("__n_upto"), F.col("__n_upto") - F.col("__n")
    at = {n: q * (F.col("__n_all") - 1) for n, q in points.items()}
    pick = lambda k: F.max(F.when((first <= k) & (k < upto), F.col(value)))
    found = rows.groupBy(*groups).agg(*[x for n, p in at.items() for x in (pick(F.floor(p)).alias(f"__lo_{n}"), pick(F.ceil(p)).alias(f"__hi_{n}"), F.max(p).alias(f"__at_{n}"))])

    def between(n: str) -> Column:
        lo, hi, p = F.col(f"__lo_{n}").cast("double"), F.col(f"__hi_{n}").cast("double"), F.col(f"__at_{n}")
        return F.when(F.floor(p) == F.ceil(p), lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi).alias(n)

    return found.select(*groups, *map(between, points))


def with_robust_z(df: DataFrame, value: str, groups: list[str], out: str) -> DataFrame:
    """Adds (x - median) / (1.483 MAD) within groups; 0 where the MAD is 0. Both medians come from counts of the values alone."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__c"))
    med = quantiles(counts, value, {"__med": 0.5}, groups, "__c")
    away = counts.join(med, groups).select(*groups, F.abs(F.col(value) - F.col("__med")).alias("__away"), "__c")
    mad = quantiles(away, "__away", {"__mad": 0.5}, groups, "__c")
    z = F.when(F.col("__mad") == 0, 0.0).otherwise((F.col(value) - F.col("__med")) / (1.483 * F.col("__mad")))
    return df.join(med.join(mad, groups), groups, "left").withColumn(out, z).drop("__med", "__mad")


def lowest(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the least ``score``, ties by ``key``; null scores are left out. For shares of a table, where a sort for a limit would
    gather them in one task: the score of the last row comes from running sums, and only rows with that score are ranked, by ranges of the key."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("__n"))
    line = with_running_sums(counts, [], score, ["__n"]).filter(F.col("__n_upto") >= n).agg(F.min(F.struct(F.col(score).alias("at"), (F.col("__n_upto") - F.col("__n")).alias("below"))).alias("x")).head().x
    if line is None:
        return df.filter(F.col(score).isNotNull())
    at = F.lit(line["at"])
    ties = df.filter(F.col(score) == at).withColumn("__k", order_number(F.col(key), dict(df.dtypes)[key]))
    ties = _with_parts(with_range(ties, "__k", splits_of(ties, "__k"), "__range"), [], "__range", [key], {"__n": F.lit(1)})
    first = ties.filter(F.col("__n_upto") <= n - line["below"]).select(*df.columns)
    return df.filter(F.col(score) < at).unionByName(first)


def order_number(c: Column, kind: str) -> Column:
    """A number that goes up with a column: itself, or the first six bytes of a string."""
    if kind != "string":
        return c.cast("double")
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))


# ---- correlation


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """by, n, rho."""
    by = by or []
    w = F.col(weight) if weight else F.lit(1)
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.sum(w).alias("c"))
    # Both ranks come from the cells themselves, so that those of y don't wait for the join with those of x.
    rx, ry = (_average_ranks(cells, v, by, F.col("c")) for v in ("x", "y"))
    ranked = _with_ranks(_with_ranks(cells, rx, "x", "rx", by=by), ry, "y", "ry", by=by)
    s = lambda v: F.sum(F.col("c") * v)
    rx, ry = F.col("rx"), F.col("ry")
    sums = ranked.groupBy(*by).agg(F.sum("c").alias("n"), *[s(v).alias(k) for k, v in (("sx", rx), ("sy", ry), ("sxx", rx * rx), ("syy", ry * ry), ("sxy", rx * ry))])
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") ** 2, F.col("n") * F.col("syy") - F.col("sy") ** 2
    rho = F.when((vx > 0) & (vy > 0), (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy))
    return sums.select(*by, F.coalesce("n", F.lit(0)).alias("n"), rho.alias("rho"))


def inversions(y: np.ndarray, weight: np.ndarray) -> float:
    """The weight of the pairs whose first has the larger ``y``: bit by bit, counts of ones before zeros among equal higher bits."""
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    order, total = np.arange(len(rank)), 0.0
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        r, w = rank[order], weight[order]
        ones = np.where(r >> bit & 1, w, 0.0)
        upto = np.cumsum(ones)
        high = r >> (bit + 1)
        starts = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]]))
        base = np.repeat((upto - ones)[starts], np.diff(np.append(starts, len(r))))
        total += float(np.sum(np.where(r >> bit & 1, 0.0, w * (upto - base))))
        order = order[np.lexsort((order, r >> bit))]
    return total


def kendall(df: DataFrame, x: str, y: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """by, n, tau (tau-b, null without two values of each) by counting inversions.

    Rows in the order of (x, y) are discordant where a greater y comes first. x and y are cut into ranges: pairs of one range of x are
    counted range by range, those of one range of y and different ranges of x likewise, and all others by the table of counts of both
    ranges, which is bounded. A value that fills ranges has one of its own, in which no pair is discordant, so that it is left out.
    """
    by = by or []
    w = F.col(weight) if weight else F.lit(1)
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), w.alias("w"))
    cells = rows.groupBy(*by, "x", "y").agg(F.sum("w").cast("double").alias("c"))
    cuts = {v: splits_of(cells, v) for v in ("x", "y")}
    for v, splits in cuts.items():
        cells = with_range(cells, v, splits, f"{v}r")
    single = {v: [float(i + 1) for i, (a, b) in enumerate(zip(s, s[1:])) if b == np.nextafter(a, np.inf)] for v, s in cuts.items()}
    schema = ", ".join([*(f"`{k}` {kind}" for k, kind in cells.select(*by).dtypes), "d double"])

    def counted(of: str, order: list[str], ties: str) -> DataFrame:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(order, kind="stable")
            d = inversions(group["y"].to_numpy(), group["c"].to_numpy())
            if ties:  # pairs of one range of x are counted there
                d -= sum(inversions(g["y"].to_numpy(), g["c"].to_numpy()) for _, g in group.groupby(ties, sort=False))
            return pd.DataFrame({**{k: [group[k].iloc[0]] for k in by}, "d": [d]})

        kept = cells.filter(~F.col(f"{of}r").isin(single[of])) if single[of] else cells
        return kept.groupBy(*by, f"{of}r").applyInPandas(run, schema)

    grid = cells.groupBy(*by, "xr", "yr").agg(F.sum("c").alias("c"))

    def across(group: pd.DataFrame) -> pd.DataFrame:
        """Pairs of different ranges of both, from at most ``MAX_RANGES`` squared counts."""
        m = np.zeros((int(group["xr"].max()) + 1, int(group["yr"].max()) + 1))
        m[group["xr"].astype(int), group["yr"].astype(int)] = group["c"]
        above = np.cumsum(np.cumsum(m, axis=0)[:, ::-1], axis=1)[:, ::-1]  # up to a range of x, from a range of y
        d = float((m[1:, :-1] * above[:-1, 1:]).sum())
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in by}, "d": [d]})

    parts = counted("x", ["x", "y"], "")
    if cuts["x"]:
        parts = parts.unionByName(counted("y", ["xr"], "xr"))
        if cuts["y"]:
            parts = parts.unionByName(grid.groupBy(*by).applyInPandas(across, schema))
    # One aggregate over the sums of values (ties) and the discordant pairs, each with nulls for what it doesn't have.
    pairs = F.col("c") * (F.col("c") - 1) / 2.0
    of = lambda rows, **sums: rows.select(*by, *[sums.get(k, F.lit(None).cast("double")).alias(k) for k in ("n", "tx", "ty", "txy", "d")])
    value = lambda v: cells.groupBy(*by, v).agg(F.sum("c").alias("c"))
    each = of(value("x"), n=F.col("c"), tx=pairs).unionByName(of(value("y"), ty=pairs)).unionByName(of(cells, txy=pairs)).unionByName(of(parts, d=F.col("d")))
    one = each.groupBy(*by).agg(*[F.coalesce(F.sum(k), F.lit(0.0)).alias(k) for k in ("n", "tx", "ty", "txy", "d")])
    n, tx, ty = F.col("n"), F.col("tx"), F.col("ty")
    p = n * (n - 1) / 2.0
    tau = F.when((p > tx) & (p > ty), (p - tx - ty + F.col("txy") - 2 * F.col("d")) / F.sqrt((p - tx) * (p - ty)))
    return one.select(*by, n.cast("long").alias("n"), tau.alias("tau"))


# ---- scores against ratings


def auroc(df: DataFrame, score: str, bad: str) -> DataFrame:
    """n, n_bad, auroc of a low ``score`` for ``bad`` rows; null with one class only."""
    values = df.filter(F.col(score).isNotNull()).groupBy((-F.col(score)).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(bad).cast("long")).alias("b"))
    ranked = with_running_sums(values, [], "s", ["n"]).withColumn("r", F.col("n_upto") - (F.col("n") - 1) / 2.0)
    sums = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_bad"), F.sum(F.col("b") * F.col("r")).alias("r"))
    good = F.col("n") - F.col("n_bad")
    area = (F.col("r") - F.col("n_bad") * (F.col("n_bad") + 1) / 2.0) / (F.col("n_bad") * good)
    return sums.select("n", "n_bad", F.when((F.col("n_bad") > 0) & (good > 0), area).alias("auroc"))


def threshold(df: DataFrame, score: str, bad: str, target: float, by: list[str] | None = None) -> DataFrame:
    """by, threshold, recall, precision, flag_share: the least score value up to which ``target`` of the bad rows lie; no row without bad ones."""
    by = by or []
    counts = df.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(bad).cast("long")).alias("b"))
    sums = with_running_sums(counts, by, "t", ["n", "b"])
    ok = sums.filter((F.col("b_all") > 0) & (F.col("b_upto") / F.col("b_all") >= target))
    best = ok.groupBy(*by).agg(F.min_by(F.struct("t", "b_upto", "n_upto", "n_all", "b_all"), "t").alias("x"))
    x = lambda n: F.col(f"x.{n}")
    return best.filter("x is not null").select(*by, x("t").alias("threshold"), (x("b_upto") / x("b_all")).alias("recall"), (x("b_upto") / x("n_upto")).alias("precision"), (x("n_upto") / x("n_all")).alias("flag_share"))


def cross_validated(df: DataFrame, key: str, score: str, bad: str, target: float, folds: int = 5, by: list[str] | None = None) -> DataFrame:
    """by, fold, recall_cv, precision_cv: the threshold of the other folds applied to each.

    Folds go round by the rows' places in each class, by a hash of the key. No rows if there are fewer bad rows than folds; a fold
    that flags nothing has precision 0.
    """
    by = by or []
    rows = df.filter(F.col(score).isNotNull()).select(*by, F.col(score).alias("s"), F.col(bad).cast("long").alias("bad"), F.col(key).alias("key"), order_hash(F.col(key)).alias("digest"))
    rows = with_hash_rank(rows, [*by, "bad"], "digest", ["key"], "place").withColumn("fold", (F.col("place") % folds).cast("int"))
    # Equal rows of a fold are one row with a count from here on.
    rows = rows.groupBy(*by, "fold", "s", "bad").agg(F.count(F.lit(1)).alias("k"))
    train = rows.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter("f <> fold")
    values = train.groupBy(*by, F.col("f").alias("fold"), F.col("s").alias("t")).agg(F.sum(F.col("bad") * F.col("k")).alias("b"))
    ok = with_running_sums(values, [*by, "fold"], "t", ["b"]).filter((F.col("b_all") > 0) & (F.col("b_upto") / F.col("b_all") >= target))
    lines = ok.groupBy(*by, "fold").agg(F.min("t").alias("threshold"))
    at = rows.join(lines, [*by, "fold"])
    flagged = F.col("s") <= F.col("threshold")
    k = F.col("k")
    sums = at.groupBy(*by, "fold").agg(F.sum(F.col("bad") * k).alias("b"), F.sum(F.when(flagged, k).otherwise(0)).alias("n"), F.sum(F.when(flagged, F.col("bad") * k).otherwise(0)).alias("hit"))
    # One row a fold. With as many bad rows as folds each fold has some, and so has what it is trained on.
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    enough = sums.withColumn("all", F.sum("b").over(every)).filter(F.col("all") >= folds)
    return enough.select(*by, "fold", (F.col("hit") / F.col("b")).alias("recall_cv"), (F.col("hit") / F.greatest("n", F.lit(1))).alias("precision_cv"))


def weighted_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, kappa with quadratic weights of the places of the labels that occur, in order; null if the ratings can't disagree.

    One row holds the counts of pairs of labels, of which ratings have a handful.
    """
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    one = rows.agg(F.collect_list(F.struct("a", "b", "n")).alias("x"))
    labels = F.array_sort(F.array_distinct(F.concat("x.a", "x.b")))
    cells = one.withColumn("labels", labels).select(F.inline_outer(F.transform("x", lambda c: F.struct(F.array_position("labels", c["a"]).alias("i"), F.array_position("labels", c["b"]).alias("j"), c["n"].alias("n")))))
    i, j, n = (F.col(c).cast("double") for c in "ijn")
    mean = lambda v: F.sum(n * v) / F.sum(n)
    # The expected squared distance of independent ratings is E i² - 2 Ei Ej + E j².
    m = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), mean((i - j) ** 2).alias("o"), (mean(i * i) - 2 * mean(i) * mean(j) + mean(j * j)).alias("expected"))
    return m.select("n", F.when(F.col("expected") > 0, 1 - F.col("o") / F.col("expected")).alias("kappa"))


def tag_recall(df: DataFrame, tags: str, flagged: Column) -> DataFrame:
    """tag, n, caught, recall over ``;``-separated tags; a tag repeated in a row counts again."""
    rows = df.select(F.explode(F.split(F.coalesce(tags, F.lit("")), ";")).alias("tag"), flagged.cast("int").alias("f")).withColumn("tag", F.trim("tag")).filter("tag <> ''")
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("caught"), F.avg("f").alias("recall"))


# ---- resampling

#: Parts of 2 to the power 52 at which a Poisson variable of mean 1 goes up to 1, 2, ... (e**-1 times sums of 1 / k!).
POISSON = tuple(int(2**52 * sum(1 / factorial(i) for i in range(k + 1)) / e) for k in range(10))


def replicates(df: DataFrame, key: str, n_boot: int, seed: int = 42) -> DataFrame:
    """Each row for every replicate that draws it, with ``rep`` and ``copies``: a Poisson variable of mean 1 from a hash of replicate and key.

    No row is numbered, moved or counted for it, so a resample of any size is one pass; its size is that of the table on average.
    The digits of the hash come out of a generator, as they would be hashed anew for each of the comparisons if they were a plain column.
    """
    rows = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    drawn = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("rep").cast("string"), F.lit(":"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 13)
    rows = rows.withColumn("__u", F.explode(F.array(drawn)))
    copies = sum((F.when(F.col("__u") >= f"{p:013x}", 1).otherwise(0) for p in POISSON[1:]), F.lit(1))
    return rows.filter(F.col("__u") >= f"{POISSON[0]:013x}").withColumn("copies", copies).drop("__u")


def drawn_cells(df: DataFrame, x: str, y: str, key: str, n_boot: int, seed: int = 42) -> DataFrame:
    """rep, x, y, copies: what each replicate draws of every pair of values, counted once and written.

    Rows go to tasks by ranges of (x, y, key) first, so that a task meets few pairs of values and counts nearly all draws of a pair itself,
    while rows of a frequent pair still go to many tasks.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"))
    n_tasks = max(MIN_RANGES, -(-rows.count() * n_boot // TASK_DRAWS))
    drawn = replicates(rows.repartitionByRange(n_tasks, "x", "y", "k"), "k", n_boot, seed)
    return materialize(drawn.groupBy("rep", "x", "y").agg(F.sum("copies").alias("copies")), "draws")


def interval(values: DataFrame, value: str) -> DataFrame:
    """n_boot_used, lo, hi: the 95 percent interval of one value for each replicate; nulls are left out."""
    return values.filter(F.col(value).isNotNull()).agg(F.count(F.lit(1)).alias("n_boot_used"), F.percentile(value, 0.025).alias("lo"), F.percentile(value, 0.975).alias("hi"))


def bootstrap(df: DataFrame, x: str, y: str, key: str, n_boot: int, seed: int = 42, statistic: Callable[..., DataFrame] = spearman) -> DataFrame:
    """n_boot_used, lo, hi of ``spearman`` or ``kendall`` (both with weights); replicates without two values of each are left out.

    The statistic reads its cells several times, for ranges, ranks and sums; they are drawn once.
    """
    found = statistic(drawn_cells(df, x, y, key, n_boot, seed), "x", "y", ["rep"], "copies")
    return interval(found, found.columns[-1])


def bootstrap_spearman(df: DataFrame, x: str, y: str, key: str, n_boot: int, seed: int = 42) -> DataFrame:
    return bootstrap(df, x, y, key, n_boot, seed, spearman)


def bootstrap_cv(df: DataFrame, key: str, score: str, bad: str, target: float, folds: int = 5, n_boot: int = 200, seed: int = 42) -> DataFrame:
    """n_boot_used, recall_lo, recall_hi, precision_lo, precision_hi: the whole cross-validation of each replicate; copies of a row
    are rows of their own, which may come into different folds."""
    rows = replicates(df.filter(F.col(score).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(score).alias("s"), F.col(bad).alias("bad")), "k", n_boot, seed)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("k", F.concat_ws(":", "rep", "k", "copy"))
    means = cross_validated(rows, "k", "s", "bad", target, folds, ["rep"]).groupBy("rep").agg(F.avg("recall_cv").alias("recall"), F.avg("precision_cv").alias("precision"))
    both = means.filter("recall is not null and precision is not null")
    ends = [F.percentile(c, q).alias(f"{c}_{n}") for c in ("recall", "precision") for n, q in (("lo", 0.025), ("hi", 0.975))]
    return both.agg(F.count(F.lit(1)).alias("n_boot_used"), *ends)


# ---- sequences and upserts


def failure_runs(df: DataFrame, groups: list[str], order: list[str], failed: Column, run: int = 3) -> DataFrame:
    """groups, start, n_failed for every run of ``run`` or more failures in a row."""
    w = Window.partitionBy(*groups).orderBy(*order)
    marked = df.withColumn("__f", failed.cast("int")).withColumn("__k", F.row_number().over(w) - F.sum("__f").over(w))
    runs = marked.filter("__f = 1").groupBy(*groups, "__k").agg(F.min(F.struct(*order)).alias("x"), F.count(F.lit(1)).alias("n_failed"))
    return runs.filter(F.col("n_failed") >= run).select(*groups, F.col(f"x.{order[-1]}").alias("start"), "n_failed")


def batch_stop(df: DataFrame, groups: list[str], order: list[str], failed: Column, limit: int = 3) -> DataFrame:
    """groups, stop: the row at which a batch gives up, the first that ends ``limit`` failures in a row, unless it is the batch's last."""
    w = Window.partitionBy(*groups).orderBy(*order)
    last_good = F.max(F.when(~failed, F.col("__i"))).over(w)
    rows = df.withColumn("__i", F.row_number().over(w)).withColumn("__run", F.col("__i") - F.coalesce(last_good, F.lit(0)))
    ends = rows.groupBy(*groups).agg(F.max("__i").alias("__n"), F.min(F.when(F.col("__run") >= limit, F.struct("__i", F.col(order[-1]).alias("stop")))).alias("x"))
    return ends.filter(F.col("x.__i") < F.col("__n")).select(*groups, "x.stop")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key: a keyed upsert. An aggregate with partial sums, so that a hot key never meets in one task."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__x"))
    return top.select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest])
