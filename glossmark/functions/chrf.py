"""Sentence chrF (Popović, 2015): character n-grams up to 6, beta 2, white space removed, 0 to 100."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

ORDER, BETA = 6, 2
#: Pairs whose grams are sorted together, and characters of them, about; a longer pair is counted alone.
BATCH_PAIRS, BATCH_CHARS = 256, 1 << 19
# What str.split() takes for white space.
_SPACES = np.array([*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_IS_SPACE = np.zeros(int(_SPACES.max()) + 2, bool)
_IS_SPACE[_SPACES] = True
_MULTIPLIER, _HASH_BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(56)


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points without white space, and the number of the text of each."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    space = _IS_SPACE[np.minimum(points, len(_IS_SPACE) - 1)]
    return points[~space].astype(np.uint64), owner[~space]


def _grams(points: np.ndarray, owner: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every order the distinct grams (the text's number over a hash of 56 bits), sorted, and how often each occurs."""
    out, rolling = [], np.zeros(len(points), np.uint64)
    for n in range(1, ORDER + 1):
        rolling = rolling[: max(0, len(points) - n + 1)] * _MULTIPLIER + points[n - 1 :]
        mixed = (rolling ^ rolling >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        whole = owner[: len(mixed)] == owner[n - 1 :]
        key = (owner[: len(mixed)].astype(np.uint64) << _HASH_BITS | mixed >> np.uint64(64 - 56))[whole]
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        out.append((key[first], np.diff(np.append(first, len(key)))))
    return out


def _scores(hyps: list[str], refs: list[str]) -> np.ndarray:
    n_pairs = len(hyps)
    sides = [_characters(x) for x in (hyps, refs)]
    sizes = [np.bincount(owner, minlength=n_pairs) for _, owner in sides]
    p, r, orders = (np.zeros(n_pairs) for _ in range(3))
    for n, ((a, ca), (b, cb)) in enumerate(zip(*(_grams(*x) for x in sides)), start=1):
        at = np.searchsorted(b, a)
        met = at < len(b)
        met[met] = b[at[met]] == a[met]
        shared = np.bincount((a[met] >> _HASH_BITS).astype(np.int64), np.minimum(ca[met], cb[at[met]]), n_pairs)
        total_a, total_b = (np.maximum(s - n + 1, 0) for s in sizes)
        both = (total_a > 0) & (total_b > 0)
        p += np.where(both, shared / np.maximum(total_a, 1), 0)
        r += np.where(both, shared / np.maximum(total_b, 1), 0)
        orders += both
    p, r = p / np.maximum(orders, 1), r / np.maximum(orders, 1)
    return np.where(p + r > 0, 100 * (1 + BETA**2) * p * r / np.where(p + r > 0, BETA**2 * p + r, 1), 0.0)


def scores(hyps: list[str], refs: list[str]) -> np.ndarray:
    """chrF of pairs of texts; all grams of a run of pairs are counted by sorting their hashes at once."""
    out, at = np.zeros(len(hyps)), 0
    size = np.array([len(h) + len(r) for h, r in zip(hyps, refs)], np.int64)
    ends = np.cumsum(size)
    while at < len(hyps):
        fit = int(np.searchsorted(ends, BATCH_CHARS + (ends[at - 1] if at else 0), side="right"))
        stop = min(max(at + 1, fit), at + BATCH_PAIRS)
        out[at:stop] = _scores(hyps[at:stop], refs[at:stop])
        at = stop
    return out


@F.pandas_udf(DoubleType())
def _chrf(hyps: pd.Series, refs: pd.Series) -> pd.Series:
    there = (hyps.notna() & refs.notna()).to_numpy()
    out = np.full(len(hyps), np.nan)
    out[there] = scores(hyps[there].tolist(), refs[there].tolist())
    return pd.Series(out).astype("Float64").where(pd.Series(there), pd.NA)


def chrf(hyp: Column, ref: Column) -> Column:
    """chrF of ``hyp`` against ``ref``; null if either is."""
    return F.when(hyp.isNotNull() & ref.isNotNull(), _chrf(hyp, ref))


def chrf_relational(pairs: DataFrame) -> DataFrame:
    """id, chrf of a table (id, hyp, ref), as joins and sums alone: for short texts and as a check of the other form."""

    def grams(side: str) -> DataFrame:
        t = F.regexp_replace(side, r"[\s\x1c-\x1f\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", "")
        rows = pairs.select("id", t.alias("t")).withColumn("n", F.explode(F.array(*map(F.lit, range(1, ORDER + 1))))).filter(F.length("t") >= F.col("n"))
        rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("t") - F.col("n") + 1)))
        return rows.groupBy("id", "n", F.substring(F.col("t"), F.col("i"), F.col("n")).alias("g")).agg(F.count(F.lit(1)).alias(f"c_{side}"))

    both = grams("hyp").join(grams("ref"), ["id", "n", "g"], "full")
    by_order = both.groupBy("id", "n").agg(F.sum(F.least(F.coalesce("c_hyp", F.lit(0)), F.coalesce("c_ref", F.lit(0)))).alias("m"), F.sum("c_hyp").alias("h"), F.sum("c_ref").alias("r"))
    means = by_order.filter("h > 0 and r > 0").groupBy("id").agg(F.avg(F.col("m") / F.col("h")).alias("p"), F.avg(F.col("m") / F.col("r")).alias("q"))
    f = F.when(F.col("p") + F.col("q") > 0, 100 * (1 + BETA**2) * F.col("p") * F.col("q") / (BETA**2 * F.col("p") + F.col("q"))).otherwise(0.0)
    return pairs.select("id").distinct().join(means, "id", "left").select("id", F.coalesce(f, F.lit(0.0)).alias("chrf"))
