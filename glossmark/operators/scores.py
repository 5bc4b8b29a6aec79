"""Learned scores through an injected scorer, similarity of embeddings, option swaps, back-translation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.functions import text
from glossmark.functions.text import OPTION_LETTERS
from glossmark.sources.readers import left_to_do
from glossmark.sources.shared import materialize

#: A scorer: made once in each worker, then called with lists of sources and outputs; gives as many numbers.
ScorerFactory = Callable[[], Callable[[list, list], list]]
RETRY_BELOW, RETRY_WORDS = 0.70, 20


def scored(long: DataFrame, name: str, factory: ScorerFactory, src: str = "src_en", hyp: str = "hyp_bn") -> DataFrame:
    """Adds the score ``name`` to rows without a segment mismatch. The model is loaded once a worker, rows come in Arrow batches."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = None  # a task without rows loads no model
        for s, h in batches:
            score = score or factory()
            yield pd.Series(score(s.tolist(), h.tolist()), dtype="float64")

    return long.filter("seg_mismatch = 0").withColumn(name, run(src, hyp))


def newly_scored(long: DataFrame, done: DataFrame, name: str, factory: ScorerFactory) -> DataFrame:
    """Scores of the rows that a checkpoint lacks."""
    return scored(left_to_do(long, done, ["item_id", "translator", "seg_id"]), name, factory).select("item_id", "translator", "seg_id", name)


def length_agreement() -> Callable[[list, list], list]:
    """A deterministic stand-in for a learned scorer: how near the lengths are, 0 to 1."""
    return lambda src, hyp: [min(len(s), len(h)) / max(len(s), len(h), 1) for s, h in zip(src, hyp)]


def metric_polarity(error: Column) -> Column:
    """An error score negated, so that higher is better everywhere."""
    return -error


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is null or all zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def option_swaps(src: DataFrame, hyp: DataFrame, keys: list[str]) -> DataFrame:
    """keys, option_swap_n, option_swaps: options whose nearest source option is not the one in the same place.

    Both tables: keys, seg (from 1), vec. The pairs of an item are its options squared, at most twelve times twelve.
    """
    pairs = src.select(*keys, F.col("seg").alias("s"), F.col("vec").alias("sv")).join(hyp.select(*keys, F.col("seg").alias("h"), F.col("vec").alias("hv")), keys)
    near = pairs.groupBy(*keys, "h").agg(F.max_by("s", F.struct(dot(F.col("sv"), F.col("hv")), -F.col("s"))).alias("s"))
    letter = lambda c: F.substring(F.lit(OPTION_LETTERS), c.cast("int"), F.lit(1))
    swap = F.when(F.col("s") != F.col("h"), F.struct("h", F.concat(letter(F.col("h")), F.lit("->"), letter(F.col("s"))).alias("t")))
    out = near.groupBy(*keys).agg(F.array_sort(F.collect_list(swap)).alias("x"))
    return out.select(*keys, F.size("x").alias("option_swap_n"), F.array_join("x.t", ";").alias("option_swaps"))


#: A translator back into the source language: made once in each worker, then called with lists of sentences; gives as many texts.
TranslatorFactory = Callable[[], Callable[[list], list]]


def translation_pieces(rows: DataFrame, keys: list[str], hyp: str, max_words: int) -> DataFrame:
    """keys, is_option, place, label, piece: the sentences of the stem in parts of ``max_words`` words at most, and the options whole."""
    # Out of a generator, as each of its uses would cut the text anew if it were a plain column.
    cut = rows.select(*keys, F.explode(F.array(text.cut_at_labels(text.clean_output(text.nfc(F.col(hyp)))))).alias("parts"))
    x = text.labelled_segments(F.col("parts"))
    row = lambda is_option, i, label, piece: F.struct(F.lit(is_option).alias("is_option"), i.cast("int").alias("place"), label.alias("label"), piece.alias("piece"))
    stem = F.transform(text.chunked_sentences(x["stem"], max_words), lambda p, i: row(False, i, F.lit(""), p))
    options = F.transform(x["options"], lambda o, i: row(True, i, o["label"], o["text"]))
    return cut.select(*keys, F.inline(F.concat(stem, options)))


def translated(pieces: DataFrame, translator: TranslatorFactory, column: str = "piece", out: str = "en") -> DataFrame:
    """Adds the translation ``out``. Pieces are dealt evenly and sorted by length in each task, so that a model's batch has like lengths."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        translate = None
        for b in batches:
            translate = translate or translator()
            yield pd.Series(translate(b.tolist()), index=b.index, dtype="object")

    dealt = pieces.withColumn("__n", F.length(column)).repartition(F.xxhash64(*pieces.columns)).sortWithinPartitions("__n")
    return dealt.drop("__n").withColumn(out, run(column))


def assembled(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, back_en, n_chunks: the stem's parts in order, then the options under the labels that the output gave them."""
    ordered = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("is_option", "place", "label", "en"))).alias("x"))
    stem, options = F.filter("x", lambda p: ~p["is_option"]), F.filter("x", lambda p: p["is_option"])
    tail = F.array_join(F.transform(options, lambda p: F.concat(p["label"], F.lit(". "), p["en"])), "\n")
    whole = text.strip(F.concat(F.array_join(F.transform(stem, lambda p: p["en"]), " "), F.lit("\n"), tail))
    return ordered.select(*keys, whole.alias("back_en"), F.size(stem).alias("n_chunks"))


def back_translated(rows: DataFrame, translator: TranslatorFactory, keys: list[str], src: str = "src_raw", hyp: str = "hyp_raw", max_words: int = 40) -> DataFrame:
    """keys, back_en, n_chunks, retry, len_ratio of every row (one for each value of the keys).

    Texts whose translation has less than ``RETRY_BELOW`` of the source's characters are done again in parts of ``RETRY_WORDS`` words; a longer
    result stays, with ``retry`` 1. Only those rows are translated twice. A row of nothing but white space gives an empty text.
    """
    size = F.greatest(F.coalesce(F.length(src), F.lit(0)), F.lit(1))
    asked = materialize(rows.select(*keys, size.alias("__size"), F.col(hyp).alias("__hyp")), "asked")
    size = F.col("__size")
    once = asked.drop("__hyp").join(assembled(translated(translation_pieces(asked, keys, "__hyp", max_words), translator), keys), keys, "left")
    # Written, as both the short ones and the result read it, and each would have all texts translated again.
    once = materialize(once.select(*keys, "__size", F.coalesce("back_en", F.lit("")).alias("back_en"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")), "translated")
    short = asked.join(once.filter(F.length("back_en") / size < RETRY_BELOW).select(*keys), keys, "left_semi")
    again = assembled(translated(translation_pieces(short, keys, "__hyp", RETRY_WORDS), translator), keys)
    again = again.select(*keys, F.col("back_en").alias("__en"), F.col("n_chunks").alias("__n"))
    both = once.join(again, keys, "left").withColumn("__longer", F.coalesce(F.length("__en") > F.length("back_en"), F.lit(False)))
    pick = lambda a, b: F.when(F.col("__longer"), F.col(a)).otherwise(F.col(b))
    out = both.select(*keys, "__size", pick("__en", "back_en").alias("back_en"), pick("__n", "n_chunks").alias("n_chunks"), F.col("__longer").cast("int").alias("retry"))
    return out.select(*keys, "back_en", "n_chunks", "retry", text.rounded(F.length("back_en") / size, 3).alias("len_ratio"))


def token_cap(rows: DataFrame, n_tokens: str, cap: int = 512) -> DataFrame:
    """n_over, max_tokens."""
    return rows.agg(F.count_if(F.col(n_tokens) > cap).alias("n_over"), F.max(n_tokens).alias("max_tokens"))


def segment_rollup(long: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    """mean, min, max and count of every score over the segments of an item; nulls skipped."""
    return long.groupBy(*keys).agg(*[f(s).alias(f"{s}_{n}") for s in scores for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("n", F.count))])


def to_wide(long: DataFrame, scores: list[str], translators: list[str]) -> DataFrame:
    """One row an item with ``translator__score__mean`` and ``__min``; the translators are given, so no extra pass finds them."""
    aggs = [f(s).alias(f"{s}__{n}") for s in scores for n, f in (("mean", F.avg), ("min", F.min))]
    wide = long.groupBy("item_id").pivot("translator", translators).agg(*aggs)
    return wide.select("item_id", *[F.col(f"`{t}_{s}__{n}`").alias(f"{t}__{s}__{n}") for t in translators for s in scores for n in ("mean", "min")])


def consensus(rows: DataFrame, score: Callable[[Column, Column], Column]) -> DataFrame:
    """item_id, translator, consensus_chrf: mean score against the other outputs of the item; null under three translators."""
    n = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    peers = rows.filter("hyp <> ''").select("item_id", F.col("translator").alias("t2"), F.col("hyp").alias("ref"))
    pairs = rows.join(n, "item_id").filter("n >= 3").join(peers, "item_id").filter("translator <> t2")
    means = pairs.groupBy("item_id", "translator").agg(F.avg(score(F.col("hyp"), F.col("ref"))).alias("consensus_chrf"))
    return rows.select("item_id", "translator").join(means, ["item_id", "translator"], "left")
