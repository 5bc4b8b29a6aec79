"""The six jobs: score, decide, summary, sample, queue, stats."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.functions import checks, text
from glossmark.functions.chrf import chrf
from glossmark.operators import sampling, stats

# Flags in the order of their reasons, vocabularies of the ratings.
HARD_FLAGS = ("seg_mismatch", "other_script_n", "devanagari_n", "assamese_n", "latin_word_n", "num_hard_n", "dup_option_n", "option_swap_n", "bn_option_labels_n")
SOFT_FLAGS = ("num_soft_n",)
LENGTH_LIMIT = 3.5
TIERS = ("D0", "D1", "D2", "D3")
MEANING_TAGS = ("number", "negation", "drug_or_disease", "clause_dropped", "option_changed", "other_fact")
FORM_TAGS = ("untranslated", "gloss", "script", "option_missing")


def prepared(rows: DataFrame) -> DataFrame:
    """item_id, translator, src, hyp, bt, precomposed_n and the segments of both sides. The sides are normalised differently."""
    hyp = text.clean_output(text.nfc(F.col("hyp_raw")))
    out = rows.select("item_id", "translator", text.normalise_symbols("src_raw").alias("src"), hyp.alias("hyp"), text.normalise_symbols("bt_raw").alias("bt"), text.precomposed_count(F.col("hyp_raw")).alias("precomposed_n"))
    return out.withColumn("src_seg", text.segments(F.col("src"))).withColumn("hyp_seg", text.segments(F.col("hyp")))


def long_table(rows: DataFrame) -> DataFrame:
    """item_id, translator, seg_id, src_en, hyp_bn, seg_mismatch: segment by segment, or one pair of whole texts if the numbers differ."""
    same = F.size("src_seg") == F.size("hyp_seg")
    pairs = F.when(same, F.arrays_zip(F.col("src_seg").alias("src_en"), F.col("hyp_seg").alias("hyp_bn"))).otherwise(F.array(F.struct(F.col("src").alias("src_en"), F.col("hyp").alias("hyp_bn"))))
    return rows.select("item_id", "translator", (~same).cast("int").alias("seg_mismatch"), F.posexplode(pairs).alias("seg_id", "x")).select("item_id", "translator", "seg_id", "x.src_en", "x.hyp_bn", "seg_mismatch")


def item_measures(rows: DataFrame, allow: list[str] | None = None, bengali_only: bool = False, with_chrf: bool = True) -> DataFrame:
    """One row for each item and translator with the structural measures that a row has by itself."""
    src, hyp = F.col("src"), F.col("hyp")
    measures = checks.script_checks(hyp, src, bengali_only) | checks.untranslated_words(src, hyp, allow, bengali_only) | checks.numbers_preserved(src, hyp)
    return rows.select(
        "item_id", "translator", "precomposed_n", (F.size("src_seg") != F.size("hyp_seg")).cast("int").alias("seg_mismatch"), F.size("src_seg").alias("n_seg_src"),
        F.size("hyp_seg").alias("n_seg_hyp"), checks.length_ratio(src, hyp).alias("len_ratio"), *[c.alias(n) for n, c in measures.items()],
        checks.duplicate_options(F.col("hyp_seg")).alias("dup_option_n"), (chrf(F.col("bt"), src) if with_chrf else F.lit(None).cast("double")).alias("roundtrip_chrf"),
    )


def item_table(rows: DataFrame, allow: list[str] | None = None, bengali_only: bool = False, with_chrf: bool = True) -> DataFrame:
    """One row for each item and translator with all structural measures, the length among those of its translator too."""
    return stats.with_robust_z(item_measures(rows, allow, bengali_only, with_chrf), "len_ratio", ["translator"], "len_z")


def hard_flag(items: DataFrame) -> Column:
    """True where any hard count is over 0 or the length is far out."""
    return checks.any_of([F.col(c) > 0 for c in HARD_FLAGS if c in items.columns] + [F.abs("len_z") > LENGTH_LIMIT])


def decide(items: DataFrame, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """``items`` with ``decision`` and ``decision_reason``. Hard flags win; labels of other rules are not given beside them."""
    thr, has = {k: v for k, v in (thresholds or {}).items() if v == v}, set(items.columns)
    hard = hard_flag(items)
    if "rank_gap" in thr and {"metricx_mean", "cometkiwi_mean"} <= has:
        items = stats.with_rank_gap(items, "cometkiwi_mean", "metricx_mean", "__gap")
    yes = lambda c: F.coalesce(c, F.lit(False))
    low = yes(F.col("cometkiwi_min") <= thr["cometkiwi_min_threshold"]) if "cometkiwi_min_threshold" in thr and "cometkiwi_min" in has else F.lit(False)
    review = [(f"soft:{c}", yes(F.col(c) > 0)) for c in SOFT_FLAGS if c in has]
    if "__gap" in items.columns:
        review.append(("review:rank_gap", yes(F.col("__gap") > thr["rank_gap"])))
    if "roundtrip_chrf_cut" in thr and "roundtrip_chrf" in has:
        review.append(("review:roundtrip_chrf", yes(F.col("roundtrip_chrf") < thr["roundtrip_chrf_cut"])))
    reasons = [F.when(yes(F.col(c) > 0), F.lit(f"hard:{c}")) for c in HARD_FLAGS if c in has] + [F.when(yes(F.abs("len_z") > LENGTH_LIMIT), F.lit("hard:len_z"))]
    reasons += [F.when(low & ~hard, F.lit("flag:cometkiwi_min"))] + [F.when(m & ~hard, F.lit(label)) for label, m in review]
    decision = F.when(hard | low, "FLAG").when(checks.any_of([m for _, m in review]), "REVIEW").otherwise("PASS")
    return items.withColumn("decision", decision).withColumn("decision_reason", F.concat_ws(";", *reasons)).drop("__gap")


def decision_counts(items: DataFrame) -> DataFrame:
    """translator, FLAG, PASS, REVIEW."""
    return items.groupBy("translator").pivot("decision", ["FLAG", "PASS", "REVIEW"]).count().fillna(0)


def summary(items: DataFrame) -> DataFrame:
    """check, translator, value (a string): the rows of the summary table; pivot on the translator to print it.

    Scores without values and decisions that a translator has none of give no row.
    """
    has, pos = set(items.columns), lambda c: F.count_if(F.coalesce(F.col(c), F.lit(0)) > 0)
    total, s = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))), lambda c: c.cast("string")
    both = lambda a, b: F.concat(s(a), F.lit(" ("), s(b), F.lit(")"))
    rows = {
        "records": s(F.count(F.lit(1))),
        "precomposed chars (items)": both(total("precomposed_n"), pos("precomposed_n")),
        "option count mismatch (items)": s(total("seg_mismatch")),
        "items with other-script letters": s(F.count_if(F.col("other_script_n") + F.col("devanagari_n") + F.col("assamese_n") > 0)),
        "items with untranslated English (words)": both(pos("latin_word_n"), total("latin_word_n")),
        "English gloss words": s(total("gloss_n")),
        "items with a hard number miss": s(pos("num_hard_n")),
        "items with a soft number miss": s(pos("num_soft_n")),
        "items with duplicate options": s(pos("dup_option_n")),
        "items with length z beyond 3.5": s(F.count_if(F.abs("len_z") > LENGTH_LIMIT)),
        "items with option_swap": s(pos("option_swap_n")) if "option_swap_n" in has else F.lit("not run"),
        "items with any hard flag": s(F.count_if(hard_flag(items))),
    }
    if "consensus_chrf" in has:
        rows["consensus chrF mean"] = F.struct(F.avg("consensus_chrf").alias("a"), F.lit(None).cast("double").alias("b"), F.lit("n/a (1 translator)").alias("none"), F.lit(1).alias("d"))
    if "roundtrip_chrf" in has:
        rows["round-trip chrF mean (min)"] = F.struct(F.avg("roundtrip_chrf").alias("a"), F.min("roundtrip_chrf").alias("b"), F.lit("no back-translation").alias("none"), F.lit(1).alias("d"))
    for c in ("cometkiwi_mean", "cometkiwi_min", "metricx_err_mean", "metricx_err_max", "labse_mean", "labse_min"):
        if c in has:
            rows[f"{c} (mean over items)"] = F.struct(F.avg(c).alias("a"), F.lit(None).cast("double").alias("b"), F.lit(None).cast("string").alias("none"), F.lit(3).alias("d"))
    if "decision" in has:
        rows |= {f"decision {d}": F.when(F.count_if(F.col("decision") == d) > 0, s(F.count_if(F.col("decision") == d))) for d in ("PASS", "FLAG", "REVIEW")}
    means = {k for k in rows if k.endswith(("(mean over items)", "chrF mean", "chrF mean (min)"))}
    no_mean = F.lit(None).cast("struct<a:double,b:double,none:string,d:int>")
    cells = [F.struct(F.lit(k).alias("check"), (F.lit(None).cast("string") if k in means else v).alias("value"), (v.cast("struct<a:double,b:double,none:string,d:int>") if k in means else no_mean).alias("m")) for k, v in rows.items()]
    out = items.groupBy("translator").agg(F.array(*cells).alias("x")).select("translator", F.inline("x"))
    # Means are rounded as they are printed, by their binary values, once there is one row for each.
    one, three, least = text.one_decimal(F.when(F.col("m.d") == 1, F.col("m.a"))), text.rounded(F.when(F.col("m.d") == 3, F.col("m.a")), 3), text.one_decimal(F.col("m.b"))
    out = out.withColumns({"__one": one, "__three": three, "__least": least})
    mean = F.coalesce(F.when(F.col("__least").isNotNull(), F.concat("__one", F.lit(" ("), "__least", F.lit(")"))), F.col("__one"), F.col("__three").cast("string"), F.col("m.none"))
    return out.select("check", "translator", F.coalesce("value", mean).alias("value")).filter("value is not null")


def item_text(long: DataFrame) -> DataFrame:
    """item_id, translator, src_en, hyp_bn as raters read them: options under the letters of their places, mismatched ones whole."""
    g = long.groupBy("item_id", "translator").agg(F.array_sort(F.collect_list(F.struct("seg_id", "src_en", "hyp_bn"))).alias("x"), F.max("seg_mismatch").alias("m"))
    side = lambda c: F.when(F.col("m") == 1, F.col(f"x.{c}")[0]).otherwise(text.relabelled(F.col(f"x.{c}"))).alias(c)
    return g.select("item_id", "translator", side("src_en"), side("hyp_bn"))


def sample(items: DataFrame, key: str, n_random: int = 150, n_targeted: int = 50, seed: int = 42) -> DataFrame:
    """The drawn rows with ``part``: random by translator, from the worst tenth, and the largest disagreement of two scores."""
    scored = items.filter(F.col("cometkiwi_min").isNotNull())
    n, n_translators = scored.agg(F.count(F.lit(1)), F.countDistinct("translator")).head()
    rand = sampling.draw_by_stratum(scored, "translator", key, n_random // max(n_translators, 1), seed)
    row = [key, "translator"]
    rest, half = sampling.without(scored, rand, row), n_targeted // 2
    n_rest = rest.count()
    worst = sampling.draw(stats.lowest(rest, "cometkiwi_min", key, max(half, n_rest // 10)), key, half, seed)
    rest = sampling.without(rest, worst, row)
    if "metricx_mean" in items.columns and rest.filter("metricx_mean is not null").head(1):
        apart = sampling.largest(stats.with_rank_gap(rest, "cometkiwi_mean", "metricx_mean", "__gap"), "__gap", key, n_targeted - half).drop("__gap")
    else:
        apart = sampling.smallest(rest, "roundtrip_chrf", key, n_targeted - half)
    parts = (("random", rand), ("targeted_worst", worst), ("targeted_disagree", apart))
    out = [df.withColumn("part", F.lit(p)) for p, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def second_rater(chosen: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Half of the random and half of the targeted rows."""
    kinds = chosen.withColumn("__k", F.col("part") == "random")
    sizes = kinds.groupBy("__k").agg(F.floor(F.count(F.lit(1)) / 2).alias("__q"))
    return sampling.draw_by_stratum(kinds.join(F.broadcast(sizes), "__k"), "__k", key, F.col("__q"), seed).drop("__k", "__q")  # two rows


def anchors(items: DataFrame, chosen: DataFrame, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """Items outside the sample, whoever translated them."""
    return sampling.draw(sampling.without(items, chosen, ["item_id"]), key, n, seed)


def queue(key_rows: DataFrame, records: DataFrame) -> DataFrame:
    """The records of a rating key in its order; fails if one is missing."""
    keys = ["item_id", "translator"]
    missing = key_rows.join(records, keys, "left_anti").select(*keys).head(1)
    if missing:
        raise ValueError(f"no record for {missing[0].item_id}, {missing[0].translator}")
    return key_rows.select("row_id", *keys).join(records, keys).orderBy("row_id")


def rating_violations(rated: DataFrame) -> DataFrame:
    """row_id, rule, detail for every broken rule of the rating sheet; each unknown tag is one. White space around values doesn't count."""
    there = lambda c: text.strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
    tags = F.filter(F.transform(F.split(there("tags"), ";"), text.strip), lambda t: t != "")
    known, meaning = (F.array(*map(F.lit, x)) for x in (MEANING_TAGS + FORM_TAGS, MEANING_TAGS))
    number = F.expr("try_cast(fluency as double)")
    rules = [
        ("tier", ~there("tier").isin(*TIERS)),
        ("fluency", ~F.coalesce((number >= 1) & (number <= 5), F.lit(False))),
        ("meaning_tag", there("tier").isin("D2", "D3") & ~F.arrays_overlap(tags, meaning)),
        ("acceptable", ~F.lower(there("acceptable")).isin("yes", "no")),
    ]
    broken = [F.when(c, F.struct(F.lit(n).alias("rule"), F.lit("").alias("detail"))) for n, c in rules]
    unknown = F.transform(F.filter(tags, lambda t: ~F.array_contains(known, t)), lambda t: F.struct(F.lit("tags").alias("rule"), t.alias("detail")))
    return rated.select("row_id", F.inline(F.concat(F.array_compact(F.array(*broken)), unknown)))


def rated_rows(ratings: DataFrame) -> DataFrame:
    """Rows with a tier; missing optional columns are empty."""
    rows = ratings.filter(~F.coalesce(text.strip(F.col("tier").cast("string")) == "", F.lit(True)))
    return rows.withColumns({c: F.lit("") for c in ("acceptable", "tags", "note") if c not in ratings.columns})


def tier_number(tier: Column) -> Column:
    """0 to 3; other tiers are null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for i, t in enumerate(TIERS) for x in (t, i)]), tier)


def is_bad(tier: Column) -> Column:
    return F.coalesce((tier_number(tier) >= 2), F.lit(False)).cast("int")


def _statistics(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """statistic, value of tables of one row each; names are the columns behind a prefix."""
    out = None
    for prefix, one in parts:
        rows = one.select(F.inline(F.array(*[F.struct(F.lit(prefix + c).alias("statistic"), F.col(c).cast("double").alias("value")) for c in one.columns])))
        out = rows if out is None else out.unionAll(rows)
    return out


def report(
    rated: DataFrame, score: str = "cometkiwi_min", mean_score: str = "cometkiwi_mean", second_score: str = "metricx_mean", target: float = 0.9, key: str | None = None,
    n_boot: int = 0, n_boot_cv: int = 0, items: DataFrame | None = None,
) -> DataFrame:
    """statistic, value: the calibration report of a rated sample (tier, both scores, part and whatever optional columns there are).

    The item's mean score is correlated with the tier over the random part, a second one too if it is there; the least one is judged and cut
    over all. With a ``key``, the means of five folds and, for ``n_boot`` and ``n_boot_cv`` replicates, the 95 percent intervals. With the
    whole set of ``items``, the share of them that the line flags.
    """
    has = set(rated.columns)
    df = rated.withColumn("__bad", is_bad(F.col("tier"))).withColumn("__tier", tier_number(F.col("tier")).cast("double"))
    rand = df.filter("part = 'random'")
    line = stats.threshold(df, score, "__bad", target)
    parts = []
    for name, c in (("", mean_score), ("second_", second_score)):
        if c not in has or c == mean_score and name:
            continue
        parts += [(name, stats.spearman(rand, c, "__tier").select(F.col("n").alias("n_random"), F.col("rho").alias("spearman_random")))]
        parts += [(name, stats.kendall(rand, c, "__tier").select(F.col("tau").alias("kendall_random")))]
        if key and n_boot:
            parts += [(f"{name}{n}_", stats.bootstrap(rand, c, "__tier", key, n_boot, statistic=f)) for n, f in (("spearman", stats.spearman), ("kendall", stats.kendall))]
    for n, d in (("random", rand), ("all_enriched", df)):
        parts.append(("", stats.auroc(d, score, "__bad").select(F.col("auroc").alias(f"auroc_{n}"), F.col("n").alias(f"auroc_n_{n}"), F.col("n_bad").alias(f"auroc_n_bad_{n}"))))
    parts.append(("", line.select(F.col("threshold").alias(f"{score}_threshold"), F.col("recall").alias("recall_in_sample"), F.col("precision").alias("precision_in_sample"), F.col("flag_share").alias("flag_share_in_sample"))))
    if key:
        parts.append(("", stats.cross_validated(df, key, score, "__bad", target).agg(F.avg("recall_cv").alias("recall_cv"), F.avg("precision_cv").alias("precision_cv"))))
        if n_boot_cv:
            parts.append(("cv_", stats.bootstrap_cv(df, key, score, "__bad", target, n_boot=n_boot_cv)))
    if "roundtrip_chrf" in has:
        bad = df.filter("__bad = 1 and roundtrip_chrf is not null")
        parts += [("", bad.agg(F.count(F.lit(1)).alias("n_bad_with_chrf"))), ("", stats.quantiles(bad, "roundtrip_chrf", {"roundtrip_chrf_cut": 0.9}))]
    if {mean_score, second_score} <= has and mean_score != second_score:
        gap = stats.with_rank_gap(df.filter(F.col(mean_score).isNotNull() & F.col(second_score).isNotNull()), mean_score, second_score, "__gap")
        parts.append(("", gap.agg(F.count(F.lit(1)).alias("rank_gap_n"))))
        parts += [("", stats.quantiles(d, "__gap", {n: 0.5})) for n, d in (("rank_gap", gap.filter("__bad = 1")), ("gap_median_all", gap))]
    if "tier_rater2" in has:
        both = df.filter("tier_rater2 is not null").withColumn("__t2", tier_number(text.strip(F.col("tier_rater2"))))
        parts += [("", both.agg(F.count(F.lit(1)).alias("n_double_rated"))), ("", stats.weighted_kappa(both, "__tier", "__t2").select(F.col("kappa").alias("kappa_tier")))]
        if {"fluency", "fluency_rater2"} <= has:
            whole = both.select(*[F.floor(F.expr(f"try_cast({c} as double)")).alias(c) for c in ("fluency", "fluency_rater2")])
            parts.append(("", stats.weighted_kappa(whole, "fluency", "fluency_rater2").select(F.col("kappa").alias("kappa_fluency"))))
    if "option_swap_n" in has:
        parts.append(("option_swap_", option_swap_check(df)))
    if items is not None:
        scores = items.select(score).join(F.broadcast(line.select("threshold")), F.lit(True), "left")  # one row at most
        parts.append(("", scores.agg(F.avg(F.when(F.col("threshold").isNotNull(), F.coalesce(F.col(score) <= F.col("threshold"), F.lit(False)).cast("int"))).alias("flag_share_full_set"))))
    return _statistics(parts)


def option_swap_check(rated: DataFrame) -> DataFrame:
    """fired_in_sample, fired_on_D0_D1, fired_with_option_changed_tag: how the option swap flag does by the ratings."""
    fired = rated.filter(F.coalesce("option_swap_n", F.lit(0)) > 0)
    tagged = F.coalesce(F.col("tags"), F.lit("")).contains("option_changed") if "tags" in rated.columns else F.lit(False)
    return fired.agg(F.count(F.lit(1)).alias("fired_in_sample"), F.count_if(tier_number(F.col("tier")) <= 1).alias("fired_on_D0_D1"), F.count_if(tagged).alias("fired_with_option_changed_tag"))


#: The statistics that ``decide`` and the reader of a run take from a report.
THRESHOLDS = (
    "cometkiwi_min_threshold", "rank_gap", "roundtrip_chrf_cut", "recall_in_sample", "precision_in_sample", "recall_cv", "precision_cv", "auroc_random",
    "auroc_all_enriched", "spearman_random", "flag_share_in_sample", "flag_share_full_set",
)


def thresholds_of(found: DataFrame) -> DataFrame:
    """One row of the thresholds by name; what a report lacks is null."""
    return found.agg(*[F.max(F.when(F.col("statistic") == n, F.col("value"))).alias(n) for n in THRESHOLDS])


def throughput(seconds: Mapping[str, float], n_items: int, target: int = 12_000) -> dict[str, float]:
    """Hours that each step would take for ``target`` items."""
    return {k: round(s / 60 / max(n_items, 1) * target / 60, 1) for k, s in seconds.items()}
