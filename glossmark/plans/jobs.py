"""Whole jobs: scores of records to item tables, rating sheets and queues of a sample, thresholds from ratings."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from glossmark.functions import checks, text
from glossmark.functions.chrf import chrf
from glossmark.operators import sampling, scores, stats
from glossmark.plans import quality
from glossmark.plans.guide import rating_guide
from glossmark.sources import readers, writers
from glossmark.sources.store import KEYS, ScoreStore

ROW = ["item_id", "translator"]


@dataclass(frozen=True)
class Metric:
    """A learned score of segments. Of an error, lower is better: it is kept as ``{name}_err`` and turned around."""

    name: str
    factory: scores.ScorerFactory
    is_error: bool = False


def usable_rows(records: DataFrame) -> tuple[DataFrame, Observation]:
    """``readers.usable`` records, and counts of all, failed and blank ones that are taken while the rows are written."""
    seen, bad = Observation("records"), ~readers.blank(F.col("error"))
    counted = records.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_error"), F.count_if(~bad & readers.blank(F.col("bangla"))).alias("n_blank"))
    return readers.usable(counted), seen


def with_scores(long: DataFrame, metrics: Sequence[Metric], store: str) -> DataFrame:
    """The long table with every metric: what the stores lack is scored and added, and the scores are joined back by key.

    Segments of mismatched items are not scored, as one long block would be cut by a model.
    """
    spark = long.sparkSession
    for m in metrics:
        kept = ScoreStore(spark, store, m.name)
        todo = kept.missing(long.filter("seg_mismatch = 0"))
        kept.add(scores.scored(todo, m.name, m.factory).select(*KEYS, m.name))
        long = long.join(kept.read().drop("bucket"), KEYS, "left")
        if m.is_error:
            long = long.withColumn(f"{m.name}_err", F.col(m.name)).withColumn(m.name, scores.metric_polarity(F.col(m.name)))
    return long


def score_columns(metrics: Sequence[Metric]) -> list[F.Column]:
    """Mean and least score of an item's segments; of an error its mean and greatest one, too."""
    out = []
    for m in metrics:
        out += [F.avg(m.name).alias(f"{m.name}_mean"), F.min(m.name).alias(f"{m.name}_min")]
        if m.is_error:
            out += [F.avg(f"{m.name}_err").alias(f"{m.name}_err_mean"), F.max(f"{m.name}_err").alias(f"{m.name}_err_max")]
    return [*out, F.count(metrics[0].name).alias("n_seg_scored")]


def swapped_options(long: DataFrame, embed: scores.TranslatorFactory) -> DataFrame:
    """item_id, translator, option_swap_n, option_swaps of the items with options and without a mismatch. ``embed`` gives unit vectors of texts."""

    @F.pandas_udf("array<double>")
    def vectors(batches: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in _once(embed)(batches.tolist())], dtype="object")

    options = long.filter("seg_mismatch = 0 and seg_id >= 1")
    side = lambda c: options.select(*ROW, F.col("seg_id").alias("seg"), vectors(c).alias("vec"))
    return scores.option_swaps(side("src_en"), side("hyp_bn"), ROW)


_MODELS: dict = {}


def _once(factory):
    """The model of a factory, made once in each worker."""
    if factory not in _MODELS:
        _MODELS[factory] = factory()
    return _MODELS[factory]


def score(
    rows: DataFrame, out: str, metrics: Sequence[Metric] = (), embed: scores.TranslatorFactory | None = None, allow: list[str] | None = None,
    bengali_only: bool = False, version: str = "1",
) -> tuple[DataFrame, DataFrame]:
    """The long and the item table of rows (item_id, translator, src_raw, hyp_raw, bt_raw), written under ``out`` in folders of ``version``.

    Cleaning, segmenting and all measures of a row run once, as they are written before anything joins them. Without ``embed`` the option
    swaps are 0 and not computed. A run that is repeated scores only what the stores lack.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("item_id", F.col("item_id").cast("string"))
    path = lambda name: f"{out}/{name}/{version}"
    again = lambda df, name: (df.write.mode("overwrite").parquet(path(name)), spark.read.schema(df.schema).parquet(path(name)))[1]
    prep = again(quality.prepared(rows), "prepared")
    measures = quality.item_measures(prep, allow, bengali_only)
    others = scores.consensus(prep.select(*ROW, "hyp"), chrf)
    items = again(measures.join(others, ROW, "left"), "measures")
    long = with_scores(quality.long_table(prep), metrics, f"{out}/scores")
    if metrics:
        long = again(long, "long_scores")
        items = items.join(long.groupBy(*ROW).agg(*score_columns(metrics)), ROW, "left")
    if embed:
        swaps = swapped_options(long, embed)
        items = items.join(swaps, ROW, "left").withColumn("option_swap_n", F.coalesce("option_swap_n", F.lit(0)))
    else:
        items = items.withColumns({"option_swap_n": F.lit(0), "option_swaps": F.lit("")})
    items = again(stats.with_robust_z(items, "len_ratio", ["translator"], "len_z"), "item_scores")
    return (long if metrics else again(long, "long_scores")), items


def score_records(spark: SparkSession, json: str, out: str, back: str | None = None, thresholds: str | None = None, **how) -> DataFrame:
    """Files of translation records to decided items: Parquet tables and a CSV for spreadsheets under ``out``; the counts of skipped records
    are taken on the way. Returns the items."""
    rows, seen = usable_rows(readers.read_records(spark, json))
    if back:
        rows = readers.attach_back_translations(rows, readers.read_back_translations(spark, back))
    _, items = score(rows, out, **how)
    decided = quality.decide(items, readers.read_thresholds(spark, thresholds))
    writers.write_csv(decided, f"{out}/item_scores_csv", for_spreadsheets=True)
    spark.createDataFrame([tuple(int(seen.get[c]) for c in ("n", "n_error", "n_blank"))], "n long, n_error long, n_blank long").write.mode("overwrite").json(f"{out}/counts")
    return decided


# ---- translation

#: A model server: made once in each worker, then called with a prompt; gives text, done_reason, load_ns, eval_count and eval_ns, or raises.
ServerFactory = Callable[[], Callable[[str], Mapping]]
# Fixed value: the prompt where there is no prompt file.
FALLBACK_PROMPT = "Translate the following English medical exam item into Bangla. Return only the Bangla translation and nothing else.\n\n{text}"
FAILURES_IN_A_ROW = 3
_META = ("answer", "answer_text", "n_options", "meta_info")


def translate(items: DataFrame, server: ServerFactory, model: str, prompt_file: str = "", template: str | None = None, num_ctx: int | None = None) -> DataFrame:
    """Translation records of items (as ``readers.read_items`` gives them), each with its problems and what the call took.

    Items are dealt to tasks by ranges of their place and asked for in order. After ``FAILURES_IN_A_ROW`` errors or empty outputs in a row a
    task gives up: its other items have no record and are left to the next run.
    """
    ready = items.select("id", *_META, "place", F.coalesce("en", F.lit("")).alias("english")).withColumn("prompt", text.prompt(template or FALLBACK_PROMPT, F.col("id"), F.col("english")))
    calls = "bangla string, done_reason string, load_ns long, eval_count long, eval_ns long, seconds double, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, failed = None, 0
        for b in batches:
            rows = []
            for prompt in b["prompt"]:
                if failed >= FAILURES_IN_A_ROW:
                    break
                ask, start = ask or server(), time.monotonic()
                try:
                    got = ask(prompt)
                    row = (got.get("text", ""), got.get("done_reason", ""), got.get("load_ns"), got.get("eval_count"), got.get("eval_ns"))
                    error = ""
                except Exception as e:
                    row, error = ("", "", None, None, None), str(e) or type(e).__name__
                failed = failed + 1 if error or not row[0].strip() else 0
                rows.append((*row, round(time.monotonic() - start, 1), error))
            out = b.iloc[: len(rows)].drop(columns="prompt")
            for name, values in zip((c.split()[0] for c in calls.split(", ")), zip(*rows) if rows else [[]] * 7):
                out[name] = pd.array(values, dtype="Int64") if name in ("load_ns", "eval_count", "eval_ns") else list(values)
            yield out

    dealt = ready.repartitionByRange("place").sortWithinPartitions("place")
    schema = ", ".join(f"{n} {k}" for n, k in ready.drop("prompt").dtypes) + ", " + calls
    done = dealt.mapInPandas(run, schema)
    problems = F.concat(
        checks.write_time_problems(F.col("english"), F.col("bangla"), F.col("done_reason"), F.col("eval_count")),
        F.array_compact(F.array(checks.answer_key_problem(F.col("answer"), F.col("bangla")))),
    )
    good = F.col("error") == ""
    return done.select(
        F.col("id").alias("item_id"), *_META, F.lit(model).alias("model"), F.lit(prompt_file).alias("prompt_file"), F.lit(str(num_ctx) if num_ctx else "model default").alias("num_ctx"), F.lit(0.0).alias("temperature"),
        "seconds", F.when(good, text.timing_note(F.col("load_ns"), F.col("eval_count"), F.col("eval_ns"))).otherwise("").alias("timing"), "done_reason",
        F.when(good, problems).otherwise(F.array().cast("array<string>")).alias("problems"), "english", "bangla", "error",
    )


def translate_batch(items: DataFrame, out: str, server: ServerFactory, model: str, before: DataFrame | None = None, again: bool = False, **how) -> dict[str, int]:
    """Translates the items that the records ``before`` lack a good output for (all of them if ``again``) and writes all records to ``out``.

    Records of items that run anew give way to the new ones. Returns ran, bad (with an error or problems) and in_file, counted on the way.
    """
    todo = items if before is None or again else items.join(readers.finished_ids(before).select(F.col("item_id").alias("id")), "id", "left_anti")
    seen = Observation("batch")
    new = translate(todo, server, model, **how).observe(seen, F.count(F.lit(1)).alias("ran"), F.count_if((F.col("error") != "") | (F.size("problems") > 0)).alias("bad"))
    new.write.parquet(f"{out}/new")
    rows = items.sparkSession.read.parquet(f"{out}/new")
    if before is not None:
        rows = readers.upsert(before.select(*[c for c in before.columns if c in rows.columns]), rows, ["item_id"])
    kept = Observation("kept")
    rows.observe(kept, F.count(F.lit(1)).alias("n")).write.parquet(f"{out}/records")
    return {"ran": int(seen.get["ran"]), "bad": int(seen.get["bad"]), "in_file": int(kept.get["n"])}


# ---- sample


def rating_sheets(items: DataFrame, long: DataFrame, n_random: int = 150, n_targeted: int = 50, n_anchor: int = 10, seed: int = 42) -> dict[str, DataFrame]:
    """rating_key, rating_sheet, rating_sheet_rater2, anchor_key, anchor_sheet, rating_guide.

    Only the drawn items' segments are joined and put together. Sheets hide what the keys tell.
    """
    named = items.withColumn("__key", F.concat_ws("\x01", *ROW))
    drawn = quality.sample(named, "__key", n_random, n_targeted, seed).select("__key", *ROW, "part")
    anchor = quality.anchors(named, drawn, "__key", n_anchor, seed).select("__key", *ROW)
    texts = quality.item_text(long.join(F.broadcast(drawn.select(*ROW).unionByName(anchor.select(*ROW)).distinct()), ROW, "left_semi"))  # sizes are parameters
    chosen = sampling.numbered(drawn, "R", "__key", seed).join(texts, ROW)
    anchor = sampling.numbered(anchor, "A", "__key", seed).join(texts, ROW)
    second = quality.second_rater(chosen, "__key", seed)
    sheet = lambda df: writers.blank_sheet(df).orderBy("row_id")
    return {
        "rating_key": chosen.select("row_id", *ROW, "part").orderBy("row_id"), "rating_sheet": sheet(chosen), "rating_sheet_rater2": sheet(second),
        "anchor_key": anchor.select("row_id", *ROW).orderBy("row_id"), "anchor_sheet": sheet(anchor), "rating_guide": rating_guide(items.sparkSession),
    }


def write_sheets(sheets: dict[str, DataFrame], out: str) -> None:
    for name, df in sheets.items():
        writers.write_csv(df, f"{out}/{name}", for_spreadsheets=True)


def queues(sheets: dict[str, DataFrame], records: DataFrame) -> dict[str, DataFrame]:
    """The records of the whole sample, of the second rater's part and of the anchors, in the order of their rows. Fails if one is missing."""
    key = sheets["rating_key"]
    sets = {"rating_queue": key, "rating_queue_rater2": key.join(sheets["rating_sheet_rater2"].select("row_id"), "row_id", "left_semi"), "anchor_queue": sheets["anchor_key"]}
    named = records if "translator" in records.columns else records.withColumn("translator", F.coalesce("model", F.lit("json")))
    return {n: quality.queue(df, named) for n, df in sets.items()}


# ---- statistics


def keyed_ratings(ratings: DataFrame, key: DataFrame, order: str = "line_order") -> DataFrame:
    """The rated rows of a sheet by row_id. Ratings by item_id are those of the sample's items, the last one of each."""
    rows = quality.rated_rows(ratings)
    if "row_id" not in rows.columns:
        last = stats.latest(rows, ["item_id"], [order]) if order in rows.columns else rows
        rows = last.join(key.select("row_id", "item_id"), "item_id")
    return rows.select("row_id", "tier", "fluency", "acceptable", "tags", "note")


def rated_sample(ratings: DataFrame, key: DataFrame, items: DataFrame, ratings2: DataFrame | None = None) -> DataFrame:
    """The ratings joined with key and scores, as ``quality.report`` takes them; the second rater's tier and fluency beside the first's."""
    first = keyed_ratings(ratings, key)
    df = first.join(key.select("row_id", *ROW, "part"), "row_id").join(items.withColumn("item_id", F.col("item_id").cast("string")), ROW)
    if ratings2 is not None:
        second = keyed_ratings(ratings2, key).select("row_id", F.col("tier").alias("tier_rater2"), F.col("fluency").alias("fluency_rater2"))
        df = df.join(second, "row_id", "left")
    return df.withColumn("tier", text.strip(F.col("tier"))).withColumn("fluency", F.expr("try_cast(fluency as double)"))


def calibrate(ratings: DataFrame, key: DataFrame, items: DataFrame, out: str, ratings2: DataFrame | None = None, target: float = 0.9, n_boot: int = 2000, n_boot_cv: int = 200) -> DataFrame:
    """The whole report (statistic, value). Writes it, the thresholds as JSON and the recall of each tag under ``out``."""
    spark = items.sparkSession
    df = rated_sample(ratings, key, items, ratings2)
    df.write.mode("overwrite").parquet(f"{out}/rated")
    df = spark.read.parquet(f"{out}/rated")
    quality.report(df, target=target, key="row_id", n_boot=n_boot, n_boot_cv=n_boot_cv, items=items).write.mode("overwrite").parquet(f"{out}/stats_report")
    found = spark.read.parquet(f"{out}/stats_report")
    lines = quality.thresholds_of(found)
    writers.write_json(lines.coalesce(1), f"{out}/thresholds")
    flagged = df.join(F.broadcast(lines.select(F.col("cometkiwi_min_threshold").alias("__line")))).filter("cometkiwi_min is not null and __line is not null")  # one row
    per_tag = stats.tag_recall(flagged, "tags", F.col("cometkiwi_min") <= F.col("__line")).orderBy("tag")
    writers.write_csv(per_tag.withColumnRenamed("n", "items"), f"{out}/recall_per_tag", for_spreadsheets=True)
    return found
