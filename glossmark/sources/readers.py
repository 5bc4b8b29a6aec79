"""Readers of item, translation, rating and score files, with the schemas they have."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glossmark.functions.text import strip
from glossmark.operators.stats import no_nan

ITEM = "id string, en string, question string, answer string, answer_text string, options map<string,string>, n_options int, meta_info string"
RECORD = (
    "item_id string, answer string, answer_text string, n_options int, meta_info string, model string, prompt_file string, num_ctx string, temperature double, "
    "seconds double, timing string, done_reason string, problems array<string>, english string, bangla string, error string"
)
BACK_TRANSLATION = "item_id string, translator string, back_en string, seconds double, n_chunks int, retry int, len_ratio double"
RATING = "rated_at string, rater string, item_id string, tier string, fluency string, acceptable string, tags string, note string, model string, num_ctx string, shuffle_seed string, source_file string"
CHECKPOINT = "key array<string>, value double"


def blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def read_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of files that hold one JSON list each, with ``file`` and ``place`` (from 0, in the file).

    A file with anything else, a single object or broken JSON, gives no rows. A list is read by one task, as it can't be cut before it is parsed.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\A[\x{FEFF}\s]+", "").alias("value"))
    lists = files.filter(F.col("value").startswith("[")).select("file", F.from_json("value", f"array<struct<{_typed(schema)}>>", {"mode": "PERMISSIVE"}).alias("x"))
    return lists.select("file", F.posexplode("x").alias("place", "r")).filter("r is not null").select("r.*", "file", "place")


def _typed(schema: str) -> str:
    """``name type, ...`` as the fields of a struct type."""
    return StructType.fromDDL(schema).simpleString().removeprefix("struct<").removesuffix(">")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Translation records of JSON list files, whole, with ``file`` and ``place``."""
    return read_list(spark, path, RECORD)


def usable(records: DataFrame) -> DataFrame:
    """item_id, translator, src_raw, hyp_raw, bt_raw of the records without an error and with output."""
    good = records.filter(blank(F.col("error")) & ~blank(F.col("bangla")))
    return good.select("item_id", F.coalesce("model", F.lit("json")).alias("translator"), F.col("english").alias("src_raw"), F.col("bangla").alias("hyp_raw"), F.lit(None).cast("string").alias("bt_raw"))


def skipped(records: DataFrame) -> DataFrame:
    """n_error, n_blank: what ``usable`` leaves out."""
    bad = ~blank(F.col("error"))
    return records.agg(F.count_if(bad).alias("n_error"), F.count_if(~bad & blank(F.col("bangla"))).alias("n_blank"))


def finished_ids(records: DataFrame) -> DataFrame:
    return records.filter(blank(F.col("error")) & ~blank(F.col("bangla"))).select("item_id").distinct()


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON list file; ``question`` stands in for ``en``; the place in the file for a missing id. ``place`` is from 0."""
    rows = read_list(spark, path, ITEM)
    return rows.select(F.coalesce("id", F.col("place").cast("string")).alias("id"), F.coalesce("en", "question").alias("en"), "answer", "answer_text", "options", F.coalesce("n_options", F.size("options")).alias("n_options"), "meta_info", "place")


def find_item(items: DataFrame, wanted: str) -> DataFrame:
    """The item that a user names (no row or one): digits are its place from 1, anything else its id, in any case."""
    name = (wanted or "").strip()
    if name.isdigit():
        return items.filter(F.col("place") == int(name) - 1)
    same = items.filter(F.lower("id") == name.lower()) if name else items.limit(0)
    first = same.agg(F.min_by(F.struct(*items.columns), "place").alias("x")).filter("x is not null")
    return first.select("x.*")


def items_between(items: DataFrame, first: str, last: str) -> DataFrame:
    """The items from one to another, both as ``find_item`` takes them, in either order; none if one isn't there."""
    ends = find_item(items, first).select(F.col("place").alias("a")).join(find_item(items, last).select(F.col("place").alias("b")))
    ends = ends.select(F.least("a", "b").alias("__from"), F.greatest("a", "b").alias("__to"))
    return items.join(F.broadcast(ends), F.col("place").between(F.col("__from"), F.col("__to"))).drop("__from", "__to")  # one row


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header, a byte order mark or not, and line breaks inside quotes; NaN becomes null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.select(*[no_nan(F.col(f"`{c}`")).alias(c) if kind in ("double", "float") else F.col(f"`{c}`") for c, kind in df.dtypes])


def wide_to_long(sheet: DataFrame, id_col: str, src_col: str, translators: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """One row for each translator's filled cell of a sheet with a column of output, and perhaps of back-translation, for each."""
    cells = F.array(*[F.struct(F.lit(t).alias("translator"), F.col(h).alias("hyp_raw"), (F.col(b) if b else F.lit(None)).cast("string").alias("bt_raw")) for t, (h, b) in translators.items()])
    rows = sheet.filter(~blank(F.col(id_col))).select(F.col(id_col).cast("string").alias("item_id"), F.col(src_col).alias("src_raw"), F.explode(cells).alias("c"))
    return rows.select("item_id", "c.translator", "src_raw", "c.hyp_raw", "c.bt_raw").filter(~blank(F.col("hyp_raw")))


def read_allow_list(spark: SparkSession, path: str) -> DataFrame:
    """token: lower-case, without comments and blanks, each once."""
    token = F.lower(strip(F.substring_index("value", "#", 1)))
    return spark.read.text(path).select(token.alias("token")).filter("token <> ''").distinct()


def read_thresholds(spark: SparkSession, path: str | None) -> dict[str, float]:
    """The thresholds by name; none without a file."""
    return {} if not path else {k: v for k, v in spark.read.option("multiLine", True).json(path).head().asDict().items() if v is not None}


def with_line_order(rows: DataFrame, out: str = "line_order") -> DataFrame:
    """Adds a struct that goes up with the lines of a file that was just read: its time and path, its part, the place in that part."""
    at = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    return rows.select("*", at.alias(out))


def read_checkpoint(spark: SparkSession, path: str, name: str) -> DataFrame:
    """item_id, translator, seg_id and the score ``name``; of repeated keys the last line counts."""
    rows = with_line_order(spark.read.schema(CHECKPOINT).json(path)).filter("key is not null")
    key = F.col("key")
    last = rows.groupBy(key[0].alias("item_id"), key[1].alias("translator"), key[2].cast("int").alias("seg_id")).agg(F.max_by(F.struct("value"), "line_order").alias("x"))
    return last.select("item_id", "translator", "seg_id", no_nan(F.col("x.value")).alias(name))


def newest_batch(spark: SparkSession, pattern: str) -> str | None:
    """The lexicographically last path of a pattern."""
    return spark.read.format("binaryFile").load(pattern).agg(F.max("path")).head()[0]


def read_back_translations(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of back-translations as ``read_csv`` reads it, with ``line_order``."""
    names = spark.read.option("header", True).csv(path).columns
    return with_line_order(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)).select(*[F.col(f"`{c}`").alias(c.lstrip("\ufeff")) for c in names], "line_order")


def attach_back_translations(rows: DataFrame, back: DataFrame, order: str = "line_order") -> DataFrame:
    """``rows`` with ``bt_raw`` filled: by item and translator, else, if the file names no translators, by item alone.

    Of repeated keys the last row by ``order`` counts, even if it is empty; an empty text is none and leaves ``bt_raw`` as it is.
    """
    keys = ["item_id", "translator"] if "translator" in back.columns else ["item_id"]
    text = F.when(F.col("back_en") != "", F.col("back_en"))
    last = back.groupBy(*[F.col(k).cast("string").alias(k) for k in keys]).agg(F.max_by(F.struct(text.alias("bt")), order).alias("__x"))
    last = last.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__x.bt").alias("__bt"))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k).cast("string") == F.col(f"__{k}"))
    return rows.join(last, on, "left").withColumn("bt_raw", F.coalesce("__bt", "bt_raw")).select(*rows.columns)


def left_to_do(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not done yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without those done anew, then the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
