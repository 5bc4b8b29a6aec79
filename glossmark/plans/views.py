"""The driver's tables as the inputs of the quality jobs, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn as the source, the assistant's next turn as the output: item_id, translator, src, hyp."""
    c = table(spark, sf_dir, "conversations")
    user = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    reply = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    rows = user.join(reply, ["conv_id", "turn"])
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), F.concat(F.lit("m"), (F.col("conv_id") % 4).cast("string")).alias("translator"), "src", "hyp")


PAIRS = """pairs as (select u.conv_id * 1000 + u.turn as item_id, 'm' || (u.conv_id % 4) as translator, u.text as src, a.text as hyp
from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant')"""


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as a rated sample: row_id, item_id, tier, bad, score, error, part, translator."""
    d, q = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text", "source"), table(spark, sf_dir, "labels")
    rows = d.join(q, "doc_id")
    tier = F.when(F.col("quality") == 1, F.when(F.col("toxic") == 0, "D0").otherwise("D1")).otherwise(F.when(F.col("toxic") == 0, "D2").otherwise("D3"))
    return rows.select(
        "doc_id", tier.alias("tier"), (1 - F.col("quality")).cast("int").alias("bad"), F.col("n_chars").cast("double").alias("score"),
        (F.col("n_chars") * 7919 % 1009).cast("double").alias("error"), F.when(F.col("doc_id") % 4 < 3, "random").otherwise("targeted_worst").alias("part"), F.col("source").alias("translator"),
    )


RATED = """rated as (select d.doc_id, case when quality = 1 then (case when toxic = 0 then 'D0' else 'D1' end) when toxic = 0 then 'D2' else 'D3' end as tier,
cast(1 - quality as int) as bad, cast(n_chars as double) as score, cast(n_chars * 7919 % 1009 as double) as error,
case when d.doc_id % 4 < 3 then 'random' else 'targeted_worst' end as part, source as translator from documents d join labels l on l.doc_id = d.doc_id)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an item table with flags and scores from their keys and prices."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    flag = lambda n, name: F.when(k % n == 0, 1).otherwise(0).alias(name)
    return o.select(
        k.alias("item_id"), F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("translator"), (k % 5).alias("precomposed_n"), flag(97, "seg_mismatch"), flag(89, "other_script_n"),
        flag(101, "devanagari_n"), flag(103, "assamese_n"), flag(61, "latin_word_n"), (k % 7).alias("gloss_n"), flag(53, "num_hard_n"), flag(19, "num_soft_n"), flag(107, "dup_option_n"),
        flag(109, "option_swap_n"), flag(113, "bn_option_labels_n"), ((k * 31 % 1000).cast("double") / 100 - 5).alias("len_z"), ((k * 7919 % 10007).cast("double") / 10007).alias("cometkiwi_mean"),
        ((k * 104729 % 9973).cast("double") / 9973).alias("cometkiwi_min"), F.when(k % 11 != 0, (k * 611953 % 9941).cast("double") / 9941).alias("metricx_mean"), F.when(k % 13 != 0, (k * 37 % 1000).cast("double") / 10).alias("roundtrip_chrf"),
    )


def _flag(n: int, name: str) -> str:
    return f"case when o_orderkey % {n} = 0 then 1 else 0 end as {name}"


_FLAGS = ", ".join(_flag(n, c) for n, c in ((97, "seg_mismatch"), (89, "other_script_n"), (101, "devanagari_n"), (103, "assamese_n"), (61, "latin_word_n"), (53, "num_hard_n"), (19, "num_soft_n"), (107, "dup_option_n"), (109, "option_swap_n"), (113, "bn_option_labels_n")))
ITEMS = f"""items as (select o_orderkey as item_id, 'm' || (o_custkey % 3) as translator, o_orderkey % 5 as precomposed_n, o_orderkey % 7 as gloss_n, {_FLAGS},
cast(o_orderkey * 31 % 1000 as double) / 100 - 5 as len_z, cast(o_orderkey * 7919 % 10007 as double) / 10007 as cometkiwi_mean, cast(o_orderkey * 104729 % 9973 as double) / 9973 as cometkiwi_min,
case when o_orderkey % 11 <> 0 then cast(o_orderkey * 611953 % 9941 as double) / 9941 end as metricx_mean,
case when o_orderkey % 13 <> 0 then cast(o_orderkey * 37 % 1000 as double) / 10 end as roundtrip_chrf from orders)"""
