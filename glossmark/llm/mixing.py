"""Mixing sources to target weights by Pfair scheduling: earliest deadline first over blocks with release times and deadlines.

DataFrame functions only. If every source flowed at its weight, t blocks of all sources would have flowed by the time at which block
k of a source of weight w begins: t = sum over all sources of min(their weight x k / w, their blocks). So a source that is used up
leaves, and the others go on in their proportion. The block is released at floor(t), and due at ceil(t) of the next block. Each slot
goes to the released block with the earliest deadline. As the flow itself keeps all these windows, unit blocks can too, and earliest
deadline first finds how: in every prefix of the schedule each source is less than one block off its target (Baruah et al., 1996).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmark.llm.common import free_name

#: Rows of a block at least, and blocks of all sources at most (beside one for each source): longer tables have larger blocks.
BLOCK_ROWS, MAX_BLOCKS = 16, 100_000
#: Weights follow the number of rows to this power if none are given: small sources count for more than their share.
TEMPERATURE = 0.5
#: A plan of up to so many blocks is broadcast; a longer one (more sources than that) is joined by shuffling.
MAX_BROADCAST_BLOCKS = 200_000
#: Slots that are scheduled into one array.
CHUNK = 512
#: Rows that one ranking bucket of a source should hold; a task ranks a bucket, never a source.
BUCKET_ROWS = 50_000
#: Times are rounded to so many digits before they become slots, so that no error of the last bit moves a window.
DIGITS = 6


def source_key(source: Column) -> Column:
    """A key that tells a null source from an empty one."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("-"))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _tiers(counts: DataFrame, weights: Mapping[str, float] | None, block_rows: int) -> DataFrame:
    """last, s, total: a row for the sources with a weight, and one for those of weight 0 or without one, which share alike behind them."""
    if weights:
        if min(weights.values()) < 0:
            raise ValueError("a weight is negative")
        given = F.create_map(*(F.lit(x) for k, w in weights.items() for x in ("s" + k, float(w))))
        w = F.coalesce(F.try_element_at(given, F.col("key")), F.lit(0.0))
    else:
        w = F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE))
    last, blocks = w <= 0, F.ceil(F.col("n") / block_rows).cast("long")
    one = F.struct("key", blocks.alias("blocks"), F.when(last, 1.0).otherwise(w).alias("w"))
    return counts.groupBy(last.alias("last")).agg(F.array_sort(F.collect_list(one)).alias("s"), F.sum(blocks).alias("total"))


def flow_time(sources: Column, v: Column) -> Column:
    """Blocks of all sources that have flowed by the time at which an endless source of weight 1 has given ``v``."""
    return F.aggregate(sources, F.lit(0.0), lambda t, x: t + F.least(x["w"] * v, x["blocks"].cast("double")))


def windows(sources: Column) -> Column:
    """Release times and deadlines: a struct of two arrays, in each an array of the blocks for every source."""
    ends = F.transform(sources, lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["blocks"]), lambda k: F.round(flow_time(sources, k / x["w"]), DIGITS)))

    def slots(e: Column) -> Column:
        released = F.transform(F.slice(e, F.lit(1), F.size(e) - 1), lambda t: F.floor(t).cast("long"))
        due = F.transform(F.slice(e, F.lit(2), F.size(e) - 1), lambda t: F.ceil(t).cast("long"))
        return F.struct(released.alias("released"), due.alias("due"))

    return _bound(F.transform(ends, slots), lambda x: F.struct(x["released"].alias("released"), x["due"].alias("due")))


def earliest_deadline_first(w: Column, total: Column) -> Column:
    """The source (its place) and its block for every slot; ``w`` has the windows of all blocks, ``total`` is their number."""
    order_type = "array<struct<i:int,k:bigint>>"

    def first_due(done: Column, upto: Column) -> Column:
        def job(k: Column, i: Column) -> Column:
            due = F.get(F.get(w["due"], i), k.cast("int"))
            return F.struct(F.when(F.get(F.get(w["released"], i), k.cast("int")) <= upto, due).alias("due"), i.alias("i"))

        return F.array_min(F.filter(F.transform(done, job), lambda j: j["due"].isNotNull()))["i"]

    def step(state: Column, t: Column) -> Column:
        done = state["done"]
        # Some block is always released; the second choice only keeps the plan whole if weights are beyond a double's digits.
        chosen = F.coalesce(first_due(done, t), first_due(done, F.lit(2**62)))
        return _bound(
            chosen,
            lambda c: F.struct(
                F.transform(done, lambda d, i: F.when(i == c, d + 1).otherwise(d)).alias("done"),
                F.array_append(state["order"], F.struct(c.alias("i"), F.get(done, c).alias("k"))).alias("order"),
            ),
        )

    def chunk(state: Column, a: Column) -> Column:
        slots = F.sequence(a, F.least(a + (CHUNK - 1), total - 1))
        part = F.aggregate(slots, F.struct(state["done"].alias("done"), F.array().cast(order_type).alias("order")), step)
        return _bound(part, lambda x: F.struct(x["done"].alias("done"), F.array_append(state["orders"], x["order"]).alias("orders")))

    start = F.struct(F.transform(w["due"], lambda _: F.lit(0).cast("long")).alias("done"), F.array().cast(f"array<{order_type}>").alias("orders"))
    return F.flatten(F.aggregate(F.sequence(F.lit(0).cast("long"), total - 1, F.lit(CHUNK).cast("long")), start, chunk, lambda state: state["orders"]))


def plan_of(counts: DataFrame, weights: Mapping[str, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, block, released, due, slot: one row for each block of each source (``counts``: key, n).

    A slot depends on all before it, so one task makes the plan: ``MAX_BLOCKS`` blocks and one for each source at most, whatever the
    size of the table. Its time follows blocks times sources.
    """
    tiers = _tiers(counts, weights, block_rows)
    before = Window.partitionBy(F.lit(1)).orderBy("last").rowsBetween(Window.unboundedPreceding, -1)  # two rows
    tiers = tiers.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long"))

    def rows(w: Column) -> Column:
        def row(x: Column, slot: Column) -> Column:
            i, k = x["i"], x["k"].cast("int")
            at = lambda c: (F.col("base") + F.get(F.get(w[c], i), k)).alias(c)
            return F.struct(F.get("s", i)["key"].alias("key"), x["k"].alias("block"), at("released"), at("due"), (F.col("base") + slot).cast("long").alias("slot"))

        return F.transform(earliest_deadline_first(w, F.col("total")), row)

    return tiers.select(F.explode(_bound(windows(F.col("s")), rows)).alias("x")).select("x.*")


def with_positions(docs: DataFrame, weights: Mapping[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", out: str = "__mix") -> DataFrame:
    """``docs`` with a struct ``out``: block, released, due, slot (gapless from 0) and rank (row of the block).

    Rows of a source are dealt to blocks in the order of a hash of all their columns, so rows with equal or null ids are ranked in as
    many tasks as others; only rows that are equal throughout share one, and their places don't tell them apart. A null source is a source
    of its own. Sources of weight 0 or without a weight come behind all others and share alike. Repeated rows and null ids are kept. An
    empty table gives no rows. Columns of ``docs`` may have any name but ``out``.
    """
    source, own_id, h = F.col(f"`{source_col}`"), F.col(f"`{id_col}`"), free_name(docs, "__at")
    key, digest, bucket, rank = (F.col(f"{h}_{n}") for n in ("key", "digest", "bucket", "rank"))
    rows = docs.withColumns({f"{h}_key": source_key(source), f"{h}_digest": F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind))})
    counts = rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    n_rows, n_most, n_sources = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).head()
    block_rows = max(BLOCK_ROWS, -(-n_rows // MAX_BLOCKS))
    n_buckets = max(16, -(-n_most // BUCKET_ROWS))
    rows = rows.withColumn(f"{h}_bucket", F.pmod(digest, F.lit(n_buckets)).cast("int"))
    sizes = rows.groupBy(key.alias("key"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.struct("key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n")).alias(f"{h}_offset"))
    offset = lambda n: F.col(f"{h}_offset.{n}")
    ranked = rows.withColumn(f"{h}_rank", F.row_number().over(Window.partitionBy(key, bucket).orderBy(digest, own_id)) - 1)
    ranked = ranked.join(offsets, (key == offset("key")) & (bucket == offset("bucket"))).withColumn(f"{h}_rank", rank + offset("n"))
    plan = plan_of(counts, weights, block_rows).select(F.struct("*").alias(f"{h}_plan"))
    if n_rows / block_rows + n_sources <= MAX_BROADCAST_BLOCKS:
        plan = F.broadcast(plan)
    at = lambda n: F.col(f"{h}_plan.{n}")
    placed = ranked.join(plan, (key == at("key")) & (F.floor(rank / block_rows).cast("long") == at("block")))
    mix = F.struct(*(at(n).alias(n) for n in ("block", "released", "due", "slot")), (rank % block_rows).cast("long").alias("rank"))
    return placed.select(*(F.col(f"`{c}`") for c in docs.columns), mix.alias(out))


def schedule(docs: DataFrame, weights: Mapping[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """doc_id, source, block, released, due, slot, rank: one row per row of ``docs``. Other columns don't count; see ``with_positions``."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"))
    return with_positions(rows, weights, "source", "doc_id").select("doc_id", "source", "__mix.*")


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``docs`` in the order of the schedule: partitions are ranges of it, each sorted, so that the files written follow it.

    All rows and columns stay; see ``with_positions`` for nulls, repeats and ties.
    """
    place = free_name(docs, "__mix")
    order = [f"{place}.slot", f"{place}.rank"]
    placed = with_positions(docs, weights, source_col, id_col, place).repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select(*(F.col(f"`{c}`") for c in docs.columns))
