"""Merkle dataset manifest: blocks of leaves are reduced on the executors, the driver builds the small top, executors fold every proof.

Leaves of a group (a language, say) ascend by key. Of the nodes of a level every two consecutive ones become their digest, a last single
one alone too, while more than one is left: what stays is the group's subroot, and the subroots in the order of the groups give the root
likewise. Node k of level L covers leaves k * 2**L up to (k + 1) * 2**L, so a block of 2**L leaves makes its node without any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmark.llm.common import materialize

#: Levels that one task reduces at once: a block has up to 2 to this power nodes.
BLOCK_BITS = 12
#: Nodes of which the driver builds the top, at most; while there are more, executors reduce blocks of them again.
TOP_NODES = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: A step of a proof is the side of the sibling and its digest, or this mark where a node is alone.
ALONE = "-"


_WAY = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("steps", pa.list_(pa.string())), ("subroot", pa.string())])


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """The SHA-256 digest (binary) of the fields of a row."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def node(children: Sequence[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def levels_of(nodes: list[str], height: int | None = None) -> list[list[str]]:
    """All levels from ``nodes`` to the single node that stays, or exactly ``height`` levels above them."""
    levels = [nodes]
    while len(levels[-1]) > 1 if height is None else len(levels) <= height:
        below = levels[-1]
        levels.append([node(below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def steps_of(levels: list[list[str]], i: int) -> list[str]:
    """The proof of node ``i`` of the lowest level."""
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append(ALONE if j >= len(level) else ("L" if j < i else "R") + level[j])
        i >>= 1
    return out


def folded(start: str, steps: Sequence[str]) -> str:
    """The root that a node and its proof give."""
    at = start
    for s in steps:
        at = node((at,) if s == ALONE else (s[1:], at) if s[0] == "L" else (at, s[1:]))
    return at


def positioned(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a column ``g``) and their place ``pos`` in the group by ``order``, and its size ``n``.

    Ranges of (g, order) are sorted one in a task; offsets come from one row for each range and group. No group meets in one task.
    """
    ranged = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("m", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranges").withColumn("part", F.shiftright("m", 33))
    parts = ranged.groupBy("g", "part").agg(F.min("m").alias("first"), F.count(F.lit(1)).alias("k"))
    whole = Window.partitionBy("g")
    before = F.coalesce(F.sum("k").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("k").over(whole).alias("n"))
    placed = ranged.join(offsets, ["g", "part"]).withColumn("pos", F.col("m") + F.col("shift"))
    return placed.drop("m", "part", "shift")


def packed(nodes: DataFrame, carried: list[str], bits: int) -> DataFrame:
    """g, block, n_blocks, root and arrays of ``node`` and the ``carried`` columns in the order of ``pos``: one row a block.

    ``nodes``: g, pos, n (nodes of the group), node and the carried columns. A group of one block ends in its last single node.
    """
    columns = ["node", *carried]
    rows = nodes.select("g", F.shiftright("pos", bits).alias("block"), "pos", "n", *columns)
    kinds = dict(rows.dtypes)
    schema = "g string, block long, n_blocks long, root string, " + ", ".join(f"`{c}` array<{kinds[c]}>" for c in columns)

    def block(held: pa.Table) -> pa.RecordBatch:
        n_blocks = -(-held["n"][0].as_py() // (1 << bits))
        root = levels_of([x.hex() for x in held["node"].to_pylist()], None if n_blocks == 1 else bits)[-1][0]
        whole = [held[c].combine_chunks() for c in columns]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in whole]
        first = [pa.array([held[c][0].as_py()], k) for c, k in (("g", pa.string()), ("block", pa.int64()))]
        return pa.RecordBatch.from_arrays([*first, pa.array([n_blocks], pa.int64()), pa.array([root], pa.string()), *lists], ["g", "block", "n_blocks", "root", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in filter(len, batches):
            starts = np.flatnonzero(b.column("pos").to_numpy() & ((1 << bits) - 1) == 0).tolist()
            if starts[:1] != [0]:  # goes on with the block before
                starts = [0, *starts]
            elif held:
                yield block(pa.Table.from_batches(held))
                held = []
            for at, end in zip(starts, [*starts[1:], b.num_rows]):
                held.append(b.slice(at, end - at))
                if end < b.num_rows:
                    yield block(pa.Table.from_batches(held))
                    held = []
        if held:
            yield block(pa.Table.from_batches(held))

    dealt = rows.repartition("g", "block").sortWithinPartitions("g", "block", "pos")
    return materialize(dealt.mapInArrow(run, schema), "blocks")


def climb(nodes: DataFrame, bits: int, top: int) -> DataFrame:
    """g, pos, steps, subroot: the way of every node (g, pos, n, node as binary) to the root of its group.

    Up to ``top`` nodes go to the driver, which builds their trees; the rows that it gives back are as many, and are broadcast. More are
    reduced by blocks, until they are few or each group has one left.
    """
    spark = nodes.sparkSession
    total, longest = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).head()
    if total <= top:
        by_group: dict[str, list[str]] = {}
        for r in sorted(nodes.select("g", "pos", F.lower(F.hex("node")).alias("node")).collect(), key=lambda r: (r.g, r.pos)):
            by_group.setdefault(r.g, []).append(r.node)
        ways = []
        for g, level in by_group.items():
            levels = levels_of(level)
            ways += [(g, i, steps_of(levels, i), levels[-1][0]) for i in range(len(level))]
        return F.broadcast(spark.createDataFrame(ways, "g string, pos long, steps array<string>, subroot string"))
    if longest == 1:
        return nodes.select("g", "pos", F.array().cast("array<string>").alias("steps"), F.lower(F.hex("node")).alias("subroot"))
    blocks = packed(nodes, [], bits)
    upper = climb(blocks.select("g", F.col("block").alias("pos"), F.col("n_blocks").alias("n"), F.unhex("root").alias("node")), bits, top)
    return materialize(along(blocks, upper, bits), "ways")


def along(blocks: DataFrame, upper: DataFrame, bits: int) -> DataFrame:
    """The rows of blocks with ``steps`` through the block and on to the root of their group: g, pos, steps, subroot."""
    met = blocks.join(upper.select("g", F.col("pos").alias("block"), F.col("steps").alias("on"), "subroot"), ["g", "block"]).select("g", "block", "n_blocks", "node", "on", "subroot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                nodes = [x.hex() for x in r["node"]]
                levels = levels_of(nodes, None if r["n_blocks"] == 1 else bits)
                ways = [steps_of(levels, i) + r["on"] for i in range(len(nodes))]
                columns = [r["g"]] * len(nodes), [(r["block"] << bits) + i for i in range(len(nodes))], ways, [r["subroot"]] * len(nodes)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _WAY)], schema=_WAY)

    return met.mapInArrow(run, "g string, pos long, steps array<string>, subroot string")


def manifest(
    docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, changes: Mapping[str, Column] | None = None, changed: Column | None = None,
    proofs: bool = True, bits: int = BLOCK_BITS, top: int = TOP_NODES,
) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified and, if ``proofs``, proof (steps from the leaf to the root).

    One row per row of ``docs``.

    ``changes`` gives fields new values where ``changed`` is true: such a row's leaf is made of them, and its proof is folded from it; leaf,
    subroot, root and proof are those of the data before. Leaves ascend by key, null first; rows of equal keys by their leaf, so repeated
    rows have equal leaves at places of their own. A null group comes first and is none of the named ones. A null field is ``-``, an
    empty text ``0:``. A lone leaf is its subroot, a lone subroot the root. An empty table gives no rows. Other columns don't count.
    """
    col = lambda c: F.col(f"`{c}`")
    own = leaf([col(c) for c in fields])
    other = F.when(changed, leaf([(changes or {}).get(c, col(c)) for c in fields])) if changed is not None else F.lit(None).cast("binary")
    # '-' is less than 's', and Spark compares strings by their UTF-8 bytes.
    rows = docs.select(F.coalesce(F.concat(F.lit("s"), col(group).cast("string")), F.lit("-")).alias("g"), col(key).alias("id"), own.alias("node"), other.alias("other"))
    rows = positioned(materialize(rows, "leaves"), ["id", "node"])
    blocks = packed(rows, ["id", "other"], bits)
    upper = climb(blocks.select("g", F.col("block").alias("pos"), F.col("n_blocks").alias("n"), F.unhex("root").alias("node")), bits, top)
    roots = upper.filter("pos = 0").select(F.lit("").alias("g"), F.col("g").alias("lang"), F.unhex("subroot").alias("node"))
    roots = positioned(roots, ["lang"])
    tops = roots.join(climb(roots.select("g", "pos", "n", "node"), bits, top), ["g", "pos"]).select(F.col("lang").alias("g"), F.col("steps").alias("last"), F.col("subroot").alias("root"))
    ways = upper.join(tops, "g").select("g", F.col("pos").alias("block"), F.concat("steps", "last").alias("on"), "subroot", F.col("root").alias("whole"))
    met = blocks.join(ways, ["g", "block"]).select("n_blocks", "id", "node", "other", "on", "subroot", "whole")
    names = [key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *["proof"] * proofs]
    id_type = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof array<string>" * proofs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids = b.column("id").slice(k, 1).flatten()
                r = {c: b.column(c)[k].as_py() for c in ("n_blocks", "node", "other", "on", "subroot", "whole")}
                leaves, n = [x.hex() for x in r["node"]], len(r["node"])
                levels = levels_of(leaves, None if r["n_blocks"] == 1 else bits)
                ways = [steps_of(levels, i) + r["on"] for i in range(n)]
                folds = [folded(x if o is None else o.hex(), w) for x, o, w in zip(leaves, r["other"], ways)]
                siblings = [node([s[1:] for s in w if s != ALONE]) for w in ways]
                out = [ids, *(pa.array(x) for x in (leaves, [r["subroot"]] * n, [r["whole"]] * n, siblings, folds, [f == r["whole"] for f in folds]))]
                out += [pa.array(ways, pa.list_(pa.string()))] * proofs
                yield pa.RecordBatch.from_arrays(out, names)

    return met.mapInArrow(run, schema)
