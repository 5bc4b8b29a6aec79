"""Exact top-k search: columnar branch-and-bound. Inner products grow dimension block by block over vectors in vertical layout.

A pair's score is what its first dimensions give and what the rest can add: at most the product of both remaining norms (Cauchy and
Schwarz). A pair whose bound is below the k-th best score of its query so far leaves; the surviving candidates are compacted block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmark.llm.common import give_back_memory, materialize

SCALE, TOP, EVERY = 64, 20, 20
#: Vectors of a pack, and queries of a block, about: a task holds one block of queries and one pack.
PACK_ROWS, BLOCK_QUERIES = 2048, 16_384
#: Candidates that a task compares with its block of queries, about.
CELL_ROWS = 4_000_000
#: Dimensions that are added up before the bounds are tested again, and queries that go through a pack at once.
DIMENSIONS, SLICE = 16, 256
#: Components are held within this; beyond it they count as it.
LARGEST = 2.0**62
_PACK = "kind int, n long, dims int, width int, ids binary, rows binary, data binary"


def whole_components(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of the vectors that count, one a row, and their places. Shorter vectors end in zeros.

    Null vectors and those with a null or not finite component don't count.
    """
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is NaN
    owner = np.repeat(np.arange(len(sizes)), sizes)
    good = vectors.is_valid().to_numpy(zero_copy_only=False)
    good[owner[~np.isfinite(values)]] = False
    keep = good[owner]
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), int(sizes[good].max(initial=0))))
    with np.errstate(over="ignore"):
        out[owner[keep], place[keep]] = np.clip(np.floor(values[keep] * scale), -LARGEST, LARGEST)
    at = np.flatnonzero(good)
    return out[at].astype(np.int64), at


def packs_of(vectors: DataFrame, every: int, scale: int, pack_rows: int = PACK_ROWS) -> DataFrame:
    """Rows (kind 0: queries, 1: all) of packs: ids, row numbers and components, these dimension by dimension in the narrowest whole type.

    ``vectors``: id, row, vector.
    """

    def pack(kind: int, ids: np.ndarray, rows: np.ndarray, x: np.ndarray) -> list:
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        kept = next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)
        return [kind, len(ids), x.shape[1], np.dtype(kept).itemsize, ids.tobytes(), rows.tobytes(), np.ascontiguousarray(x.T.astype(kept)).tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        for b in batches:
            for at in range(0, b.num_rows, pack_rows):
                part = b.slice(at, pack_rows)
                x, kept = whole_components(part.column("vector"), scale)
                ids, rows = (part.column(c).to_numpy(zero_copy_only=False)[kept].astype(np.int64) for c in ("id", "row"))
                asks = ids % every == 0
                made = [pack(k, ids[m], rows[m], x[m]) for k, m in ((0, asks), (1, np.ones(len(ids), bool))) if m.any()]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], [f.split()[0] for f in _PACK.split(", ")])

    return vectors.mapInArrow(run, _PACK)


class Pack:
    """Vectors dimension by dimension: ``data[d]`` holds component d of all of them; ``rest[b]`` their norms from block b on."""

    def __init__(self, r: dict, dims: int) -> None:
        self.ids, self.rows = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64)
        data = np.frombuffer(r["data"], f"<i{r['width']}").reshape(r["dims"], r["n"])
        self.data = np.zeros((dims, r["n"]), np.int64)
        self.data[: r["dims"]] = data
        self.most = max(int(self.data.max(initial=0)), -int(self.data.min(initial=0)))
        squares = np.square(self.data.astype(np.float64))
        ends = [squares[b:].sum(axis=0) for b in range(DIMENSIONS, dims, DIMENSIONS)]
        self.rest = [np.sqrt(x) * (1 + 1e-6) for x in ends]


def number_type(most: int, other: int, dims: int) -> type:
    """In which sums of products are exact: floats while all sums stay within their digits, else whole numbers, at last Python's."""
    bound = max(1, most) * max(1, other) * max(1, dims)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object


class Best:
    """The best ``k`` of every query so far: scores (falling), ids and row numbers; free places have the least score."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.size = k, np.zeros(n, np.int64)
        self.scores = np.full((n, k), np.iinfo(np.int64).min)
        self.ids, self.rows = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), np.iinfo(np.int64).max)

    def floor(self, i: slice) -> np.ndarray:
        """Scores below this can't enter (a little less than the last place, as sums of long numbers round); all can while a place is free."""
        last = self.scores[i, -1].astype(np.float64)
        return np.where(self.size[i] == self.k, last - np.abs(last) * 2.0**-48, -np.inf)

    def put(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Pairs of query numbers and candidates. Ties go by id, then by row."""
        last = self.scores[q, -1], self.ids[q, -1], self.rows[q, -1]
        enters = (scores > last[0]) | (scores == last[0]) & ((ids < last[1]) | (ids == last[1]) & (rows < last[2])) | (self.size[q] < self.k)
        q, scores, ids, rows = q[enters], scores[enters], ids[enters], rows[enters]
        if not len(q):
            return
        some = np.unique(q)
        held = np.repeat(some, self.size[some])
        old = np.arange(len(held)) - np.repeat(np.cumsum(self.size[some]) - self.size[some], self.size[some])
        q, scores = np.concatenate([held, q]), np.concatenate([self.scores[held, old], scores])
        ids, rows = np.concatenate([self.ids[held, old], ids]), np.concatenate([self.rows[held, old], rows])
        order = np.lexsort((rows, ids, ~scores, q))  # ~ turns the order of whole numbers around without overflow
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        q, place, order = q[top], place[top], order[top]
        self.scores[q, place], self.ids[q, place], self.rows[q, place] = scores[order], ids[order], rows[order]
        self.size[some] = np.bincount(q, minlength=len(self.size))[some]


def search(queries: Pack, pack: Pack, best: Best) -> int:
    """Lets a pack's candidates enter the best of all queries; gives the number of products of dimensions made (for tests)."""
    dims, made = len(pack.data), 0
    kind = number_type(queries.most, pack.most, dims)
    data = pack.data.astype(kind)
    for a in range(0, len(queries.ids), SLICE):
        part = slice(a, a + SLICE)
        asked, floor = np.ascontiguousarray(queries.data[:, part].T).astype(kind), best.floor(part)
        columns, pairs = np.arange(len(pack.ids)), None
        sums = np.zeros((len(asked), len(columns)), kind)
        for b in range(0, dims, DIMENSIONS):
            block = slice(b, b + DIMENSIONS)
            last = b + DIMENSIONS >= dims
            rest = None if last else (queries.rest[b // DIMENSIONS][part], pack.rest[b // DIMENSIONS])
            if pairs is None:
                sums += asked[:, block] @ (data[block] if len(columns) == len(pack.ids) else data[block][:, columns])
                made += sums.size * DIMENSIONS
                bound = sums.astype(np.float64) if last else sums + rest[0][:, None] * rest[1][columns][None, :]
                alive = bound >= floor[:, None]
                n = int(np.count_nonzero(alive))
                if last or n * 8 < alive.size:  # few pairs are left: from here on each by itself
                    i, j = np.nonzero(alive)
                    pairs, sums = (i, columns[j]), sums[i, j]
                else:
                    some = alive.any(axis=0)
                    if np.count_nonzero(some) * 4 < len(some) * 3:
                        columns, sums = columns[some], sums[:, some]
            else:
                i, j = pairs
                more = np.empty(len(i), kind)
                for at in range(0, len(i), 1 << 16):
                    s = slice(at, at + (1 << 16))
                    more[s] = (asked[i[s], block] * data[block][:, j[s]].T).sum(axis=1)
                sums = sums + more
                made += len(i) * DIMENSIONS
                bound = sums.astype(np.float64) if last else sums + rest[0][i] * rest[1][j]
                alive = bound >= floor[i]
                pairs, sums = (i[alive], j[alive]), sums[alive]
        i, j = pairs if pairs is not None else (np.zeros(0, np.int64),) * 2
        if kind is object:
            sums = np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in sums], np.int64)
        other = queries.rows[part][i] != pack.rows[j]
        i, j, sums = i[other], j[other], sums[other].astype(np.int64)
        if len(i) > 4 * best.k * len(asked):  # the first packs: all candidates, of which the best few are found by selection
            i, j, sums = _selected(i, j, sums, best.k)
        best.put(a + i, sums, pack.ids[j], pack.rows[j])
    return made


def _selected(i: np.ndarray, j: np.ndarray, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs, sorted by query, those at least as good as their query's ``k``-th best."""
    starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    kept = []
    for a, b in zip(starts, [*starts[1:], len(i)]):
        s = sums[a:b]
        kept.append(a + (np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))))
    at = np.concatenate(kept)
    return i[at], j[at], sums[at]


def joined_packs(packs: list[dict]) -> Pack:
    """One pack of all vectors of the given ones."""
    dims = max(-(-p["dims"] // DIMENSIONS) for p in packs) * DIMENSIONS
    parts = [Pack(p, max(dims, DIMENSIONS)) for p in packs]
    whole = parts[0]
    whole.ids, whole.rows = (np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "rows"))
    whole.data, whole.most = np.concatenate([p.data for p in parts], axis=1), max(p.most for p in parts)
    whole.rest = [np.concatenate(x) for x in zip(*(p.rest for p in parts))]
    return whole


def widened(p: Pack, dims: int) -> Pack:
    """The pack with components of 0 up to so many dimensions."""
    more = dims - len(p.data)
    if more > 0:
        p.data = np.concatenate([p.data, np.zeros((more, p.data.shape[1]), p.data.dtype)])
        p.rest += [np.zeros(p.data.shape[1])] * (dims // DIMENSIONS - 1 - len(p.rest))
    return p


def top_k(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = TOP, scale: int = SCALE,
    pack_rows: int = PACK_ROWS, block_queries: int = BLOCK_QUERIES, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id ``every`` divides, the ``k`` other rows with the largest inner product.

    Components count as floor(scale * x). Ties go to the smaller id. A vector that is null or holds a null, a NaN or an infinity takes no
    part, and neither does a row without an id. Vectors of different lengths are compared as if the shorter went on with zeros. Rows with
    equal ids are rows of their own, as queries and as candidates. Fewer candidates than ``k`` give fewer rows; an empty table none.
    Scores beyond 64 bits count as the largest or least such number. Other columns don't count.

    Vectors are packed in vertical layout and written once. Blocks of queries meet groups of packs in cells, which are as many tasks: a task
    holds the queries of its block and reads the packs one after the other, so it prunes by all that it has seen. The best of each cell
    are merged by query.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    packs = materialize(packs_of(own.filter("id is not null and vector is not null"), every, scale, pack_rows), "packs")
    count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    n_queries, n = packs.agg(count(0), count(1)).head()
    n_blocks = max(1, -(-n_queries // block_queries))
    n_groups = max(1, -(-n // cell_rows), min(-(-n // pack_rows), -(-2 * spark.sparkContext.defaultParallelism // n_blocks)))
    dealt = F.xxhash64("ids", "rows")
    block = F.when(F.col("kind") == 0, F.array(F.pmod(dealt, F.lit(n_blocks)))).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    group = F.when(F.col("kind") == 1, F.array(F.pmod(dealt, F.lit(n_groups)))).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long")))
    placed = packs.withColumn("block", F.explode(block)).withColumn("group", F.explode(group)).withColumn("cell", F.col("block") * n_groups + F.col("group"))
    cells = placed.select("cell", *packs.columns).repartition(int(n_blocks * n_groups), "cell").sortWithinPartitions("cell", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, asked, best = None, [], None, None

        def found() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(asked.ids) if best else 0, 4096):
                size = best.size[a : a + 4096]
                q = a + np.repeat(np.arange(len(size)), size)
                at = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)
                columns = [asked.rows[q], asked.ids[q], best.ids[q, at], best.rows[q, at], best.scores[q, at]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_row", "query_id", "vec_id", "vec_row", "score"])

        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if r["cell"] != cell:
                    yield from found()
                    cell, held, asked, best = r["cell"], [], None, None
                if r["kind"] == 0:
                    held.append(r)
                    continue
                if held and best is None:
                    asked = joined_packs(held)
                    held, best = [], Best(len(asked.ids), k)
                if best:
                    pack = Pack(r, max(-(-r["dims"] // DIMENSIONS) * DIMENSIONS, len(asked.data)))
                    search(widened(asked, len(pack.data)), pack, best)
        yield from found()
        give_back_memory()

    parts = materialize(cells.mapInArrow(run, "query_row long, query_id long, vec_id long, vec_row long, score long"), "best")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    ranked = parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
