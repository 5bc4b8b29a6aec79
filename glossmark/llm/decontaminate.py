"""Benchmark decontamination: an FM-index per shard of training text answers every benchmark phrase by backward search."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from glossmark.llm.common import give_back_memory, materialize, text_slices
from glossmark.llm.fm_index import MAX_WORDS, FMIndex

WINDOW = 10
#: Benchmark text in one block, about: the driver and every task hold the phrases of one block at a time.
BLOCK_BYTES = 8 << 20
#: Bytes of training text in one shard, about.
SHARD_BYTES = 4 << 20

# A-Z become a-z, the other ASCII characters that are not letters or digits become spaces; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

HITS = "n_words long, starts array<int>, ends array<int>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, as UTF-8. A null text has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Phrases:
    """The windows of a block of benchmark items, over a vocabulary of their own words (numbers from 1)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).update(() if item is None else (item,))
        self.items = [tuple(sorted(x)) for x in found.values()]
        self.lengths = np.array([len(p) for p in found], dtype=np.int64)
        self.patterns = np.zeros((len(found), window), np.int64)
        for i, p in enumerate(found):
            self.patterns[i, : len(p)] = p
        self.shortest, self.longest = int(self.lengths.min(initial=window)), int(self.lengths.max(initial=0))

    def shards(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sequences for an index and the place of each of their symbols in ``ids``.

        A word outside the vocabulary (0) ends every phrase, so the text falls into runs between them, and runs shorter than the
        shortest phrase hold none. A run longer than an index is cut with an overlap of a phrase less one word.
        """
        edge = np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]]))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long_enough = ends - begins >= self.shortest
        parts, size = [], 0
        for a, b in zip(begins[long_enough].tolist(), ends[long_enough].tolist()):
            while a < b:
                take = min(b - a, MAX_WORDS - 1)
                if size + take + 1 > MAX_WORDS:
                    yield self._joined(ids, parts)
                    parts, size = [], 0
                parts.append((a, a + take))
                size += take + 1
                a = b if a + take == b else a + take - self.longest + 1
        if parts:
            yield self._joined(ids, parts)

    @staticmethod
    def _joined(ids: np.ndarray, parts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        begins, ends = np.array(parts).T
        sizes = ends - begins + 1
        # Each run with the place after it, whose symbol becomes the separator 0.
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - begins, sizes)
        last = np.cumsum(sizes) - 1
        seq = ids[np.minimum(place, len(ids) - 1)].astype(np.int64)
        seq[last] = 0
        return seq, place

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase numbers and start places of all occurrences in ``ids``."""
        phrase, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for seq, place in self.shards(ids) if len(self.patterns) else ():
            index = FMIndex(seq, len(self.vocab) + 1)
            lo, hi = index.search(self.patterns, self.lengths)
            n = hi - lo
            which = np.repeat(np.arange(len(n)), n)
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
            phrase.append(which)
            at.append(place[index.locate(rows)])
        return np.concatenate(phrase), np.concatenate(at)

    def hits(self, texts: list[str | None]) -> list[tuple[int, list, list, list]]:
        """n_words, merged spans of hit words (starts, ends) and the items found, for each text."""
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        # A separator after each text, so that no phrase runs across texts.
        first = np.concatenate([[0], np.cumsum(sizes + 1)])
        ids = np.zeros(first[-1], np.int32)
        for a, w in zip(first.tolist(), words):
            ids[a : a + len(w)] = np.fromiter(map(self.vocab.get, w, repeat(0)), np.int32, len(w))
        phrase, at = self.occurrences(ids)
        doc = np.searchsorted(first, at, side="right") - 1
        out: list[tuple[int, list, list, list]] = [(int(n), [], [], []) for n in sizes]
        order = np.lexsort((at, doc))
        phrase, at, doc = phrase[order], at[order] - first[doc[order]], doc[order]
        cut = np.flatnonzero(np.diff(doc)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(doc)]):
            if a == b:
                continue
            begins, ends = at[a:b], np.maximum.accumulate(at[a:b] + self.lengths[phrase[a:b]])
            new = np.concatenate([[True], begins[1:] > ends[:-1]])
            stops = np.concatenate([np.flatnonzero(new)[1:] - 1, [b - a - 1]])
            found = {i for p in np.unique(phrase[a:b]).tolist() for i in self.items[p]}
            out[doc[a]] = (out[doc[a]][0], begins[new].tolist(), ends[stops].tolist(), sorted(found))
        return out


def phrase_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Phrases]:
    """The benchmark's phrases, one block of about ``block_bytes`` of text after the other; repeated rows count once.

    A benchmark of several blocks is written once by blocks, so that each is read alone.
    """
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    n = max(1, -(-size // block_bytes))
    if n == 1:
        yield Phrases([(r.item, r.text) for r in rows.distinct().collect()], window)
        return
    rows = materialize(rows.distinct().withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))), "phrases", "block")
    for k in range(n):
        yield Phrases([(r.item, r.text) for r in rows.filter(F.col("block") == k).collect()], window)


def hit_columns(phrases: Phrases, text: Column) -> Column:
    """A struct of ``HITS`` for a text column. Each run of ``SHARD_BYTES`` of a task's documents is a shard with its own index."""
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
    names = ["n_words", "starts", "ends", "items"]

    def hits(texts: pa.Array) -> pa.Array:
        found = [x for at, n in text_slices(texts, SHARD_BYTES) for x in phrases.hits(texts.slice(at, n).to_pylist())]
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(zip(*found) if found else [[]] * 4, kinds)], names)

    return F.arrow_udf(hits, HITS)(text)


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "hits") -> DataFrame:
    """``docs`` with a struct ``out``: n_words, starts and ends of hit word spans, items. No shuffle.

    A null, empty or wordless text has no words and no hits. A benchmark row without words gives no phrase; one with a null id
    hits words but adds no item. Repeated rows and null ids are kept. An empty table of either kind gives no hits.
    A benchmark of several blocks takes a pass over the documents for each; what is found is written with them in between.
    Spans of different blocks can overlap; ``n_hit`` counts words once.
    """
    text = F.col(f"`{text_col}`").cast("string")
    for k, block in enumerate(phrase_blocks(benchmark)):
        if not k:
            docs = docs.withColumn(out, hit_columns(block, text))
            continue
        now, new = f"__{out}_before", f"__{out}_now"
        both = lambda part: F.concat(F.col(f"{now}.{part}"), F.col(f"{new}.{part}"))  # noqa: E731,B023
        docs = materialize(docs, "hits").withColumnRenamed(out, now).withColumn(new, hit_columns(block, text))
        joined = F.struct(F.col(f"{now}.n_words").alias("n_words"), both("starts").alias("starts"), both("ends").alias("ends"), F.array_distinct(both("items")).alias("items"))
        docs = docs.withColumn(out, joined).drop(now, new)
    return docs


def n_hit(starts: Column, ends: Column) -> Column:
    """Words inside any span, each once."""
    words = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: F.sequence(s["a"], s["b"] - 1)))
    return F.size(F.array_distinct(words)).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted), starts, ends: one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = find_hits(rows, benchmark)
    h = "hits."
    return found.select("doc_id", f"{h}n_words", n_hit(F.col(f"{h}starts"), F.col(f"{h}ends")).alias("n_hit"), F.sort_array(f"{h}items").alias("items"), f"{h}starts", f"{h}ends")


def excise(text: str, starts: list[int], ends: list[int]) -> str:
    """``text`` without the words of the spans; a line break stands for each, so that no new phrase arises across it."""
    # ASCII folding changes no word border, so words are found in the text itself.
    words = [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010FFFF]+", text)]
    out, at = [], 0
    for a, b in sorted(zip(starts, ends)):
        out.append(text[at : max(at, words[a][0])])
        at = max(at, words[b - 1][1])
    return "\n".join([*out, text[at:]])


def cleaned(text: str, starts: list[int], ends: list[int], n_words: int) -> str | None:
    """``text`` without the words of the spans; None if no other word is left."""
    hit = np.zeros(n_words, bool)
    for a, b in zip(starts, ends):
        hit[a:b] = True
    return None if hit.all() else excise(text, starts, ends)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the benchmark's passages, with their own columns; ``n_chars``, if there, follows the text.

    Documents without a hit stay as they are. Those of which nothing but hit words remains go. A text that is cut is a string.
    One pass of Python for each block of the benchmark: what earlier blocks found is written with the documents in between.
    """
    names = docs.columns
    if dict(docs.dtypes)[text_col] != "string":
        docs = docs.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    schema, before = docs.schema, "__spans_before"

    def passed(phrases: Phrases, is_last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at, n in text_slices(whole.column(names.index(text_col)), SHARD_BYTES):
                    b = whole.slice(at, n)
                    texts = b.column(names.index(text_col)).to_pylist()
                    found = phrases.hits(texts)
                    spans = [list(zip(x[1], x[2])) for x in found]
                    if before in b.schema.names:
                        spans = [[*new, *zip(old[0::2], old[1::2])] for new, old in zip(spans, b.column(before).to_pylist())]
                    if is_last:
                        yield _cut(b, names, text_col, texts, spans, [x[0] for x in found])
                    else:
                        flat = pa.array([[int(k) for s in x for k in s] for x in spans], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), flat], [*names, before])
            give_back_memory()

        return run

    for block, is_last in with_last(phrase_blocks(benchmark)):
        kept = schema if is_last else StructType([*schema.fields, StructField(before, ArrayType(IntegerType()))])
        docs = docs.mapInArrow(passed(block, is_last), kept)
        if not is_last:
            docs = materialize(docs, "spans")
    return docs


def _cut(b: pa.RecordBatch, names: list[str], text_col: str, texts: list, spans: list, sizes: list[int]) -> pa.RecordBatch:
    """The rows of a batch without the hit words."""
    stays = np.ones(len(texts), bool)
    hit = [i for i, x in enumerate(spans) if x]
    columns = {x: b.column(x) for x in names}
    for i in hit:
        texts[i] = cleaned(texts[i], *map(list, zip(*spans[i])), sizes[i])
        stays[i] = texts[i] is not None
    if hit:
        columns[text_col] = pa.array(texts, columns[text_col].type)
        if "n_chars" in names:
            n = columns["n_chars"].to_pylist()
            for i in hit:
                n[i] = None if texts[i] is None else len(texts[i])
            columns["n_chars"] = pa.array(n, pa.int64()).cast(columns["n_chars"].type)
    return pa.RecordBatch.from_arrays(list(columns.values()), names).filter(pa.array(stays))


def with_last(xs: Iterator) -> Iterator[tuple[object, bool]]:
    """Each of ``xs`` with whether it is the last."""
    held = next(xs)
    for x in xs:
        yield held, False
        held = x
    yield held, True
