"""Phrase collocation mining: word-id suffix arrays of shards, counts from their LCP intervals, merged by phrase over all shards."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmark.llm.common import arrow_batches, give_back_memory, materialize

MIN_COUNT, MAX_WORDS, TOP = 30, 4, 2000
#: A longer candidate of at least this percentage of a candidate's count takes its place.
COVERED = 80
#: Words of a shard, about: a shard ends with the text that reaches it.
SHARD_WORDS = 1 << 20
#: Bits of the sieve of frequent phrases (8 MB), whatever the size of the corpus: what it lets through too much, the merged counts drop.
SIEVE_BITS = 26
NO_LANGUAGE = "und"

# A-Z become a-z, a tab a space, and whatever ends a piece a line break.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))
#: Stands between pieces; no UTF-8 text has this byte.
_BREAK = b"\xff"


class _Numbers(dict):
    """The numbers of a language's words, given as they come; 0 is the break."""

    def __init__(self, words: list[bytes], of: list[int], language: int) -> None:
        super().__init__({_BREAK: 0})
        self.words, self.of, self.language = words, of, language

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        self.of.append(self.language)
        return n


class Shard:
    """Word numbers of a run of texts; the same word of two languages has two numbers."""

    def __init__(self) -> None:
        self.words, self.of, self.languages = [_BREAK], [0], {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, language: str, text: bytes) -> None:
        found = text.translate(_FOLD).replace(b"\n", b" \xff ").split()
        numbers = self.languages.get(language)
        if numbers is None:
            numbers = self.languages[language] = _Numbers(self.words, self.of, len(self.languages))
        found.append(_BREAK)
        self.parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
        self.size += len(found)

    def ids(self) -> np.ndarray:
        return np.concatenate(self.parts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word with its language; that of the break doesn't count."""
        names = list(self.languages)
        keys = {k: n.encode() + _BREAK for k, n in enumerate(names)}
        return np.frombuffer(b"".join(word_hash(keys[k] + w) for k, w in zip(self.of, self.words)), "<u8")


def word_hash(word: bytes) -> bytes:
    return blake2b(word, digest_size=8).digest()


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    h = left * np.uint64(0x9E3779B97F4A7C15) + right
    return h ^ (h >> np.uint64(29))


class Sieve:
    """Bits of the hashes of frequent phrases: a phrase without its bit is not frequent."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.shift = bits, np.uint64(64 - int(len(bits) * 8).bit_length() + 1)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def suffix_order(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places ``at`` by the first ``depth`` words from them, by prefix doubling: ranks of one word, two, four and so on."""
    rank, width, n = ids, 1, len(ids)
    while width < depth:
        last, width = width * 2 >= depth, width * 2
        # The last round orders only the places that are asked for; one before it ranks those that the next one looks at, too.
        places = at if last else np.unique(np.concatenate([at, at[at + width < n] + width]))
        key = rank[places] * np.int64(int(rank.max(initial=0)) + 1)
        inside = places + width // 2 < n
        key[inside] += rank[places[inside] + width // 2]
        order = np.argsort(key, kind="stable")
        if last:
            return at[order]
        held = key[order]
        rank = np.zeros(n, np.int32)
        rank[places[order]] = np.cumsum(np.concatenate([[False], held[1:] != held[:-1]]))
    return at[np.argsort(rank[at], kind="stable")]


def intervals(ids: np.ndarray, longest: np.ndarray, sizes: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size: a place and the count of every phrase of so many words that starts where ``longest`` allows it.

    ``longest`` depends on the words from a place on alone, so places of equal phrases allow them alike. In the order of suffixes they are
    an interval in which neighbours share as many words (LCP).
    """
    order = suffix_order(ids, np.flatnonzero(longest >= sizes.start), sizes.stop - 1)
    padded, shared = np.concatenate([ids, np.zeros(sizes.stop, ids.dtype)]), np.zeros(len(order), np.int8)
    same = np.ones(len(order), bool)
    same[:1] = False
    for d in range(sizes.stop - 1):
        words = padded[order + d]
        same[1:] &= words[1:] == words[:-1]
        shared += same
    for n in sizes:
        members = np.flatnonzero(longest[order] >= n)
        starts = np.flatnonzero(shared[members] < n)
        yield n, order[members[starts]], np.diff(np.append(starts, len(members)))


def counted(shard: Shard, sizes: range, sieve: Sieve | None) -> Iterator[pa.RecordBatch]:
    """language, phrase, n of the phrases of a shard; with a sieve only those of which all parts of one word less (or two words) pass."""
    ids = shard.ids()
    word = ids > 0
    if sieve is None:
        longest = word.astype(np.int8)
    else:
        h = shard.hashes()
        if sizes.start == 2:
            word &= sieve.passes(h)[ids]
            good = word[:-1] & word[1:]
        else:
            good = word[:-1] & word[1:]
            good[good] = sieve.passes(joined(h[ids[:-1][good]], h[ids[1:][good]]))
        longest = word.astype(np.int8)
        follows = np.concatenate([good, np.zeros(sizes.stop, bool)])
        reach = np.ones(len(ids), bool)
        for k in range(sizes.stop - 2):
            reach &= follows[k : k + len(ids)]
            longest += reach
    words, of = pa.array(shard.words, pa.binary()), np.array(shard.of)
    names = pa.array(list(shard.languages) or [""], pa.string())
    padded = np.concatenate([ids, np.zeros(sizes.stop, ids.dtype)])
    for n, at, k in intervals(ids, longest, sizes):
        for i in range(0, len(at), 1 << 18):
            some, times = at[i : i + (1 << 18)], k[i : i + (1 << 18)]
            parts = [words.take(pa.array(padded[some + d])) for d in range(n)]
            phrase = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(of[ids[some]])), phrase.cast(pa.string()), pa.array(times.astype(np.int64))], ["language", "phrase", "n"])


def phrase_counts(rows: DataFrame, sizes: range, sieve: object = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """language, phrase, n over all texts of ``rows`` (language, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed, shard = sieve and Sieve(np.frombuffer(sieve.value, np.uint8)), Shard()
        for b in batches:
            for language, text in zip(b.column(0).to_pylist(), b.column(1)):
                shard.add(language, text.as_py())
                if shard.size >= shard_words:
                    yield from counted(shard, sizes, passed)
                    shard = Shard()
        if shard.size:
            yield from counted(shard, sizes, passed)
        b = shard = passed = None
        give_back_memory()

    return rows.mapInArrow(run, "language string, phrase string, n long").groupBy("language", "phrase").agg(F.sum("n").alias("n"))


def sieve_of(phrases: DataFrame, bits: int) -> object:
    """A broadcast bitmap of 2 to the ``bits`` places, made by Spark's bitmap aggregate: the driver gets that many bits at most."""
    spark = phrases.sparkSession

    @F.arrow_udf("long")
    def place(language: pa.Array, phrase: pa.Array) -> pa.Array:
        out = []
        for x, p in zip(language.to_pylist(), phrase.to_pylist()):
            h = [np.frombuffer(word_hash(x.encode() + _BREAK + w), "<u8") for w in p.encode().split(b" ")]
            for w in h[1:]:
                h[0] = joined(h[0], w)
            out.append(int(h[0][0]) >> (64 - bits))
        return pa.array(out, pa.int64())

    chunk = 1 << 15  # the bits of one bitmap of Spark
    at = phrases.select(place("language", "phrase").alias("at")).groupBy(F.floor(F.col("at") / chunk).alias("k")).agg(F.bitmap_construct_agg(F.col("at") % chunk).alias("bits"))
    whole = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for r in at.collect():
        part = np.frombuffer(bytes(r.bits), np.uint8)[: len(whole)]
        whole[r.k * chunk // 8 :][: len(part)] = part
    return spark.sparkContext.broadcast(whole.tobytes())


def frequent(spark: SparkSession, rows: DataFrame, min_count: int, sieve_bits: int, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """language, phrase, n, size of all phrases of one to four words that occur ``min_count`` times, and language, total of the words.

    A phrase is no more frequent than its parts: pairs are counted of frequent words only, and longer phrases of frequent pairs.
    """
    enough = F.col("n") >= min_count
    with arrow_batches(spark, 500):  # whole texts
        words = materialize(phrase_counts(rows, range(1, 2), None, shard_words), "words")
        found = [words.filter(enough)]
        for name, sizes in (("pairs", range(2, 3)), ("phrases", range(3, MAX_WORDS + 1))):
            longer = phrase_counts(rows, sizes, sieve_of(found[-1], sieve_bits), shard_words)
            found.append(materialize(longer.filter(enough), name))
    size = F.size(F.split("phrase", " ")).alias("size")
    whole = found[0].unionByName(found[1]).unionByName(found[2]).select("language", "phrase", "n", size)
    return whole, words.groupBy("language").agg(F.sum("n").alias("total"))


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """language, phrase, size, n, l, r, score of the phrases of two words or more, by their lowest-scoring cut, ties to the first."""
    several, words = phrases.filter("size > 1"), F.split("phrase", " ")
    cuts = several.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": _part(words, F.lit(1), F.col("k")), "rest": _part(words, F.col("k") + 1, F.col("size") - F.col("k"))})
    parts = phrases.select("language", "phrase", "n")
    cuts = cuts.join(parts.select("language", F.col("phrase").alias("first"), F.col("n").alias("l")), ["language", "first"])
    cuts = cuts.join(parts.select("language", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["language", "rest"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumns({"over": wide("n") * F.lit(2_000_000).cast("decimal(8,0)"), "under": wide("l") + wide("r")})
    cuts = cuts.withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("language", "phrase", "size", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return best.select("language", "phrase", "size", "n", "x.l", "x.r", "x.score")


def uncovered(candidates: DataFrame, percent: int = COVERED) -> DataFrame:
    """The candidates that lie in no longer one of ``percent`` of their count or more."""
    words = F.split("phrase", " ")
    inner = candidates.filter("size > 2").select("language", "n", "size", words.alias("w"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    inner = inner.select("language", "n", "w", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("i"))
    most = inner.select("language", "n", _part(F.col("w"), F.col("i"), F.col("k")).alias("phrase")).groupBy("language", "phrase").agg(F.max("n").alias("around"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    covered = wide("around") * F.lit(100).cast("decimal(3,0)") >= wide("n") * F.lit(percent).cast("decimal(3,0)")
    return candidates.join(most, ["language", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False))).drop("around")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP,
    sieve_bits: int = SIEVE_BITS, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of every language.

    A null or empty text has no words; a null language is ``und``, as that name is. Repeated rows count again. Equal scores go by count,
    then by phrase. A language without a frequent phrase, and an empty table, give no rows. Other columns don't count. A shard's suffix
    array is ordered by four words, as longer phrases aren't counted.
    """
    language = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANGUAGE))
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(language.alias("language"), text.cast("binary").alias("text")).filter(F.length("text") > 0)
    phrases, totals = frequent(docs.sparkSession, rows, min_count, sieve_bits, shard_words)
    chosen = uncovered(scored(phrases))
    order = Window.partitionBy("language").orderBy(F.desc("score"), F.desc("n"), "phrase")
    ranked = chosen.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "language").select(F.col("language").alias("lang"), "rank", "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score")
