"""Quality rules as a bitmask ledger: every rule is evaluated once; policies and ablations are bit operations on the ledger."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmark.llm.common import free_name, map_rows, texts_of

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_NAMES = [x.split()[0] for x in MEASURES.split(", ")][1:]
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a whole text; a null text has nothing of each.

    bytes.split() without argument splits at exactly the six ASCII white-space characters of the word definition.
    """
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, _SPACE))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, word_chars, n_symbols, len(lines), len(lines) - len(set(lines)), repeated


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of every document, from its whole text."""

    def batch(ids: list, texts: list) -> dict:
        return {"doc_id": ids} | dict(zip(_NAMES, zip(*map(measure, texts)) if ids else [[]] * len(_NAMES)))

    return map_rows(texts_of(docs, id_col, text_col), MEASURES, batch)


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` is true. Its bit never changes, so ledgers of different dates can be compared."""

    name: str
    bit: int
    fails: Column


def default_rules(measure_of: Callable[[str], Column] = F.col) -> list[Rule]:
    """The first two are the base rules. All compare whole numbers, so no rounding decides."""
    n, c = measure_of("n_words"), measure_of
    return [
        Rule("few_words", 0, n < 50),
        Rule("repeated_windows", 1, 100 * c("n_repeat_words") > 50 * n),
        Rule("symbols", 2, 100 * c("n_symbols") > 30 * n),
        Rule("word_length", 3, (c("word_chars") < 2 * n) | (c("word_chars") > 20 * n)),
        Rule("repeated_lines", 4, (c("n_lines") > 3) & (100 * c("n_dup_lines") > 50 * c("n_lines"))),
    ]


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: the rules that reject."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: Iterable[Rule]) -> int:
        return sum(1 << r.bit for r in rules if r.name in self.rules)


BASE_POLICY = Policy("base-1", ("few_words", "repeated_windows"))
DEFAULT_POLICY = Policy("keep-1", ("few_words", "repeated_windows", "symbols", "word_length", "repeated_lines"))


def failed_bits(rules: list[Rule]) -> Column:
    """The bitmask of the rules that fail; a null measurement fails none."""
    return sum((F.when(F.coalesce(r.fails, F.lit(False)), 1 << r.bit).otherwise(0) for r in rules), F.lit(0)).cast("long")


def verdict(policy: Policy, rules: list[Rule] | None = None, bits: Column | None = None) -> Column:
    """True where no rule of the policy has failed; reads only the ledger."""
    return (F.col("failed_bits") if bits is None else bits).bitwiseAND(F.lit(policy.mask(rules or default_rules()))) == 0


def ledger(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failed_bits``: one row per row of ``docs``, repeated rows and null ids included.

    A null or empty text has zero of everything and fails ``few_words``. An empty table gives an empty ledger.
    """
    return measurements(docs, id_col, text_col).withColumn("failed_bits", failed_bits(rules or default_rules()))


def ablation(entries: DataFrame, policy: Policy, rules: list[Rule] | None = None) -> DataFrame:
    """For each rule of the policy: rows it fails, rows that it alone rejects, and rows kept without it.

    One pass counts the bit patterns (at most 2 to the number of rules) with partial sums on every task; the rest reads the counts.
    """
    rules = [r for r in rules or default_rules() if r.name in policy.rules]
    patterns = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask(rules))).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    out = []
    for r in rules:
        bit = 1 << r.bit
        out += [
            F.struct(
                F.lit(r.name).alias("rule"),
                F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(bit)) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
                F.coalesce(F.sum(F.when(F.col("bits") == bit, F.col("n"))), F.lit(0)).alias("n_only"),
                F.coalesce(F.sum(F.when(F.col("bits").isin(0, bit), F.col("n"))), F.lit(0)).alias("n_kept_without"),
            )
        ]
    return patterns.agg(F.array(*out).alias("rows")).select(F.inline("rows"))


def keep_documents(docs: DataFrame, policy: Policy = DEFAULT_POLICY, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns, whatever their names, in one pass and without a shuffle.

    A null or empty text has few words and goes. Repeated rows are judged alike. An empty table stays empty.
    """

    def measured(texts: pa.Array) -> pa.Array:
        rows = [measure(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(_NAMES), _NAMES)

    measured = F.arrow_udf(measured, ", ".join(MEASURES.split(", ")[1:]))

    entry = free_name(docs, "__ledger")
    rules = default_rules(lambda name: F.col(f"`{entry}`.{name}"))
    kept = verdict(policy, rules, failed_bits(rules))
    # The filter reads the measured struct, so the rules run in the JVM and only the text goes to Python.
    return docs.withColumn(entry, measured(F.col(f"`{text_col}`").cast("string"))).filter(kept).select(*(F.col(f"`{c}`") for c in docs.columns))
