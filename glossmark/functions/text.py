"""Text functions: normalisation, wrapper stripping, segmentation, sentences, labels. All take and return columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space as the item files define it, label patterns, symbol maps.
WS = r"[\s\x1c-\x1f\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LABEL = r"[A-L]|[অ-হ][ঀ-৿]{0,3}"
OPTION_LETTERS = "ABCDEFGHIJKL"
PRECOMPOSED = "[ড়ঢ়য়]"
BENGALI_DIGITS = "০১২৩৪৫৬৭৮৯"
SYMBOLS_FROM = "‐‑‒–−" + "₀₁₂₃₄₅₆₇₈₉" + "⁰¹²³⁴⁵⁶⁷⁸⁹" + "⁺⁻₊₋"
SYMBOLS_TO = "-----" + "0123456789" + "0123456789" + "+-+-"

_OPEN, _CLOSE = "\x01", "\x02"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode NFC; null becomes empty. Spark has no built-in for it, so texts pass through Arrow: only those with a character that can
    change (none below U+0300 does), the others travel as nulls."""
    there = F.coalesce(text, F.lit(""))
    return F.coalesce(_nfc(F.when(there.rlike(r"[^\x00-\x{2FF}]"), there)), there)


def precomposed_count(text: Column) -> Column:
    """Precomposed Bengali letters before normalisation."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(PRECOMPOSED))


def normalise_symbols(text: Column) -> Column:
    """Hyphen look-alikes, sub- and superscript digits and signs as ASCII."""
    return F.translate(text, SYMBOLS_FROM, SYMBOLS_TO)


def clean_output(text: Column) -> Column:
    """Without one leading ``ITEM_ID:`` line and one leading ``QUESTION:`` marker; symbols normalised, ends stripped."""
    body = F.regexp_replace(text, rf"\A{WS}*ITEM_ID:[^\n]*\n?", "")
    body = F.regexp_replace(body, rf"\A{WS}*QUESTION:{WS}*", "")
    return strip(normalise_symbols(body))


def cut_at_labels(text: Column) -> Column:
    """The stem, then the options, each with its label and a mark in front."""
    marked = F.regexp_replace(F.translate(text, _OPEN + _CLOSE, ""), rf"(?dm)^{WS}*({LABEL})[.:।]{WS}", f"{_OPEN}$1{_CLOSE}")
    return F.split(marked, _OPEN)


def segments(text: Column) -> Column:
    """The stem (always there, perhaps empty) and the options, labels dropped."""
    return F.transform(cut_at_labels(text), lambda p: strip(F.regexp_replace(p, f"\\A[^{_CLOSE}]*{_CLOSE}", "")))


def labelled_segments(parts: Column) -> Column:
    """A struct of the stem and the options as structs of label and text, of what ``cut_at_labels`` gives."""
    option = lambda p: F.struct(F.substring_index(p, _CLOSE, 1).alias("label"), strip(F.substring_index(p, _CLOSE, -1)).alias("text"))
    return F.struct(strip(parts[0]).alias("stem"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), option).alias("options"))


def relabelled(parts: Column) -> Column:
    """The stem, then each option under the letter of its place, one a line; options beyond the last letter stay as they are."""
    letter = lambda i: F.substring(F.lit(OPTION_LETTERS), i, F.lit(1))
    return F.array_join(F.transform(parts, lambda p, i: F.when((i == 0) | (i > len(OPTION_LETTERS)), p).otherwise(F.concat(letter(i.cast("int")), F.lit(". "), p))), "\n")


def canonical_number(n: Column) -> Column:
    return F.replace(n, F.lit(","), F.lit(""))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, BENGALI_DIGITS, "0123456789")


def word_count(text: Column) -> Column:
    """Runs without white space; null stays null. By splitting, as counting matches of a pattern takes about three times as long."""
    return F.array_size(F.array_remove(F.split(text, rf"{WS}+"), ""))


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(text, pattern, f"$1{_OPEN}"), _OPEN), strip), lambda s: s != "")


def sentences(text: Column, long_words: int = 45) -> Column:
    """Sentences of every line: cut behind a danda or question mark; longer ones also behind a full stop."""
    lines = F.split(F.translate(text, _OPEN, ""), "\n")
    first = F.flatten(F.transform(lines, lambda line: _pieces(line, rf"([।?]){WS}*")))
    return F.flatten(F.transform(first, lambda s: F.when(word_count(s) > long_words, _pieces(s, rf"(\.){WS}+")).otherwise(F.array(s))))


def chunks(sentence: Column, max_words: int) -> Column:
    """A sentence in parts of at most ``max_words`` words: packed greedily at ``; ,`` and danda, then cut by words."""
    parts = F.split(F.regexp_replace(sentence, rf"([;,।]){WS}+", f"$1{_OPEN}"), _OPEN)
    counted = F.transform(parts, lambda p: F.struct(strip(p).alias("t"), word_count(p).alias("n")))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def pack(state: Column, part: Column) -> Column:
        # Words are counted once for each part: those of joined parts are their sum.
        full = (state["cur"] != "") & (state["n"] + part["n"] > max_words)
        joined = F.when(state["cur"] == "", part["t"]).when(part["t"] == "", state["cur"]).otherwise(F.concat(state["cur"], F.lit(" "), part["t"]))
        return F.struct(
            F.when(full, F.array_append(state["done"], state["cur"])).otherwise(state["done"]).alias("done"),
            F.when(full, part["t"]).otherwise(joined).alias("cur"), F.when(full, part["n"]).otherwise(state["n"] + part["n"]).alias("n"),
        )

    packed = F.aggregate(counted, empty, pack, lambda s: F.when(s["cur"] != "", F.array_append(s["done"], s["cur"])).otherwise(s["done"]))

    def cut(chunk: Column) -> Column:
        words = F.split(strip(chunk), rf"{WS}+")
        return F.transform(F.sequence(F.lit(1), F.size(words), F.lit(max_words)), lambda i: F.array_join(F.slice(words, i, F.lit(max_words)), " "))

    return F.when(word_count(sentence) <= max_words, F.array(sentence)).otherwise(F.flatten(F.transform(packed, cut)))


def chunked_sentences(text: Column, max_words: int = 40) -> Column:
    """Sentences cut behind danda, ``?`` and ``!``, each in chunks."""
    lines = F.split(F.translate(text, _OPEN, ""), "\n")
    return F.flatten(F.transform(F.flatten(F.transform(lines, lambda line: _pieces(line, rf"([।?!]){WS}*"))), lambda s: chunks(s, max_words)))


def rounded(number: Column, digits: int) -> Column:
    """``number`` to so many digits by its binary value, halves to even: the built-in roundings go by its decimal digits."""
    return F.pandas_udf(lambda x: x.map(lambda v: None if pd.isna(v) else round(v, digits)), "double")(number.cast("double"))


def one_decimal(number: Column) -> Column:
    """``number`` with one digit behind the point, rounded by its binary value."""
    return F.pandas_udf(lambda x: x.map(lambda v: None if pd.isna(v) else f"{v:.1f}"), "string")(number.cast("double"))


def timing_note(load_ns: Column, eval_count: Column, eval_ns: Column) -> Column:
    """Seconds of loading, tokens and tokens a second; what is missing counts as 0."""
    load, n, ns = (F.coalesce(c, F.lit(0)) for c in (load_ns, eval_count, eval_ns))
    rate = F.when(ns == 0, F.lit("0")).otherwise(one_decimal(F.when(ns != 0, n / (ns / 1e9))))
    return F.concat(F.lit("load "), one_decimal(load / 1e9), F.lit("s, "), n.cast("string"), F.lit(" tokens at "), rate, F.lit(" per second"))


def safe_name(name: Column) -> Column:
    return F.translate(name, ":/", "__")


def safe_rater(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "")


def row_label(prefix: str, number: Column) -> Column:
    return F.format_string(prefix + "%04d", number)


def prompt(template: str, item_id: Column, source: Column) -> Column:
    """``{text}`` in the template replaced by the item; without one, the item follows after a blank line."""
    body = F.concat(F.lit("ITEM_ID: "), item_id, F.lit("\n"), source)
    return F.replace(F.lit(template), F.lit("{text}"), body) if "{text}" in template else F.concat(F.lit(template.rstrip() + "\n\n"), body)
