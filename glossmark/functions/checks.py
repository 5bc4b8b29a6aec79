"""Structural checks of a translation against its source."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmark.functions.text import LABEL, WS, ascii_digits, canonical_number, strip

# Character classes, units that stay in Latin script, number words.
BENGALI = r"[ঀ-৿]"
BENGALI_LETTERS = r"[ঀ-৿&&\p{L}]"
ASSAMESE = r"[ৰৱ]"
DEVANAGARI = r"[ऀ-ॣ०-ॿ]"
DOUBLE_VIRAMA = r"্্"
OTHER_SCRIPT = r"[\p{L}\p{Nl}\p{No}&&[^\u0000-\u024F\u0370-\u03FF\u0900-\u09FF\u2000-\u206F]]"
GREEK = r"[Ͱ-Ͽ]"
GREEK_SYMBOLS = "αβγδεκλμσωΔΩ"
TOKEN = r"[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*"
GLOSS = r"\(([^()]*[A-Za-z]{2,}[^()]*)\)"
NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)?"
UNITS = (
    "mm hg mmhg cm km kg mg mcg ug µg ng pg dl ml ul µl fl meq mmol umol µmol nmol pmol mol mosm mosmol iu miu hpf lpf ph "
    "bpm min hr hrs sec ms msec kcal cal kpa torr cmh2o mci gy cgy ppm mcl au rpm cc lb oz ft kb mb"
).split()
NUMBER_WORDS = {
    "0": ["শূন্য"], "1": ["এক", "প্রথম"], "2": ["দুই", "দু", "দ্বিতীয়"], "3": ["তিন", "তৃতীয়"], "4": ["চার", "চতুর্থ"],
    "5": ["পাঁচ", "পঞ্চম"], "6": ["ছয়", "ছ'", "ষষ্ঠ"], "7": ["সাত", "সপ্তম"], "8": ["আট", "অষ্টম"], "9": ["নয়", "নবম"],
    "10": ["দশ", "দশম"], "11": ["এগারো", "এগার"], "12": ["বারো", "বার", "দ্বাদশ"], "13": ["তেরো", "তের"], "14": ["চৌদ্দ"],
    "15": ["পনেরো", "পনের"], "16": ["ষোলো", "ষোল"], "17": ["সতেরো", "সতের"], "18": ["আঠারো", "আঠার"], "19": ["উনিশ"],
    "20": ["বিশ", "কুড়ি"], "30": ["ত্রিশ"], "40": ["চল্লিশ"], "50": ["পঞ্চাশ"], "60": ["ষাট"], "70": ["সত্তর"], "80": ["আশি"],
    "90": ["নব্বই"], "100": ["একশ", "একশো", "শত"],
}
LOOSE_OPTION = rf"(?dm)^{WS}*([A-L]){WS}*[.:]{WS}+"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, not again for each element of a lambda."""
    return F.transform(F.array(value), f)[0]


def _not_in(chars: Column, source: Column) -> Column:
    return F.filter(chars, lambda c: ~F.contains(source, c))


def block_fraction(text: Column, letters: str = BENGALI_LETTERS) -> Column:
    """Share of letters that are in a block; marks count on neither side; 0 without letters."""
    n = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(n > 0, F.regexp_count(text, F.lit(letters)) / n).otherwise(0.0)


def script_checks(hyp: Column, src: Column, bengali_only: bool = False) -> dict[str, Column]:
    """The seven script measures by name. Characters that the source uses too are no leak (Assamese letters always are)."""
    deva, other = _not_in(found(hyp, DEVANAGARI), src), _not_in(found(hyp, OTHER_SCRIPT), src)
    greek = found(hyp, GREEK)
    if not bengali_only:
        greek = F.filter(greek, lambda c: ~F.contains(src, c) & ~F.contains(F.lit(GREEK_SYMBOLS), c))
    return {
        "bengali_frac": block_fraction(hyp),
        "assamese_n": F.regexp_count(hyp, F.lit(ASSAMESE)),
        "devanagari_n": F.size(deva),
        "double_virama_n": F.regexp_count(hyp, F.lit(DOUBLE_VIRAMA)),
        "other_script_n": F.size(other) + F.size(greek),
        "other_script_chars": F.array_join(F.array_sort(F.array_distinct(F.concat(other, greek, deva))), ""),
        "bn_option_labels_n": F.regexp_count(hyp, F.lit(rf"(?dm)^{WS}*[অ-হ][ঀ-৿]{{0,3}}[.:।]{WS}")),
    }


def untranslated_words(src: Column, hyp: Column, allow: list[str] | Column | None = None, bengali_only: bool = False) -> dict[str, Column]:
    """latin_word_n, latin_words, gloss_n: Latin words outside and inside parentheses that nothing allows."""
    has_mark = lambda t: t.rlike("[A-Z0-9]")
    units = F.array(*map(F.lit, UNITS))
    tokens = found(src, TOKEN)
    kept = F.filter(tokens, has_mark)
    parts = F.filter(F.flatten(F.transform(kept, lambda t: F.split(t, "-"))), has_mark)
    nexts = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    joined = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), nexts, lambda a, b: F.when(F.array_contains(units, F.lower(a)) & F.array_contains(units, F.lower(b)), F.concat(a, b)))
    allowed = F.concat(F.transform(F.concat(kept, parts, F.array_compact(joined)), F.lower), units)
    if allow is not None:
        allowed = F.concat(allowed, allow if isinstance(allow, Column) else F.array(*[F.lit(a.lower()) for a in allow]).cast("array<string>"))

    def bad(words: Column) -> Column:
        long = F.filter(words, lambda w: F.length(w) > 1)
        return long if bengali_only else once(allowed, lambda a: F.filter(long, lambda w: ~F.array_contains(a, F.lower(w))))

    inside = bad(F.flatten(F.transform(found(hyp, GLOSS, 1), lambda g: found(g, TOKEN))))
    outside = bad(found(F.regexp_replace(hyp, GLOSS, " "), TOKEN))
    return {"latin_word_n": F.size(outside), "latin_words": F.array_join(outside, " "), "gloss_n": F.size(inside)}


def numbers_preserved(src: Column, hyp: Column) -> dict[str, Column]:
    """num_src, num_missing, num_hard_n, num_soft_n, num_missing_list, num_recall over the distinct numbers of the source."""
    numbers = lambda t: F.array_distinct(F.transform(found(t, NUMBER), canonical_number))
    wanted, there = F.array_sort(numbers(src)), numbers(ascii_digits(hyp))
    words = F.create_map(*[x for k, v in NUMBER_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    said = lambda n: F.exists(F.coalesce(F.try_element_at(words, n), F.array().cast("array<string>")), lambda w: F.contains(hyp, w))
    missing = once(there, lambda t: F.filter(wanted, lambda n: ~F.array_contains(t, n) & ~said(n)))
    hard = F.filter(missing, lambda n: F.contains(n, F.lit(".")) | (F.length(n) >= 3))
    total = F.size(wanted)
    return {
        "num_src": total, "num_missing": F.size(missing), "num_hard_n": F.size(hard), "num_soft_n": F.size(missing) - F.size(hard),
        "num_missing_list": F.array_join(missing, " "), "num_recall": F.when(total > 0, 1 - F.size(missing) / total).otherwise(1.0),
    }


def duplicate_options(parts: Column) -> Column:
    """Options that equal another one after white space is levelled."""
    options = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: strip(F.regexp_replace(p, rf"{WS}+", " ")))
    return F.size(options) - F.size(F.array_distinct(options))


def length_ratio(src: Column, hyp: Column) -> Column:
    return F.length(hyp) / F.greatest(F.length(src), F.lit(1))


# ---- checks at write time


def count_options(text: Column) -> Column:
    """Distinct option letters at line starts, by the looser pattern."""
    return F.size(F.array_distinct(found(F.coalesce(text, F.lit("")), LOOSE_OPTION, 1)))


def bengali_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit(BENGALI))


def foreign_letters(text: Column) -> Column:
    """Distinct letters that are neither ASCII nor Bengali."""
    return F.array_distinct(found(text, r"[\p{L}&&[^\x00-\x7Fঀ-৿]]"))


def option_lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return F.filter(lines, lambda line: line.rlike(rf"\A{WS}*[A-L]{WS}*[.:]{WS}+"))


def answer_key_problem(answer: Column, output: Column) -> Column:
    """``answer_option_missing_X`` if no option line starts with the key's letter; null without a key or output."""
    letter = F.upper(strip(F.coalesce(answer.cast("string"), F.lit(""))))
    there = F.exists(option_lines(output), lambda line: F.upper(F.substring(strip(line), 1, 1)) == letter)
    return F.when((letter != "") & (strip(F.coalesce(output, F.lit(""))) != "") & ~there, F.concat(F.lit("answer_option_missing_"), letter))


def write_time_problems(source: Column, output: Column, done_reason: Column, eval_count: Column) -> Column:
    """The codes of all problems, in a fixed order; an empty output has that one alone."""
    body, source = strip(F.coalesce(output, F.lit(""))), F.coalesce(source, F.lit(""))
    few = bengali_chars(body) < 20
    foreign_options = F.size(F.filter(option_lines(body), lambda line: bengali_chars(line) == 0))
    strays = F.array_sort(F.array_except(foreign_letters(body), foreign_letters(source)))
    n_src, n_out = count_options(source), count_options(body)
    found_ = F.array(
        F.when((done_reason != "") & (done_reason != "stop"), F.concat(F.lit("stopped_"), done_reason)),
        F.when(eval_count == 0, F.lit("zero_token_count")),
        F.when(few, F.lit("untranslated")).when(foreign_options > 0, F.concat(F.lit("untranslated_options_"), foreign_options.cast("string"))),
        F.when(F.size(strays) > 0, F.concat(F.lit("foreign_script_"), F.array_join(F.slice(strays, 1, 8), ""))),
        F.when(~F.contains(body, F.lit("QUESTION:")), F.lit("no_question_line")),
        F.when((n_src > 0) & (n_src != n_out), F.concat(F.lit("option_count_"), n_out.cast("string"), F.lit("_vs_"), n_src.cast("string"))),
    )
    return F.when(body == "", F.array(F.lit("empty_output"))).otherwise(F.array_compact(found_))


def any_of(conditions: list[Column]) -> Column:
    """True if one is; a null one is not."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(False))
