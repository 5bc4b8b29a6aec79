"""Branches of the checks that the tables don't reach, and small functions, by hand-made cases."""

from pyspark.sql import functions as F

from glossmark.functions import checks
from glossmark.operators import sampling, scores
from glossmark.plans import quality
from glossmark.sources import readers, writers


def columns_of(spark, rows, names, columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{n} string" for n in names))
    return [tuple(r)[1:] for r in sorted(df.select("id", *columns).collect())]


def test_numbers_said_as_words_are_there(spark):
    rows = [("give 2 and 20", "দুই বার, কুড়ি দিন"), ("give 3", "চার"), ("6 of 10", "ছ' ও দশম"), ("1,200 and 1.5", "১২০০ ও ১.৫"), ("1.5 of 250", "কিছু না"), ("no", "১"), ("7 7 7", "৮")]
    c = checks.numbers_preserved(F.col("src"), F.col("hyp"))
    got = columns_of(spark, rows, ("src", "hyp"), [c[n] for n in ("num_src", "num_missing", "num_hard_n", "num_soft_n", "num_missing_list", "num_recall")])
    assert got == [(2, 0, 0, 0, "", 1.0), (1, 1, 0, 1, "3", 0.0), (2, 0, 0, 0, "", 1.0), (2, 0, 0, 0, "", 1.0), (2, 2, 2, 0, "1.5 250", 0.0), (0, 0, 0, 0, "", 1.0), (1, 1, 0, 1, "7", 0.0)]


def test_words_that_a_list_allows(spark):
    rows = [("ECG of HbA1c and mm Hg", "ecg hba1c mmhg wordy (glossy text) x"), ("plain", "MRI scan")]
    free = checks.untranslated_words(F.col("src"), F.col("hyp"))
    allowed = checks.untranslated_words(F.col("src"), F.col("hyp"), ["MRI", "Glossy"])
    strict = checks.untranslated_words(F.col("src"), F.col("hyp"), bengali_only=True)
    got = columns_of(spark, rows, ("src", "hyp"), [x[n] for x in (free, allowed, strict) for n in ("latin_words", "gloss_n")])
    assert got == [("wordy", 2, "wordy", 1, "ecg hba1c mmhg wordy", 2), ("MRI scan", 0, "scan", 0, "MRI scan", 0)]


def test_letters_of_a_strict_policy(spark):
    rows = [("α", "α μ ক"), ("", "ক. খ\n গ। ঘ\nA. x\nঙ : চ")]
    free, strict = (checks.script_checks(F.col("hyp"), F.col("src"), b) for b in (False, True))
    got = columns_of(spark, rows, ("src", "hyp"), [free["other_script_n"], strict["other_script_n"], free["bn_option_labels_n"]])
    assert got == [(0, 2, 0), (0, 0, 2)]


def test_options_without_a_letter_of_the_language(spark):
    stem = "QUESTION: " + "ক" * 20
    rows = [("q\nA. x\nB. y", stem + "\nA. খ\nB. left"), ("q\nA. x", stem + "\nA. ж খ"), ("q", "QUESTION: " + "ক" * 19), ("q", stem)]
    p = checks.write_time_problems(F.col("src"), F.col("hyp"), F.lit("stop"), F.lit(1))
    got = columns_of(spark, rows, ("src", "hyp"), [F.array_join(p, ",")])
    assert got == [("untranslated_options_1",), ("foreign_script_ж",), ("untranslated",), ("",)]


def test_small_parts(spark, tmp_path):
    rows = spark.createDataFrame([(i, 100 * i) for i in range(8)], "id int, n int")
    assert tuple(scores.token_cap(rows, "n").head()) == (2, 700)
    assert quality.throughput({"a": 120.0, "b": 0.0}, 10) == {"a": 40.0, "b": 0.0}
    assert [r.row_id for r in sampling.numbered(rows, "R", "id").orderBy("row_id").collect()] == [f"R{i:04d}" for i in range(1, 9)]
    assert sorted(r.id for r in sampling.shuffled(rows, "id").collect()) == list(range(8))
    writers.write_table(rows, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 8
    for name in ("a_1.json", "a_3.json", "a_2.json", "b_9.json"):
        (tmp_path / name).write_text("[]")
    assert readers.newest_batch(spark, f"{tmp_path}/a_*.json").endswith("a_3.json")
    assert readers.read_thresholds(spark, None) == {}


def test_cosine_and_length_agreement(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] if r[0] is None else round(r[0], 9) for r in rows.select(scores.cosine(F.col("a"), F.col("b"))).collect()] == [0.96, None, None]
    assert scores.length_agreement()(["abcd", "", ""], ["ab", "", "x"]) == [0.5, 0.0, 0.0]
