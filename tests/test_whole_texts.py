"""Queries over whole texts and tables, against brute force: nothing behind a prefix is lost."""

import collections
import hashlib
import re

from pyspark.sql import functions as F

from glossmark.functions import checks, text
from glossmark.functions.chrf import chrf, chrf_relational
from glossmark.plans import quality
from glossmark.plans.queries import QUERIES


def brute_chrf(hyp, ref):
    hyp, ref = ("".join(c for c in t if not c.isspace()) for t in (hyp, ref))
    ps, rs = [], []
    for n in range(1, 7):
        a, b = ([t[i : i + n] for i in range(len(t) - n + 1)] for t in (hyp, ref))
        if a and b:
            left, both = collections.Counter(b), 0
            for g in a:
                if left[g] > 0:
                    left[g] -= 1
                    both += 1
            ps.append(both / len(a))
            rs.append(both / len(b))
    p, r = (sum(x) / len(x) if x else 0.0 for x in (ps, rs))
    return 500 * p * r / (4 * p + r) if p + r else 0.0


def test_both_forms_of_chrf_are_equal(spark):
    texts = ["", "a", "abc abc", "the same words", "the same word", "হাত ধোয়া", "x\ty  z"]
    pairs = spark.createDataFrame([(i * 10 + j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)], "id long, hyp string, ref string")
    one = {r.id: r.x for r in pairs.select("id", chrf(F.col("hyp"), F.col("ref")).alias("x")).collect()}
    two = {r.id: r.chrf for r in chrf_relational(pairs).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)
    assert all(abs(one[i * 11] - 100) < 1e-9 for i in range(1, len(texts)))


def test_answer_key_and_script_leaks(spark):
    rows = [(1, "b", "stem\nA. x\n B : y"), (2, "D", "A. x\nB: y"), (3, None, "A. x"), (4, "A", "  "), (5, "B", "A. x\nB.")]
    keys = spark.createDataFrame(rows, "id int, a string, t string").select("id", checks.answer_key_problem(F.col("a"), F.col("t")).alias("p"))
    assert {r.id: r.p for r in keys.collect()} == {1: None, 2: "answer_option_missing_D", 3: None, 4: None, 5: "answer_option_missing_B"}
    names = ["কখগ 12", "пр α μ", "ৰৱ क ্্ x", "ক. খ\nB. é", "μ β Ω θ", ""]
    c = checks.script_checks(F.col("hyp"), F.col("src"))
    n = ("assamese_n", "devanagari_n", "double_virama_n", "other_script_n", "other_script_chars")
    got = spark.createDataFrame([(i, t, "α") for i, t in enumerate(names)], "id int, hyp string, src string").select("id", *[c[x].alias(x) for x in n]).collect()
    want = [(0, 0, 0, 0, ""), (0, 0, 0, 2, "пр"), (2, 1, 1, 0, "क"), (0, 0, 0, 0, ""), (0, 0, 0, 1, "θ"), (0, 0, 0, 0, "")]
    assert [tuple(r)[1:] for r in sorted(got)] == want


def test_samples_take_text_ids(spark):
    rows = [(f"US-{i:05d}", f"m{i % 2}", i / 100, i % 7 / 10, i % 5 / 10) for i in range(300)]
    items = spark.createDataFrame(rows, "item_id string, translator string, cometkiwi_min double, cometkiwi_mean double, metricx_mean double")
    got = quality.sample(items, "item_id", 40, 10).collect()
    assert len({r.item_id for r in got}) == 50 and collections.Counter(r.part for r in got)["random"] == 40
    assert got == quality.sample(items, "item_id", 40, 10).collect()


def test_sample_removes_rows_and_not_items(spark):
    rows = [(i, t, i / 100 + (t == "b"), 0.5, None, i % 10.0) for i in range(20) for t in "ab"]
    items = spark.createDataFrame(rows, "item_id long, translator string, cometkiwi_min double, cometkiwi_mean double, metricx_mean double, roundtrip_chrf double")
    got = quality.sample(items, "item_id", 20, 20).collect()
    assert len(got) == 40 and len({(r.item_id, r.translator) for r in got}) == 40  # 20 + 10 + 10 by chrF, as no row has the other score


def test_summary_leaves_out_what_is_not_there(spark):
    counts = "precomposed_n seg_mismatch other_script_n devanagari_n assamese_n latin_word_n gloss_n num_hard_n num_soft_n dup_option_n".split()
    rows = [("a", *[0] * 10, 0.0, 0.5, "PASS"), ("a", *[0] * 10, 0.0, 0.25, "FLAG"), ("b", *[0] * 10, 0.0, None, "PASS")]
    items = spark.createDataFrame(rows, "translator string, " + ", ".join(f"{c} int" for c in counts) + ", len_z double, labse_min double, decision string")
    got = {(r.check, r.translator): r.value for r in quality.summary(items).collect()}
    assert got["decision PASS", "a"] == got["decision FLAG", "a"] == got["decision PASS", "b"] == "1"
    assert ("decision FLAG", "b") not in got and ("decision REVIEW", "a") not in got
    assert got["labse_min (mean over items)", "a"] == "0.375" and ("labse_min (mean over items)", "b") not in got


def test_report_takes_the_mean_and_the_least_score(spark):
    rows = [(i, f"D{i % 4}", "random", float(i % 4), 3.0 - i % 4) for i in range(40)]
    rated = spark.createDataFrame(rows, "id long, tier string, part string, cometkiwi_mean double, cometkiwi_min double")
    got = {r.statistic: r.value for r in quality.report(rated, key="id").collect()}
    assert abs(got["spearman_random"] - 1) < 1e-9 and got["auroc_random"] == 1.0
    assert (got["recall_cv"], got["precision_cv"]) == (1.0, 1.0)
    few = quality.report(rated.filter("tier < 'D2' or id < 4"), key="id").collect()
    assert {r.statistic: r.value for r in few}["recall_cv"] is None  # two bad rows, five folds


def test_chrf_of_whole_texts(spark, sf_dir):
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    got = {r.id: r.chrf for r in QUERIES["q_chrf_pair"](spark, sf_dir).collect()}
    beyond = 0
    for c, t in turns:
        if turns[c, t].role == "user" and (c, t + 1) in turns and turns[c, t + 1].role == "assistant":
            hyp, src = turns[c, t + 1].text, turns[c, t].text
            assert abs(got.pop(c * 1000 + t) - brute_chrf(hyp, src)) < 1e-5
            beyond += abs(brute_chrf(hyp, src) - brute_chrf(hyp[:200], src[:200])) > 0.01
    assert not got and beyond


def test_consensus_of_whole_texts(spark, tmp_path):
    long = "the same start of every answer " * 5
    rows = [(1, t, "assistant", long + end) for t, end in enumerate(("abc def ghi", "abc xyz ghi", "qrs tuv wxy"))] + [(2, 0, "assistant", "one"), (2, 1, "assistant", "two")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.item_id, r.translator): r.consensus_chrf for r in QUERIES["q_chrf_consensus"](spark, str(tmp_path)).collect()}
    texts = [r[3] for r in rows[:3]]
    for t in range(3):
        want = sum(brute_chrf(texts[t], texts[u]) for u in range(3) if u != t) / 2
        assert abs(got[1, str(t)] - want) < 1e-5 and want < 99
    assert got[2, "0"] is None and len(got) == 5


def test_relabel_keeps_all_lines(spark, tmp_path):
    lines = [f"line {i}" for i in range(30)]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = "\n".join([lines[0], *(f"{c}. {x}" for c, x in zip("ABCDEFGHIJKL", lines[1:13])), *lines[13:]])
    assert QUERIES["q_segment_relabel"](spark, str(tmp_path)).head().h == hashlib.md5(want.encode()).hexdigest()


def test_checks_read_the_tables(spark, tmp_path):
    rows = [(1, 0, "user", "α only"), (1, 1, "assistant", "stem\nx\ny пр α μ θ ৰ क"), (2, 0, "user", "q"), (2, 1, "assistant", "\n".join("abcdefghijklm"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    leaks = {r.item_id: r for r in QUERIES["q_script_leak_src_exempt"](spark, str(tmp_path)).collect()}
    assert (leaks[1000].other_script_n, leaks[1000].other_script_chars, leaks[1000].assamese_n, leaks[1000].devanagari_n) == (3, "θпрक", 1, 1)
    assert leaks[2000].other_script_n == 0
    problems = {r.item_id: r.problem for r in QUERIES["q_answer_key"](spark, str(tmp_path)).collect()}
    assert problems == {1000: "answer_option_missing_E", 2000: None}  # keys E and I


def brute_sentences(text):
    """The pieces of a text by its sentences, and those of at most 20 words by which a model takes it."""
    lines = [s.strip() for line in text.split("\n") for s in re.split(r"(?<=[।?])\s*", line) if s.strip()]
    whole = [p.strip() for s in lines for p in (re.split(r"(?<=\.)\s+", s) if len(s.split()) > 45 else [s]) if p.strip()]
    parts = []
    for s in (s.strip() for line in text.split("\n") for s in re.split(r"(?<=[।?!])\s*", line) if s.strip()):
        if len(s.split()) <= 20:
            parts.append(s)
            continue
        packed, cur = [], ""
        for p in re.split(r"(?<=[;,।])\s+", s):
            if cur and len(f"{cur} {p}".split()) > 20:
                packed.append(cur)
                cur = p
            else:
                cur = f"{cur} {p}".strip()
        parts += [" ".join(c.split()[i : i + 20]) for c in [*packed, cur] for i in range(0, len(c.split()), 20)]
    return whole, parts


def test_sentences_and_chunks_of_whole_texts(spark, sf_dir):
    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    got = QUERIES["q_sentence_chunks"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        whole, parts = brute_sentences(texts[r.conv_id, r.turn])
        assert (r.n_sentences, r.n_chunks, r.most_words) == (len(whole), len(parts), max((len(p.split()) for p in parts), default=None))


def test_back_translation_of_whole_texts(spark, sf_dir):
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    got = {r.item_id: r for r in QUERIES["q_back_translation"](spark, sf_dir).collect()}
    for (c, t), user in turns.items():
        reply = turns.get((c, t + 1))
        if user.role != "user" or reply is None or reply.role != "assistant" or re.search(r"(?m)^\s*([A-L]|[অ-হ][ঀ-৿]{0,3})[.:।]\s", reply.text):
            continue
        r, size = got[c * 1000 + t], max(1, len(user.text))
        hyp = reply.text.translate(str.maketrans(text.SYMBOLS_FROM, text.SYMBOLS_TO)).strip()
        assert r.retry in (0, 1) and abs(r.len_ratio * size - round(r.len_ratio * size)) < size / 1000
        if r.retry:
            _, parts = brute_sentences(hyp)
            assert (r.n_chunks, r.back_en) == (len(parts), hashlib.md5(" ".join(p.upper() for p in parts).strip().encode()).hexdigest())
    assert any(r.retry for r in got.values())
