"""Jobs from files to files, against brute-force versions; readers, the score store, back-translation and the stream."""

import csv
import glob
import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from glossmark.functions import text
from glossmark.operators import scores
from glossmark.plans import jobs, quality
from glossmark.sources import readers, writers
from glossmark.sources.store import KEYS, ScoreStore
from glossmark.streaming import incremental
from tests.test_whole_texts import brute_chrf

# ---- readers


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_lists_have_places_and_nothing_else_is_read(spark, tmp_path):
    put(tmp_path / "a.json", '﻿ [{"en": "one"}, {"id": "x", "question": "two", "options": {"A": "p", "B": "q"}}, {"en": "three"}]')
    put(tmp_path / "b.json", '{"en": "alone"}')
    put(tmp_path / "c.json", '[{"en": "broken"')
    put(tmp_path / "d.json", "[]")
    got = sorted((r.id, r.en, r.n_options, r.place) for r in readers.read_items(spark, f"{tmp_path}/*.json").collect())
    assert got == [("0", "one", None, 0), ("2", "three", None, 2), ("x", "two", 2, 1)]


def test_items_by_name_and_place(spark, tmp_path):
    put(tmp_path / "a.json", json.dumps([{"id": f"US-{i:05d}", "en": f"t{i}"} for i in range(1, 21)] + [{"id": "us-00003", "en": "again"}]))
    items = readers.read_items(spark, f"{tmp_path}/a.json")
    name = lambda w: [r.en for r in readers.find_item(items, w).collect()]
    assert name("12") == ["t12"] and name(" us-00003 ") == ["t3"] and name("0") == name("22") == name("") == name("none") == []
    assert sorted(r.place for r in readers.items_between(items, "us-00005", "3").collect()) == [2, 3, 4]
    assert readers.items_between(items, "1", "none").count() == 0


def test_the_last_line_of_a_key_counts(spark, tmp_path):
    lines = [{"key": ["i", "t", "0"], "value": v} for v in (9.0, 1.0, 3.0)] + [{"key": ["i", "t", "1"], "value": 5.0}, {"key": ["i", "t", "1"], "value": None}]
    put(tmp_path / "c.jsonl", "\n".join(map(json.dumps, lines)) + "\nbroken\n")
    got = {(r.item_id, r.translator, r.seg_id): r.m for r in readers.read_checkpoint(spark, f"{tmp_path}/c.jsonl", "m").collect()}
    assert got == {("i", "t", 0): 3.0, ("i", "t", 1): None}
    put(tmp_path / "bt.csv", '﻿item_id,translator,back_en\n1,t,first\n1,t,"last,\nof two"\n2,t,first\n2,t,\n3,t," "\n4,u,other\n')
    rows = spark.createDataFrame([(i, "t", "s", "h", "old") for i in range(1, 5)], "item_id long, translator string, src_raw string, hyp_raw string, bt_raw string")
    back = readers.read_back_translations(spark, f"{tmp_path}/bt.csv")
    assert {r.item_id: r.bt_raw for r in readers.attach_back_translations(rows, back).collect()} == {1: "last,\nof two", 2: "old", 3: " ", 4: "old"}
    assert {r.item_id: r.bt_raw for r in readers.attach_back_translations(rows, back.drop("translator")).collect()}[4] == "other"


def test_usable_and_skipped(spark, tmp_path):
    recs = [{"item_id": "1", "english": "a", "bangla": "b", "model": "m"}, {"item_id": "2", "english": "a", "bangla": " ", "model": "m"}, {"item_id": "3", "bangla": "b", "error": "e"}, {"item_id": "4", "english": "c", "bangla": "d"}]
    records = readers.read_records(spark, put(tmp_path / "r.json", json.dumps(recs)))
    assert sorted((r.item_id, r.translator) for r in readers.usable(records).collect()) == [("1", "m"), ("4", "json")]
    assert tuple(readers.skipped(records).head()) == (1, 1)
    rows, seen = jobs.usable_rows(records)
    rows.write.parquet(f"{tmp_path}/rows")
    assert (seen.get["n"], seen.get["n_error"], seen.get["n_blank"]) == (4, 1, 1)
    assert [r.item_id for r in readers.finished_ids(records).orderBy("item_id").collect()] == ["1", "4"]


def test_sheets_of_several_translators(spark, tmp_path):
    put(tmp_path / "s.csv", '﻿id,src,a,a_back,b\n1,s1,h1,b1,g1\n2,s2,,b2,g2\n,s3,h3,b3,g3\n4,"two\nlines",h4,,\n')
    sheet = readers.read_csv(spark, f"{tmp_path}/s.csv", "id string, src string, a string, a_back string, b string")
    got = sorted(map(tuple, readers.wide_to_long(sheet, "id", "src", {"A": ("a", "a_back"), "B": ("b", None)}).collect()))
    assert got == [("1", "A", "s1", "h1", "b1"), ("1", "B", "s1", "g1", None), ("2", "B", "s2", "g2", None), ("4", "A", "two\nlines", "h4", None)]
    assert {r.token for r in readers.read_allow_list(spark, put(tmp_path / "a.txt", "# none\nECG # a\n\n mri\nECG\n")).collect()} == {"ecg", "mri"}
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(map(tuple, readers.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_timing_note(spark):
    rows = [(1, 246_000_000_000, 6149, 245_960_000_000), (2, None, None, None), (3, 250_000_000, 7, 20_000_000_000), (4, 350_000_000, 3, 1_000_000_000)]
    df = spark.createDataFrame(rows, "id int, a long, n long, b long").select("id", text.timing_note(F.col("a"), F.col("n"), F.col("b")).alias("t"))

    def want(a, n, b):
        a, n, b = a or 0, n or 0, (b or 0) / 1e9
        return f"load {round(a / 1e9, 1)}s, {n} tokens at {round(n / b, 1) if b else 0} per second"

    assert {r.id: r.t for r in df.collect()} == {i: want(*r) for i, *r in rows}


def test_labels_and_prompts(spark):
    one = spark.createDataFrame([("gpt:120b/x", "Dr. A b-1_é", "US-1", "q")], "m string, r string, i string, s string")
    got = one.select(text.safe_name(F.col("m")), text.safe_rater(F.col("r")), text.row_label("R", F.lit(7)), text.prompt("Do {text} now", F.col("i"), F.col("s")), text.prompt("Do \n", F.col("i"), F.col("s"))).head()
    assert tuple(got) == ("gpt_120b_x", "Dr.Ab-1_é", "R0007", "Do ITEM_ID: US-1\nq now", "Do\n\nITEM_ID: US-1\nq")


def test_nfc_of_any_text(spark):
    texts = ["", "plain é", "é", "ড়", "য়", "ą́b", "한", "한", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.nfc(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: unicodedata.normalize("NFC", t or "") for i, t in enumerate(texts)}


# ---- scores


def lengths():
    return lambda src, hyp: [len(s) - len(h) / 7 for s, h in zip(src, hyp)]


def test_a_store_scores_each_key_once(spark, tmp_path):
    store = ScoreStore(spark, f"{tmp_path}/scores", "m")
    rows = spark.createDataFrame([(f"i{i}", "t", s, "src", "hyp" * i, 0) for i in range(30) for s in range(2)], incremental.SEGMENT)
    assert store.versions() == [] and store.read().count() == 0 and store.missing(rows).count() == 60
    some = rows.filter("item_id < 'i2'")
    store.add(scores.scored(some, "m", lengths).select(*KEYS, "m"))
    (tmp_path / "scores/m/version=2").mkdir()  # a writer that was lost
    assert store.missing(rows).count() == 60 - some.count()
    store.add(scores.scored(store.missing(rows), "m", lengths).select(*KEYS, "m"))
    assert store.versions() == [1, 2] and store.missing(rows).count() == 0
    got = {(r.item_id, r.seg_id): r.m for r in store.read().collect()}
    assert len(got) == 60 and got["i7", 1] == 3 - 3
    store.add(spark.createDataFrame([("i7", "t", 1, -1.0)], "item_id string, translator string, seg_id int, m double"))
    assert {(r.item_id, r.seg_id): r.m for r in store.read().collect()} == got | {("i7", 1): -1.0}
    assert scores.newly_scored(rows, store.read(), "m", lengths).count() == 0


def test_checkpoints_go_round(spark, tmp_path):
    rows = spark.createDataFrame([("i", "t", 0, 1.5), ("i", "t", 1, float("nan"))], "item_id string, translator string, seg_id int, m double")
    writers.append_checkpoint(rows.filter("seg_id = 0"), "m", f"{tmp_path}/c")
    writers.append_checkpoint(rows.filter("seg_id = 0").withColumn("m", F.lit(2.5)), "m", f"{tmp_path}/c")
    assert {(r.seg_id, r.m) for r in readers.read_checkpoint(spark, f"{tmp_path}/c", "m").collect()} == {(0, 2.5)}
    writers.write_json(rows, f"{tmp_path}/j")
    lines = [json.loads(x) for f in glob.glob(f"{tmp_path}/j/*.json") for x in open(f)]
    assert sorted(x.get("m", "none") == "none" for x in lines) == [False, True]
    assert writers.new_version(rows, f"{tmp_path}/t", "7") == f"{tmp_path}/t/7" and spark.read.parquet(f"{tmp_path}/t/7").count() == 2


def vowels():
    return lambda texts: [[sum(t.count(c) for c in v) / max(1, sum(t.count(c) for c in "aeiou")) ** 0.5 for v in "aeiou"] for t in texts]


def item(stem, options):
    return "\n".join([stem, *(f"{c}. {o}" for c, o in zip("ABCDEFGH", options))])


RECORDS = [
    ("q1", "m1", item("Give 5 mg now", ["aa", "eee", "ii"]), item("দিন 5 mg", ["aa", "eee", "ii"]), "Give 5 mg now"),
    ("q1", "m2", item("Give 5 mg now", ["aa", "eee", "ii"]), item("দিন 5 mg", ["eee", "aa", "ii"]), None),
    ("q1", "m3", item("Give 5 mg now", ["aa", "eee", "ii"]), item("দিন 75", ["aa", "aa"]), "Give 75"),
    ("q2", "m1", item("No fever", ["oo", "uu"]), "ITEM_ID: q2\nQUESTION: " + item("জ্বর নেই", ["oo", "uu"]), None),
    ("q3", "m1", "Only a stem of words", "কেবল wordy পার্ট", None),
]


def scored_job(spark, tmp_path, **more):
    rows = spark.createDataFrame(RECORDS, "item_id string, translator string, src_raw string, hyp_raw string, bt_raw string")
    metrics = [jobs.Metric("cometkiwi", lengths), jobs.Metric("metricx", lengths, is_error=True)]
    return jobs.score(rows, str(tmp_path), metrics, vowels, **more)


def test_score_job_equals_brute_force(spark, tmp_path):
    long, items = scored_job(spark, tmp_path)
    got = {(r.item_id, r.translator): r.asDict() for r in items.collect()}
    assert len(got) == 5
    segs = {}
    for r in long.collect():
        segs.setdefault((r.item_id, r.translator), []).append(r)
    for item_id, t, src, hyp, back in RECORDS:
        r, s = got[item_id, t], sorted(segs[item_id, t], key=lambda x: x.seg_id)
        split = lambda x: [p.strip() for p in __import__("re").split(r"(?m)^[A-H]\. ", x.split("QUESTION: ")[-1])]
        a, b = split(src), split(hyp)
        assert r["seg_mismatch"] == int(len(a) != len(b)) == s[0].seg_mismatch
        if len(a) == len(b):
            assert [(x.src_en, x.hyp_bn) for x in s] == list(zip(a, b))
            v = [len(x) - len(y) / 7 for x, y in zip(a, b)]
            assert abs(r["cometkiwi_mean"] - sum(v) / len(v)) < 1e-9 and r["cometkiwi_min"] == min(v) and r["n_seg_scored"] == len(v)
            assert r["metricx_min"] == -max(v) and r["metricx_err_max"] == max(v) and abs(r["metricx_err_mean"] - sum(v) / len(v)) < 1e-9
        else:
            assert r["cometkiwi_mean"] is None and r["n_seg_scored"] == 0 and len(s) == 1
        assert (r["roundtrip_chrf"] is None) == (back is None) and (back is None or abs(r["roundtrip_chrf"] - brute_chrf(back, src)) < 1e-9)
        peers = [h.split("QUESTION: ")[-1] for i, u, _, h, _ in RECORDS if i == item_id and u != t]
        want = sum(brute_chrf(hyp.split("QUESTION: ")[-1], p) for p in peers) / len(peers) if len(peers) >= 2 else None
        assert r["consensus_chrf"] == want or abs(r["consensus_chrf"] - want) < 1e-9
    assert (got["q1", "m2"]["option_swap_n"], got["q1", "m2"]["option_swaps"]) == (2, "A->B;B->A")
    assert got["q1", "m1"]["option_swap_n"] == 0 and got["q1", "m3"]["option_swap_n"] == 0
    decided = {(r.item_id, r.translator): (r.decision, r.decision_reason) for r in quality.decide(items).collect()}
    assert decided["q1", "m2"][0] == "FLAG" and "hard:option_swap_n" in decided["q1", "m2"][1]
    assert "hard:seg_mismatch" in decided["q1", "m3"][1] and "hard:dup_option_n" in decided["q1", "m3"][1] and "hard:latin_word_n" in decided["q3", "m1"][1]
    # A second run finds all scores in the stores.
    calls = []

    def refuses():
        raise AssertionError(calls)

    rows = spark.createDataFrame(RECORDS, "item_id string, translator string, src_raw string, hyp_raw string, bt_raw string")
    _, again = jobs.score(rows, str(tmp_path), [jobs.Metric("cometkiwi", refuses), jobs.Metric("metricx", refuses, True)], vowels, version="2")
    assert {(r.item_id, r.translator): r.asDict() for r in again.collect()} == got


def test_records_to_decided_items(spark, tmp_path):
    recs = [{"item_id": i, "model": t, "english": s, "bangla": h} for i, t, s, h, _ in RECORDS] + [{"item_id": "q9", "model": "m1", "english": "x", "error": "timeout"}, {"item_id": "q8", "model": "m1", "english": "x", "bangla": " "}]
    put(tmp_path / "r.json", json.dumps(recs))
    put(tmp_path / "bt.csv", "item_id,translator,back_en\nq1,m1,old\nq1,m1,Give 5 mg now\n")
    out = jobs.score_records(spark, f"{tmp_path}/r.json", f"{tmp_path}/out", f"{tmp_path}/bt.csv")
    assert out.count() == 5
    (name,) = glob.glob(f"{tmp_path}/out/item_scores_csv/*.csv")
    raw = open(name, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf")
    rows = list(csv.DictReader(raw.decode("utf-8-sig").splitlines()))
    assert {r["decision"] for r in rows} <= {"FLAG", "PASS", "REVIEW"} and len(rows) == 5
    assert tuple(spark.read.json(f"{tmp_path}/out/counts").select("n", "n_error", "n_blank").head()) == (7, 1, 1)


# ---- translation


def server():
    def ask(prompt):
        name = prompt.split("ITEM_ID: ")[1].split("\n")[0]
        if "boom" in prompt:
            raise RuntimeError("no answer")
        if "blank" in prompt:
            return {"text": " ", "done_reason": "stop", "eval_count": 0}
        return {"text": f"QUESTION: {'ক' * 25} {name}", "done_reason": "length" if "long" in prompt else "stop", "eval_count": 5, "eval_ns": 2_000_000_000, "load_ns": 250_000_000}

    return ask


def test_a_batch_of_translations(spark, tmp_path):
    bodies = ["one", "boom", "boom two", "long", "three\nA. x\nB. y", "boom", "blank", "boom again", "never", "never too"]
    put(tmp_path / "items.json", json.dumps([{"id": f"q{i}", "en": b, "answer": "A"} for i, b in enumerate(bodies)]))
    items = readers.read_items(spark, f"{tmp_path}/items.json").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        counts = jobs.translate_batch(items, f"{tmp_path}/a", server, "m", prompt_file="p1")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    recs = {r.item_id: r for r in spark.read.parquet(f"{tmp_path}/a/records").collect()}
    assert sorted(recs) == [f"q{i}" for i in range(8)] and counts == {"ran": 8, "bad": 8, "in_file": 8}  # gives up after three failures in a row
    assert (recs["q1"].error, recs["q1"].problems, recs["q1"].timing, recs["q1"].bangla) == ("no answer", [], "", "")
    assert recs["q0"].problems == ["answer_option_missing_A"] and recs["q0"].timing == "load 0.2s, 5 tokens at 2.5 per second"
    assert recs["q3"].problems == ["stopped_length", "answer_option_missing_A"] and recs["q6"].problems == ["empty_output"]
    assert recs["q4"].problems == ["option_count_0_vs_2", "answer_option_missing_A"] and recs["q4"].num_ctx == "model default"
    before = spark.read.parquet(f"{tmp_path}/a/records")
    mended = items.withColumn("en", F.regexp_replace("en", "boom|blank", "mended"))
    counts = jobs.translate_batch(mended, f"{tmp_path}/b", server, "m", before)
    assert counts == {"ran": 7, "bad": 7, "in_file": 10}  # q0, q3 and q4 have an output already
    assert all(not r.error for r in spark.read.parquet(f"{tmp_path}/b/records").collect())


# ---- back-translation


def shout():
    return lambda texts: [t.upper() + ("" if "long" in t or len(t.split()) <= 20 else "!") for t in texts]


def drops_long():
    return lambda texts: ["" if len(t.split()) > 20 else t.upper() for t in texts]


def brute_back(src, hyp, model, words):
    import re

    stem, *options = re.split(r"(?m)^(?=[A-H]\. )", hyp)
    pieces = []
    for line in stem.split("\n"):
        for s in re.split(r"(?<=[।?!])\s*", line):
            w = s.split()
            if not w:
                continue
            if len(w) <= words:
                pieces.append(s.strip())
                continue
            packed, cur = [], ""
            for part in re.split(r"(?<=[;,।])\s+", s.strip()):
                if cur and len((cur + " " + part).split()) > words:
                    packed.append(cur.strip())
                    cur = part
                else:
                    cur = (cur + " " + part).strip()
            packed.append(cur)
            pieces += [" ".join(x.split()[i : i + words]) for x in packed for i in range(0, len(x.split()), words)]
    en = " ".join(model(pieces)) + "\n" + "\n".join(f"{o[0]}. {model([o[3:].strip()])[0]}" for o in options)
    return en.strip(), len(pieces)


@pytest.mark.parametrize("factory", [shout, drops_long])
def test_back_translation_equals_brute_force(spark, factory):
    rng = random.Random(1)
    word = lambda: rng.choice("abcde") + "".join(rng.choice("abcdeকখগ") for _ in range(rng.randrange(5)))
    rows = []
    for i in range(40):
        stem = "".join(word() + rng.choice([" "] * 30 + [", ", "; ", "। ", "? ", "! ", "\n"]) for _ in range(rng.choice([0, 3, 30, 120]))).strip()
        rows.append((i, "t", "x" * rng.choice([0, 1, 10, 500, 2000]), item(stem, [word() for _ in range(rng.randrange(4))]).strip()))
    got = {r.id: r for r in scores.back_translated(spark.createDataFrame(rows, "id int, translator string, src_raw string, hyp_raw string"), factory, ["id", "translator"]).collect()}
    assert len(got) == 40
    retried = 0
    for i, _, src, hyp in rows:
        en, n = brute_back(src, hyp, factory(), 40)
        retry = 0
        if len(en) / max(len(src), 1) < 0.7:
            en2, n2 = brute_back(src, hyp, factory(), 20)
            if len(en2) > len(en):
                en, n, retry = en2, n2, 1
        r = got[i]
        assert (r.back_en, r.n_chunks, r.retry, r.len_ratio) == (en, n, retry, round(len(en) / max(len(src), 1), 3)), i
        retried += retry
    assert retried or factory is shout


def test_a_text_is_translated_again_only_if_it_came_out_short(spark, tmp_path):
    log = f"{tmp_path}/asked"

    def factory():
        def model(texts):
            with open(log, "a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return ["" if t.startswith("lost") else t for t in texts]

        return model

    rows = [(1, "source", "some words kept"), (2, "source", "other words, kept"), (3, "source", "lost words")]
    df = spark.createDataFrame(rows, "id int, src_raw string, hyp_raw string")
    got = scores.back_translated(df, factory, ["id"])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("[run(piece") == 1  # the second round; the first is a table
    assert {r.id: (r.back_en, r.retry) for r in got.collect()} == {1: ("some words kept", 0), 2: ("other words, kept", 0), 3: ("", 0)}
    assert sorted(open(log).read().split("\n")[:-1]) == ["lost words", "lost words", "other words, kept", "some words kept"]


# ---- sample and statistics


def rated_items(spark, n=120):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        for t in ("m1", "m2"):
            bad = rng.random() < 0.3
            rows.append((f"q{i}", t, rng.random() - bad / 2 if i % 9 else None, rng.random() - bad / 2, rng.random(), rng.random() * 100, int(rng.random() < 0.1), bad))
    return spark.createDataFrame(rows, "item_id string, translator string, cometkiwi_min double, cometkiwi_mean double, metricx_mean double, roundtrip_chrf double, option_swap_n int, bad boolean")


def test_sheets_queues_and_calibration(spark, tmp_path):
    items = rated_items(spark)
    long = items.select("item_id", "translator", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seg_id")).select("*", F.concat_ws("-", F.lit("s"), "item_id", "seg_id").alias("src_en"), F.concat_ws("-", F.lit("h"), "translator", "item_id", "seg_id").alias("hyp_bn"), F.lit(0).alias("seg_mismatch"))
    jobs.write_sheets(jobs.rating_sheets(items, long, 60, 20), str(tmp_path))
    read = lambda n: [dict(r) for f in glob.glob(f"{tmp_path}/{n}/*.csv") for r in csv.DictReader(open(f, encoding="utf-8-sig", newline=""))]
    key, sheet, second, anchor, guide = (read(n) for n in ("rating_key", "rating_sheet", "rating_sheet_rater2", "anchor_key", "rating_guide"))
    assert [r["row_id"] for r in key] == [f"R{i + 1:04d}" for i in range(80)] == [r["row_id"] for r in sheet] and len(second) == 40 and len(anchor) == 10 and len(guide) == 22
    parts = [r["part"] for r in key]
    assert (parts.count("random"), parts.count("targeted_worst"), parts.count("targeted_disagree")) == (60, 10, 10)
    assert not {r["item_id"] for r in anchor} & {r["item_id"] for r in key}
    who = {r["row_id"]: r for r in key}
    for r in sheet:
        k = who[r["row_id"]]
        assert r["src_en"] == "\n".join([f"s-{k['item_id']}-0", f"A. s-{k['item_id']}-1", f"B. s-{k['item_id']}-2"]) and r["tier"] == r["note"] == ""
        assert k["translator"] in r["hyp_bn"]
    assert {r["row_id"] for r in second} <= set(who)
    records = items.select("item_id", F.col("translator").alias("model"), F.lit("e").alias("english"))
    sheets = {n: readers.read_csv(spark, f"{tmp_path}/{n}") for n in ("rating_key", "rating_sheet_rater2", "anchor_key")}
    got = {n: [(r.row_id, r.item_id) for r in df.collect()] for n, df in jobs.queues(sheets, records).items()}
    assert got["rating_queue"] == [(r["row_id"], r["item_id"]) for r in key] and len(got["rating_queue_rater2"]) == 40 and len(got["anchor_queue"]) == 10
    with pytest.raises(ValueError):
        jobs.queues(sheets, records.limit(3))
    # Ratings as a filled sheet, and those of a second rater by item with repeats, the last of which counts.
    bad = {(r.item_id, r.translator): r.bad for r in items.collect()}
    tier = {r["row_id"]: ("D2" if bad[r["item_id"], r["translator"]] else " D0 ") for r in key}
    first = spark.createDataFrame([(k, t, "4", "yes", "number; script" if "2" in t else "") for k, t in tier.items()] + [("R9999", "D0", "1", "no", ""), ("R0001", None, "3", "", "")], "row_id string, tier string, fluency string, acceptable string, tags string")
    rows2 = [(x, who[r["row_id"]]["item_id"], t, f) for r in second for x, t, f in ((1, "D3", "1"), (2, tier[r["row_id"]].strip(), "4" if r["row_id"] > "R0040" else "5"))]
    rater2 = spark.createDataFrame([r for r in rows2 if sum(s[1] == r[1] for s in rows2) == 2], "line_order int, item_id string, tier string, fluency string")
    found = jobs.calibrate(first, sheets["rating_key"], items, f"{tmp_path}/stats", rater2, n_boot=10, n_boot_cv=5)
    value = {r.statistic: r.value for r in found.collect()}
    scored = [(r, bad[r["item_id"], r["translator"]]) for r in key]
    assert value["auroc_n_all_enriched"] == 80 and value["auroc_n_bad_all_enriched"] == sum(b for _, b in scored)
    assert 0.5 < value["kappa_tier"] <= 1 and value["n_double_rated"] > 0 and value["spearman_n_boot_used"] == 10 and value["cv_n_boot_used"] <= 5
    line = value["cometkiwi_min_threshold"]
    least = {(r.item_id, r.translator): r.cometkiwi_min for r in items.collect()}
    assert abs(value["flag_share_full_set"] - sum(v is not None and v <= line for v in least.values()) / len(least)) < 1e-9
    fired = {(r.item_id, r.translator) for r in items.filter("option_swap_n > 0").collect()}
    hit = [b for r, b in scored if (r["item_id"], r["translator"]) in fired]
    assert (value["option_swap_fired_in_sample"], value["option_swap_fired_on_D0_D1"]) == (len(hit), hit.count(False))
    limits = readers.read_thresholds(spark, f"{tmp_path}/stats/thresholds")
    assert limits["cometkiwi_min_threshold"] == line and limits["rank_gap"] == value["rank_gap"]
    tags = [dict(r) for f in glob.glob(f"{tmp_path}/stats/recall_per_tag/*.csv") for r in csv.DictReader(open(f, encoding="utf-8-sig"))]
    caught = sum(b and least[r["item_id"], r["translator"]] <= line for r, b in scored)
    assert [(r["tag"], int(r["items"]), int(r["caught"])) for r in tags] == [(t, sum(b for _, b in scored), caught) for t in ("number", "script")]


def test_kappa_counts_places_of_labels(spark):
    from glossmark.operators import stats

    rows = [(0, 0), (0, 3), (3, 3), (3, 3), (1, 0), (1, 1)]
    labels = sorted({x for r in rows for x in r})
    at = [(labels.index(a), labels.index(b)) for a, b in rows]
    seen = sum((i - j) ** 2 for i, j in at)
    chance = sum((i - j) ** 2 for i, _ in at for _, j in at) / len(at)
    got = stats.weighted_kappa(spark.createDataFrame(rows, "a int, b int"), "a", "b").head()
    assert got.n == 6 and abs(got.kappa - (1 - seen / chance)) < 1e-12
    assert tuple(stats.weighted_kappa(spark.createDataFrame([], "a int, b int"), "a", "b").head()) == (0, None)


# ---- stream


def test_stream_scores_each_segment_once_over_restarts(spark, tmp_path):
    part = lambda a, b: spark.createDataFrame([(f"i{i}", "t", 0, "src", "hyp" * i, i % 5 == 0) for i in range(a, b)], "item_id string, translator string, seg_id int, src_en string, hyp_bn string, m boolean").withColumn("seg_mismatch", F.col("m").cast("int")).drop("m")
    for a, b in ((0, 20), (10, 30), (0, 30)):
        part(a, b).write.mode("append").parquet(f"{tmp_path}/in")
        incremental.score_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", "m", lengths).awaitTermination()
        got = [(r.item_id, r.m) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
        assert sorted(got) == sorted((f"i{i}", 3 - 3 * i / 7) for i in range(max(b, 20)) if i % 5)
