"""The pipeline's five stages against a brute-force version, over documents with every odd case."""

import collections
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from glossmark.llm import queries

SPACE = r"[^\x20\x09-\x0D]+"
WORD = r"[0-9A-Za-z\x80-\U0010FFFF]+"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def kept_by_rules(text):
    words = re.findall(SPACE, text or "")
    n, chars = len(words), sum(map(len, words))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    again, windows = set(), collections.Counter(zip(words, words[1:], words[2:]))
    for i in range(n - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    failed = n < 50 or 2 * len(again) > n or 100 * symbols > 30 * n or chars < 2 * n or chars > 20 * n
    return not (failed or len(lines) > 3 and 2 * (len(lines) - len(set(lines))) > len(lines))


def one_of_each(rows):
    sets = []
    for r in rows:
        w = re.findall(SPACE, lower(r[1]))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    rank, best = [(r[0] is None, r[0] or 0, r[1]) for r in rows], {}
    for k, x in enumerate(rank):
        best[find(k)] = min(best.get(find(k), x), x)
    return [r for k, r in enumerate(rows) if rank[k] == best[find(k)]]


def without_passages(text, windows):
    spans = [m.span() for m in re.finditer(WORD, text)]
    words = [lower(text[a:b]) for a, b in spans]
    hit = set()
    for n in {len(x) for x in windows}:
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
    if hit and len(hit) == len(words):
        return None
    out, at = [], 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out.append(text[at : spans[i][0]])
        if i + 1 not in hit:
            at = spans[i][1]
    return "\n".join([*out, text[at:]])


def source_order(counts):
    """The source of every row, by earliest deadline first over blocks of 16 with weights by the root of the counts."""
    w = {k: Fraction(math.sqrt(n)) for k, n in counts.items()}
    blocks = {k: -(-n // 16) for k, n in counts.items()}
    time = lambda v: sum(min(w[k] * v, Fraction(blocks[k])) for k in w)
    done, left, out = dict.fromkeys(w, 0), dict(counts), []
    for t in range(sum(blocks.values())):
        ready = [(math.ceil(round(float(time((done[k] + 1) / w[k])), 6)), k) for k in sorted(w) if done[k] < blocks[k] and math.floor(round(float(time(done[k] / w[k])), 6)) <= t]
        k = min(ready)[1]
        out += [k] * min(16, left[k])
        done[k], left[k] = done[k] + 1, left[k] - 16
    return out


def rows_of(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng, out = random.Random(4), list(docs)
    for i, t, lang, source, _ in docs[:80]:
        w = (t or "").split(" ")
        for copy in range(rng.randrange(4)):
            for _ in range(1 + len(w) // 50):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            out.append((10_000 + 10 * i + copy, " ".join(w), lang, source, len(" ".join(w))))
    prose = " ".join(f"word{rng.randrange(10**6)}" for _ in range(300))
    long = " ".join(f"long{rng.randrange(10**7)}" for _ in range(40_000))
    out += [(50_001, None, "en", "web", 0), (50_002, "", "en", "web", 0), (50_003, " \n ", None, None, 3), (50_004, long, "en", None, len(long))]
    out += [(50_005, prose, "en", "a", 1), (50_005, prose, "en", "a", 1), (None, prose, "en", "a", 1), (None, prose.replace("word", "item"), "en", "b", 1), (50_006, "one two", "en", "b", 7)]
    return [(*r, "x", 5, 6.0) for r in out]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, slot int, `__x` double"


def test_pipeline_equals_brute_force(spark, sf_dir, tmp_path):
    rows = rows_of(spark, sf_dir)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    windows = set()
    for t in items:
        w = [lower(x) for x in re.findall(WORD, t or "")]
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    want = one_of_each([r for r in rows if kept_by_rules(r[1])])
    want = [(r[0], t, r[3]) for r in want if (t := without_passages(r[1], windows)) is not None]
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    tool = Tokenizer.from_file(queries.tokenizer_path())
    ids = {}
    for doc, text, source in want:
        x = np.array([*tool.encode(text, add_special_tokens=False).ids, 0], "<u4")
        ids.setdefault((doc, len(x), zlib.crc32(x.tobytes())), []).append(source)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter({k: len(v) for k, v in ids.items()})
    assert len(want) > 100 and any(t != r[1] for r in rows for d, t, _ in want if d == r[0] and d is not None)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    # The order of the sources is the schedule's.
    key = lambda s: "-" if s is None else "s" + s
    there = [key(ids[r.doc_id, r.n_tokens, r.ids_crc32][0]) for r in got]
    assert there == source_order(collections.Counter(there))


def test_stages_keep_columns_and_take_empty_tables(spark, sf_dir, tmp_path):
    docs = spark.createDataFrame(rows_of(spark, sf_dir)[:40], SCHEMA)
    for table in (docs.limit(0), docs):
        table.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
            if i < 4:
                assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            out.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
