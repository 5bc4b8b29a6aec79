"""Top-k search, Merkle manifest and phrase collocations against brute-force versions written from their contracts; their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmark.llm import collocations, merkle, queries, topk

# ---- 11: exact top-k search


def brute_top_k(rows, k, every, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i % every == 0:
            found = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(kept) if a != b)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def top_k_rows(spark, rows, **more):
    found = topk.top_k(spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cell int, query_id string"), **more)
    return sorted(map(tuple, found.collect()))


def test_top_k_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op11_topk_search(spark, sf_dir).collect())) == brute_top_k(rows, 20, 20)


@pytest.mark.parametrize("size", [1, 1e5, 3e6, 7e6])
def test_top_k_of_any_size_of_numbers(spark, size):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-size, size) for _ in range(40)]) for i in range(300)]
    got = top_k_rows(spark, rows, k=5, every=10, pack_rows=32, block_queries=8, cell_rows=100)
    assert got == brute_top_k(rows, 5, 10)


def test_top_k_ties_and_repeats(spark):
    rng = random.Random(4)
    rows = [(i, [1.0, 0.5, -1.0]) for i in range(400)] + [(i, [rng.choice([0.0, 0.25, 1.0]) for _ in range(3)]) for i in range(300, 700)]
    rng.shuffle(rows)
    got = top_k_rows(spark, rows, k=7, every=20, pack_rows=64, block_queries=16, cell_rows=200)
    assert got == brute_top_k(rows, 7, 20)


def test_top_k_odd(spark):
    rows = [(0, None), (None, [1.0]), (20, []), (40, [1.0, None]), (60, [1.0, math.nan]), (80, [math.inf]), (100, [2.0]), (120, [1.0] * 200), (3, [-0.001, 5.0]), (1, [0.0])]
    assert top_k_rows(spark, rows) == brute_top_k(rows, 20, 20)
    assert top_k_rows(spark, rows[6:7]) == [] and top_k_rows(spark, []) == [] and top_k_rows(spark, rows[:2]) == []
    assert top_k_rows(spark, [(0, [1e300]), (1, [1e300]), (2, [-1e300])]) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_top_k_prunes():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64)) * np.linspace(3, 0.1, 64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    row = lambda a, b: {"n": b - a, "dims": 64, "width": 8, "ids": np.arange(a, b).tobytes(), "rows": np.arange(a, b).tobytes(), "data": np.ascontiguousarray(np.floor(64 * x[a:b]).astype(np.int64).T).tobytes()}
    asked, best, made = topk.joined_packs([row(0, 50), row(50, 100)]), topk.Best(100, 10), 0
    for a in range(0, 4000, 500):
        made += topk.search(asked, topk.Pack(row(a, a + 500), 64), best)
    assert made < 0.6 * 100 * 4000 * 64
    whole = np.floor(64 * x[:100]).astype(int) @ np.floor(64 * x).astype(int).T
    for q in range(100):
        assert best.ids[q].tolist() == sorted((j for j in range(4000) if j != q), key=lambda j: (-whole[q, j], j))[:10]


# ---- 12: Merkle dataset manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def brute_manifest(rows):
    """(doc_id, source, lang, n_chars, text) to the contract's rows."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = collections.defaultdict(list)
    for i, source, lang, n, text in rows:
        m = n + 1 if n is not None and i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else n
        groups[lang].append((i, *(digest(*map(field, (i, source, lang, k, text))) for k in (n, m))))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = [levels([r[1] for r in groups[g]]) for g in order]
    top = levels([t[-1][0] for t in trees]) if trees else []
    out = []
    for k, g in enumerate(order):
        for p, (i, a, at) in enumerate(groups[g]):
            siblings = []
            for tree, q in ((trees[k], p), (top, k)):
                for level in tree[:-1]:
                    other = level[q ^ 1 : (q ^ 1) + 1]
                    siblings += other
                    at = digest(*(other + [at] if q & 1 else [at] + other))
                    q >>= 1
            out.append((i, a, trees[k][-1][0], top[-1][0], digest(*siblings), at, at == top[-1][0]))
    return sorted(out, key=repr)


def manifest_rows(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 5, "g") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, root string, pos int, g string")
    changes = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    found = merkle.manifest(docs, changes=changes, changed=F.crc32(F.col("doc_id").cast("string")) % 7 == 0, **more)
    return found


def test_manifest_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, queries.op12_merkle_manifest(spark, sf_dir).collect()), key=repr) == brute_manifest(rows)


@pytest.mark.parametrize(("n", "n_langs", "bits", "top"), [(1, 1, 2, 4), (5, 5, 2, 4), (64, 1, 2, 4), (65, 1, 2, 4), (200, 3, 2, 8), (150, 40, 1, 4), (90, 90, 3, 2), (300, 2, 12, 4096)])
def test_manifest_of_any_shape(spark, n, n_langs, bits, top):
    rng = random.Random(n)
    rows = [(i, f"s{i % 3}", None if i % n_langs == 0 else f"l{rng.randrange(n_langs)}é", i, f"text {i}") for i in range(n)]
    got = manifest_rows(spark, rows, bits=bits, top=top).collect()
    assert sorted((tuple(r)[:7] for r in got), key=repr) == brute_manifest(rows)
    assert all(merkle.folded(r.leaf, r.proof) == r.root for r in got)


def test_manifest_odd(spark):
    rows = [(None, None, None, None, None), (None, "", "", 0, ""), (1, "s", "en", 2**63 - 1, "é" * 50_000), (14, "s", "en", None, "a:b"), (7, None, "en", -1, "x"), (7, None, "en", -1, "x"), (7, None, "en", 5, "y")]
    rows += [(k, "s", "fr", k, "same") for k in range(50)]
    got = manifest_rows(spark, rows, bits=2, top=8)
    assert sorted((tuple(r)[:7] for r in got.collect()), key=repr) == brute_manifest(rows)
    assert manifest_rows(spark, []).collect() == []


# ---- 13: phrase collocations


def brute_collocations(rows, min_count=30, top=2000):
    f, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = collections.defaultdict(list)
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= min_count}
    covered = {(lang, p[i : i + m]) for (lang, p), a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * f[lang, p[i : i + m]]}
    for (lang, p), a in candidates.items():
        if (lang, p) not in covered:
            score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, n + 1, p.decode(), -a, left, right, total[lang], -s) for lang, xs in out.items() for n, (s, a, p, left, right) in enumerate(sorted(xs)[:top]))


def collocation_rows(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n int")
    return sorted(map(tuple, collocations.collocations(docs, **more).collect()))


def test_collocations_equal_brute_force(spark, sf_dir):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()]
    assert sorted(map(tuple, queries.op13_collocations(spark, sf_dir).collect())) == brute_collocations(rows)


@pytest.mark.parametrize(("shard_words", "sieve_bits"), [(1, 4), (50, 12), (100_000, 26)])
def test_collocations_of_shards_of_any_size(spark, shard_words, sieve_bits):
    rng = random.Random(shard_words)
    words = ["a", "B", "b", "é", "\x00", "\x1c", "\xa0", "x\xffy", "don't", "#1"]
    rows = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\r\n", ",", "!"]) for _ in range(rng.randrange(60)))) for _ in range(150)]
    got = collocation_rows(spark, rows, min_count=3, shard_words=shard_words, sieve_bits=sieve_bits, top=40)
    assert got == brute_collocations(rows, 3, 40) and got


def test_collocations_odd(spark):
    rows = [(None, None), ("en", ""), ("en", " \t. "), ("en", "one two " * 20_000), ("fr", "seul"), (None, "same words here again " * 40), ("und", "same words here again " * 40)]
    assert collocation_rows(spark, rows) == brute_collocations(rows)
    assert collocation_rows(spark, []) == [] and collocation_rows(spark, rows[:3]) == []
