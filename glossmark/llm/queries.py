"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.llm import collocations, decontaminate, html_text, jaccard, merkle, mixing, pii, quality, secrets, sharding, tokens, topk, url_filter
from glossmark.llm.common import table

N_SHARDS = 24


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_blocks(tokens.write_blocks(table(spark, sf_dir, "documents"), tokenizer_path()))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.verdict(quality.BASE_POLICY)).alias("base_failed"), quality.verdict(quality.DEFAULT_POLICY).alias("kept"), "failed_bits",
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), N_SHARDS)


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    return merkle.manifest(table(spark, sf_dir, "documents"), changes=more, changed=F.crc32(F.col("doc_id").cast("string")) % 7 == 0, proofs=False)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_html_extraction, op2_url_filter, op3_mixing, op4_pii, op5_ngram_join, op6_decontamination, op7_token_output, op8_secrets, op9_quality_rules, op10_sharding, op11_topk_search, op12_merkle_manifest, op13_collocations)
    return {f.__name__: f for f in ops}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

# Distinct three-word shingles, pairs by shared ones, and all that links reach.
OP5_SQL = rf"""with recursive w as (select doc_id, regexp_extract_all({_LOWER}, {_SPACED}) as ws from documents),
g as (select distinct doc_id, array_to_string(ws[i : i + 2], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as k from g x join g y on x.g = y.g and x.doc_id < y.doc_id group by all),
links as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
both_ways as (select a, b from links union select b, a from links),
reached as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reached r join both_ways l on l.a = r.b),
least as (select a, min(b) as c from reached group by a)
select doc_id, coalesce(n.n, 0) as n_shingles, least.c as component_id from documents left join n using (doc_id) join least on least.a = doc_id"""

# Windows of the benchmark, and those of the documents of every length that it has.
OP6_SQL = rf"""with w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
wanted as (select distinct item_id, least(len(ws), 10) as size, array_to_string(ws[i : i + 9], ' ') as k
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) as i from b where len(ws) > 0)),
there as (select doc_id, size, i, array_to_string(ws[i : i + size - 1], ' ') as k
  from (select doc_id, size, ws, unnest(range(1, len(ws) - size + 2)) as i from w, (select distinct size from wanted) where len(ws) >= size)),
met as (select doc_id, i, size, item_id from there join wanted using (size, k)),
hit as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + size)) as j from met) group by doc_id),
found as (select doc_id, count(distinct item_id) as n, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from met group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(hit.n, 0) as n_hit, coalesce(found.n, 0) as n_items,
  sha256(coalesce(found.items, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from w left join hit using (doc_id) left join found using (doc_id)"""

# The measurements, and the bits of the rules in their order.
OP9_SQL = rf"""with t as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, regexp_extract_all(t, {_SPACED}) as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_SPACED})) as ls from t),
windows as (select r, i, count(*) over (partition by r, ws[i], ws[i + 1], ws[i + 2]) as n from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w)),
repeated as (select r, count(distinct j) as n from (select r, unnest([i, i + 1, i + 2]) as j from windows where n > 1) group by r),
m as (select doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(ls) as n_lines,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(repeated.n, 0) as n_repeat_words
  from t join w using (r) left join repeated using (r)),
f as (select *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (100 * n_symbols > 30 * n_words)::bigint
  + 8 * (word_chars < 2 * n_words or word_chars > 20 * n_words)::bigint + 16 * (n_lines > 3 and 100 * n_dup_lines > 50 * n_lines)::bigint as failed_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 > 0 as base_failed, failed_bits = 0 as kept, failed_bits from f"""


OP11_SQL = """with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null),
s as (select q.r, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2]))::bigint as score from v q join v c on q.r <> c.r where q.vec_id % 20 = 0)
select query_id, rank, vec_id, score from (select *, row_number() over (partition by r order by score desc, vec_id)::int as rank from s) where rank <= 20"""

_FIELD = "coalesce(octet_length(encode({0}::varchar)) || ':' || {0}::varchar, '-')".format
_CRC = "list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, i: xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end)))"
_LEAF = "sha256({} || {} || {} || {} || {})".format

# All levels of the trees of the languages (t) and of the tree of their subroots (u); steps to the siblings, folded from a leaf.
OP12_SQL = f"""with recursive d as (select doc_id, lang, {_LEAF(*map(_FIELD, ("doc_id", "source", "lang", "n_chars", "text")))} as leaf,
  {_LEAF(*map(_FIELD, ("doc_id", "source", "lang", "(n_chars + 1)", "text")))} as other, coalesce(xor({_CRC}, 4294967295) % 7 = 0, false) as changed from documents),
l as (select *, coalesce('s' || lang, '-') as g, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from d),
t as (select g, 0 as lev, pos, leaf as node from l
  union all select g, lev + 1, pos // 2, sha256(string_agg(node, '' order by pos)) from (select *, count(*) over (partition by g) as c from t) where c > 1 group by g, lev, pos // 2),
s as (select g, max(lev) as top, max_by(node, lev) as subroot, row_number() over (order by g) - 1 as pos from t group by g),
u as (select 0 as lev, pos, subroot as node from s
  union all select lev + 1, pos // 2, sha256(string_agg(node, '' order by pos)) from (select *, count(*) over () as c from u) where c > 1 group by lev, pos // 2),
r as (select max(lev) as top, max_by(node, lev) as root from u),
low as (select x.g, x.i, 0 as tree, x.lev, o.node, o.pos < x.i >> x.lev as is_left
  from (select l.g, l.pos as i, unnest(range(top)) as lev from l join s using (g)) x left join t o on o.g = x.g and o.lev = x.lev and o.pos = xor(x.i >> x.lev, 1)),
high as (select x.g, 1 as tree, x.lev, o.node, o.pos < x.i >> x.lev as is_left
  from (select g, s.pos as i, unnest(range(r.top)) as lev from s, r) x left join u o on o.lev = x.lev and o.pos = xor(x.i >> x.lev, 1)),
both_trees as (select * from low union all select l.g, l.pos, tree, lev, node, is_left from l join high using (g)),
ways as (select g, i, list(case when node is null then '-' when is_left then 'L' || node else 'R' || node end order by tree, lev) as steps, string_agg(node, '' order by tree, lev) as siblings from both_trees group by g, i),
done as (select doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) as proof_sha256, list_reduce(list_concat([case when changed then other else leaf end], coalesce(steps, [])),
  lambda a, x: case when x = '-' then sha256(a) when x[1] = 'L' then sha256(x[2:] || a) else sha256(a || x[2:]) end) as folded_root from l join s using (g) cross join r left join ways on ways.g = l.g and ways.i = l.pos)
select *, folded_root = root as verified from done"""


# Pieces, their phrases of up to four words, the lowest of the cuts, and no candidate that a longer one covers.
OP13_SQL = rf"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) as p from documents),
w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as ws from p),
g as (select lang, k, array_to_string(ws[i : i + k - 1], ' ') as phrase from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, unnest(range(1, 5)) as u(k)) where k >= 1),
f as (select lang, k, phrase, count(*) as a from g group by all), totals as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
c as (select *, string_split(phrase, ' ') as ws from f where k > 1 and a >= 30),
cuts as (select c.lang, c.k, c.phrase, c.a, j, x.a as l, y.a as r, (2000000::hugeint * c.a // (x.a + y.a))::bigint as score
  from (select *, unnest(range(1, k)) as j from c) c join f x on x.lang = c.lang and x.phrase = array_to_string(c.ws[1 : j], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.ws[j + 1 :], ' ')),
best as (select lang, k, phrase, a, min(struct_pack(score := score, j := j, l := l, r := r)) as x from cuts group by all),
inside as (select lang, a, array_to_string(ws[i : i + m - 1], ' ') as phrase from (select lang, ws, a, k, m, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from c))),
kept as (select lang, phrase, a, x.l as l, x.r as r, x.score as score from best where not exists (select 1 from inside i where i.lang = best.lang and i.phrase = best.phrase and 100::hugeint * i.a >= 80::hugeint * best.a))
select * from (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept join totals using (lang)) where rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """The other methods (models, templates, token files, digests of text bytes) are beyond SQL."""
    return {"op5_ngram_join": OP5_SQL, "op6_decontamination": OP6_SQL, "op9_quality_rules": OP9_SQL, "op11_topk_search": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_collocations": OP13_SQL}
