"""Registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmark.functions import checks, text
from glossmark.functions.chrf import chrf
from glossmark.operators import sampling, scores, stats
from glossmark.plans import quality
from glossmark.plans.views import ITEMS, PAIRS, RATED, items, pairs, rated, table
from glossmark.sources.readers import attach_back_translations, left_to_do

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

THRESHOLDS = {"cometkiwi_min_threshold": 0.05, "rank_gap": 0.6, "roundtrip_chrf_cut": 12.0}
# White space of the text functions as a class that both regex engines read.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LABEL = r"[A-L]|[\x{985}-\x{9b9}][\x{980}-\x{9ff}]{0,3}"
_FROM, _TO = text.SYMBOLS_FROM, text.SYMBOLS_TO


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: object) -> F.Column:
    return F.round(c, 6)


# ---- text


@query(f"select doc_id, md5(translate(text, '{_FROM}', '{_TO}')) as h, length(translate(text, '{_FROM}', '{_TO}')) as n from documents")
def q_symbol_normalise(spark, sf_dir):
    t = text.normalise_symbols(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("h"), F.length(t).cast("long").alias("n"))


@query(rf"""with c as (select conv_id, turn, ' ITEM_ID: ' || conv_id || chr(10) || ' QUESTION: ' || text || ' ' as t from conversations)
select conv_id, turn, md5(regexp_replace(translate(regexp_replace(regexp_replace(t, '\A{_WS}*ITEM_ID:[^\n]*\n?', ''), '\A{_WS}*QUESTION:{_WS}*', ''), '{_FROM}', '{_TO}'), '\A{_WS}+|{_WS}+\z', '', 'g')) as h from c""")
def q_wrapper_strip(spark, sf_dir):
    t = F.concat(F.lit(" ITEM_ID: "), F.col("conv_id").cast("string"), F.lit("\n QUESTION: "), F.col("text"), F.lit(" "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.clean_output(t)).alias("h"))


_SEG = rf"list_transform(string_split(regexp_replace(text, '(?m)^{_WS}*({_LABEL})[.:\x{{964}}]{_WS}', chr(1) || '\1' || chr(2), 'g'), chr(1)), lambda p: regexp_replace(regexp_replace(p, '\A[^\x02]*\x02', ''), '\A{_WS}+|{_WS}+\z', '', 'g'))"


@query(f"with s as (select doc_id, {_SEG} as s from documents) select doc_id, len(s) as n_segments, length(s[1]) as stem_chars, md5(array_to_string(s, chr(3))) as h, (len(s) - 1) - len(list_distinct(s[2:])) as dup from s")
def q_segment_options(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", text.segments(F.col("text")).alias("s"))
    dup = F.size("s") - 1 - F.size(F.array_distinct(F.slice("s", F.lit(2), F.size("s"))))
    return s.select("doc_id", F.size("s").cast("long").alias("n_segments"), F.length(F.col("s")[0]).cast("long").alias("stem_chars"), F.md5(F.array_join("s", "\x03")).alias("h"), dup.cast("long").alias("dup"))


@query("with s as (select doc_id, string_split(text, chr(10)) as p from documents) select doc_id, i - 1 as seg_id, md5(p[i]) as h from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from s)")
def q_segment_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seg_id", "t"))
    return d.select("doc_id", F.col("seg_id").cast("long").alias("seg_id"), F.md5("t").alias("h"))


@query("""with l as (select doc_id, string_split(text, chr(10)) as p from documents)
select doc_id, md5(array_to_string(list_transform(p, lambda x, i: case when i = 1 or i > 13 then x else substr('ABCDEFGHIJKL', cast(i - 1 as int), 1) || '. ' || x end), chr(10))) as h from l""")
def q_segment_relabel(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.relabelled(F.split("text", "\n"))).alias("h"))


@query(r"""select doc_id, len(regexp_extract_all(text, '\p{L}')) as letters, round(case when len(regexp_extract_all(text, '\p{L}')) > 0 then len(regexp_extract_all(text, '[a-zA-Z]')) / len(regexp_extract_all(text, '\p{L}')) else 0.0 end, 6) as frac from documents""")
def q_script_fraction(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(t, F.lit(r"\p{L}")).cast("long").alias("letters"), r6(checks.block_fraction(t, "[a-zA-Z]")).alias("frac"))


@query(rf"""with {PAIRS}, l as (select item_id, len(list_filter(regexp_extract_all(hyp, '[\x{{980}}-\x{{9ff}}]'), lambda c: regexp_matches(c, '\p{{L}}'))) as bn_letters,
len(regexp_extract_all(hyp, '[\x{{9f0}}\x{{9f1}}]')) as assamese_n, list_filter(regexp_extract_all(hyp, '[\x{{900}}-\x{{963}}\x{{966}}-\x{{97f}}]'), lambda c: not contains(src, c)) as d,
len(regexp_extract_all(hyp, '\x{{9cd}}\x{{9cd}}')) as double_virama_n,
list_filter(regexp_extract_all(hyp, '[\p{{L}}\p{{Nl}}\p{{No}}]'), lambda c: regexp_matches(c, '[^\x00-\x{{24f}}\x{{370}}-\x{{3ff}}\x{{900}}-\x{{9ff}}\x{{2000}}-\x{{206f}}]') and not contains(src, c)) as o,
list_filter(regexp_extract_all(hyp, '[\x{{370}}-\x{{3ff}}]'), lambda c: not contains(src, c) and not contains('{checks.GREEK_SYMBOLS}', c)) as g from pairs)
select item_id, bn_letters, assamese_n, len(d) as devanagari_n, double_virama_n, len(o) + len(g) as other_script_n, array_to_string(list_sort(list_distinct(list_concat(list_concat(o, g), d))), '') as other_script_chars from l""")
def q_script_leak_src_exempt(spark, sf_dir):
    c = checks.script_checks(F.col("hyp"), F.col("src"))
    n = [c[x].cast("long").alias(x) for x in ("assamese_n", "devanagari_n", "double_virama_n", "other_script_n")]
    return pairs(spark, sf_dir).select("item_id", F.regexp_count("hyp", F.lit(checks.BENGALI_LETTERS)).cast("long").alias("bn_letters"), *n, c["other_script_chars"].alias("other_script_chars"))


_TOKENS = lambda c: f"regexp_extract_all({c}, '[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*')"
_UNITS = "[" + ", ".join(f"'{u}'" for u in checks.UNITS) + "]"


@query(rf"""with {PAIRS}, p as (select item_id, {_TOKENS('src')} as st, hyp from pairs),
a as (select item_id, hyp, list_concat(list_transform(list_concat(list_concat(list_filter(st, lambda t: regexp_matches(t, '[A-Z0-9]')),
 list_filter(flatten(list_transform(list_filter(st, lambda t: regexp_matches(t, '[A-Z0-9]')), lambda t: string_split(t, '-'))), lambda t: regexp_matches(t, '[A-Z0-9]'))),
 list_filter(list_transform(range(1, len(st)), lambda i: case when list_contains({_UNITS}, lower(st[i])) and list_contains({_UNITS}, lower(st[i + 1])) then st[i] || st[i + 1] end), lambda t: t is not null)), lambda t: lower(t)), {_UNITS}) as allowed from p),
w as (select item_id, list_filter({_TOKENS(r"regexp_replace(hyp, '\(([^()]*[A-Za-z]{2,}[^()]*)\)', ' ', 'g')")}, lambda t: length(t) > 1 and not list_contains(allowed, lower(t))) as o,
 list_filter(flatten(list_transform(regexp_extract_all(hyp, '\(([^()]*[A-Za-z]{{2,}}[^()]*)\)', 1), lambda g: {_TOKENS('g')})), lambda t: length(t) > 1 and not list_contains(allowed, lower(t))) as g from a)
select item_id, len(o) as latin_word_n, md5(array_to_string(o, ' ')) as h, len(g) as gloss_n from w""")
def q_untranslated_tokens(spark, sf_dir):
    c = checks.untranslated_words(F.col("src"), F.col("hyp"))
    return pairs(spark, sf_dir).select("item_id", c["latin_word_n"].cast("long").alias("latin_word_n"), F.md5(c["latin_words"]).alias("h"), c["gloss_n"].cast("long").alias("gloss_n"))


_NUM = r"list_distinct(list_transform(regexp_extract_all({}, '\p{{Nd}}+(?:[.,]\p{{Nd}}+)?'), lambda n: replace(n, ',', '')))"


@query(f"""with d as (select a.doc_id, a.text as src, b.text as hyp from documents a join documents b on b.doc_id = a.doc_id + 1),
m as (select doc_id, list_sort({_NUM.format('src')}) as s, list_sort(list_filter({_NUM.format('src')}, lambda n: not list_contains({_NUM.format('hyp')}, n))) as x from d)
select doc_id, len(s) as num_src, len(x) as num_missing, len(list_filter(x, lambda n: contains(n, '.') or length(n) >= 3)) as num_hard_n, array_to_string(x, ' ') as num_missing_list,
round(case when len(s) > 0 then 1 - len(x) / len(s) else 1.0 end, 6) as num_recall from m""")
def q_numbers_preserved(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = d.select("doc_id", F.col("text").alias("src")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("hyp")), "doc_id")
    c = checks.numbers_preserved(F.col("src"), F.col("hyp"))
    return both.select("doc_id", *[c[n].cast("long").alias(n) for n in ("num_src", "num_missing", "num_hard_n")], c["num_missing_list"].alias("num_missing_list"), r6(c["num_recall"]).alias("num_recall"))


@query(rf"""with l as (select doc_id, list_transform(string_split(text, chr(10))[2:], lambda p: regexp_replace(regexp_replace(p, '{_WS}+', ' ', 'g'), '\A{_WS}+|{_WS}+\z', '', 'g')) as o from documents)
select doc_id, len(o) - len(list_distinct(o)) as dup from l""")
def q_duplicate_segments(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", checks.duplicate_options(F.split("text", "\n")).cast("long").alias("dup"))


@query(f"""with {PAIRS}, r as (select item_id, translator, length(hyp) / greatest(length(src), 1) as x from pairs), m as (select translator, median(x) as med from r group by 1),
d as (select r.translator, median(abs(x - med)) as mad from r join m on m.translator = r.translator group by 1)
select item_id, r.translator, round(x, 6) as len_ratio, round(case when mad = 0 then 0.0 else (x - med) / (1.483 * mad) end, 6) as len_z from r join m on m.translator = r.translator join d on d.translator = r.translator""")
def q_length_ratio_robust_z(spark, sf_dir):
    p = pairs(spark, sf_dir).select("item_id", "translator", checks.length_ratio(F.col("src"), F.col("hyp")).alias("x"))
    return stats.with_robust_z(p, "x", ["translator"], "z").select("item_id", "translator", r6("x").alias("len_ratio"), r6("z").alias("len_z"))


# Whole texts have too many grams for SQL: tests/test_whole_texts.py compares these two with brute force.
@query()
def q_chrf_pair(spark, sf_dir):
    return pairs(spark, sf_dir).select(F.col("item_id").alias("id"), r6(chrf(F.col("hyp"), F.col("src"))).alias("chrf"))


@query()
def q_chrf_consensus(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    rows = c.select(F.col("conv_id").alias("item_id"), F.col("turn").cast("string").alias("translator"), F.col("text").alias("hyp"))
    return scores.consensus(rows, chrf).select("item_id", "translator", r6("consensus_chrf").alias("consensus_chrf"))


_LOOSE = lambda c: rf"list_distinct(regexp_extract_all({c}, '(?m)^{_WS}*([A-L]){_WS}*[.:]{_WS}+', 1))"


@query(rf"""with {PAIRS}, b as (select item_id, src, regexp_replace(hyp, '\A{_WS}+|{_WS}+\z', '', 'g') as b from pairs),
k as (select item_id, src, b, len({_LOOSE('src')}) as ns, len({_LOOSE('b')}) as nb,
list_sort(list_filter(list_distinct(regexp_extract_all(b, '[^\x00-\x7f\x{{980}}-\x{{9ff}}]')), lambda c: regexp_matches(c, '\p{{L}}') and not contains(src, c))) as f from b)
select item_id, case when b = '' then 'empty_output' else array_to_string(list_filter([case when item_id % 5 = 0 then 'stopped_length' end, case when item_id % 7 = 0 then 'zero_token_count' end, 'untranslated',
case when len(f) > 0 then 'foreign_script_' || array_to_string(f[1:8], '') end, case when not contains(b, 'QUESTION:') then 'no_question_line' end,
case when ns > 0 and ns <> nb then 'option_count_' || nb || '_vs_' || ns end], lambda x: x is not null), ',') end as problems from k""")
def q_write_time_problems(spark, sf_dir):
    done = F.when(F.col("item_id") % 5 == 0, "length").otherwise("stop")
    p = checks.write_time_problems(F.col("src"), F.col("hyp"), done, F.when(F.col("item_id") % 7 == 0, 0).otherwise(9))
    return pairs(spark, sf_dir).select("item_id", F.array_join(p, ",").alias("problems"))


@query(rf"""with {PAIRS}, l as (select item_id, substr('ABCDEFGHIJKL', cast(item_id % 12 + 1 as int), 1) as k, string_split(hyp, chr(10)) as p from pairs),
o as (select item_id, k, array_to_string(list_transform(p, lambda x, i: case when i = 1 or i > 13 then x else substr('ABCDEFGHIJKL', cast(i - 1 as int), 1) || '. ' || x end), chr(10)) as t from l),
f as (select item_id, k, t, list_filter(string_split_regex(t, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_matches(x, '\A{_WS}*' || k || '{_WS}*[.:]{_WS}+')) as there from o)
select item_id, case when regexp_replace(t, '{_WS}+', '', 'g') <> '' and len(there) = 0 then 'answer_option_missing_' || k end as problem from f""")
def q_answer_key(spark, sf_dir):
    key = F.substring(F.lit(text.OPTION_LETTERS), (F.col("item_id") % 12 + 1).cast("int"), F.lit(1))
    return pairs(spark, sf_dir).select("item_id", checks.answer_key_problem(key, text.relabelled(F.split("hyp", "\n"))).alias("problem"))


@query()
def q_sentence_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    s, k = text.sentences(F.col("text")), text.chunked_sentences(F.col("text"), 20)
    return c.select("conv_id", "turn", F.size(s).alias("n_sentences"), F.size(k).alias("n_chunks"), F.array_max(F.transform(k, text.word_count)).alias("most_words"))


# ---- joins, rollups, scores


@query("""with b as (select o_custkey as item_id, max(o_orderkey) as k from orders group by 1)
select c_custkey as item_id, case when k % 3 = 0 or k % 5 = 0 then null when k % 7 = 0 then ' ' else 'o' || k end as bt_raw from customer left join b on b.item_id = c_custkey""")
def q_backlookup_fallback(spark, sf_dir):
    """The last row of an item counts: an empty text is none, a blank one is a text."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), F.lit("m0").alias("translator"), F.lit(None).cast("string").alias("bt_raw"))
    k = F.col("o_orderkey")
    text_of = F.when(k % 3 == 0, None).when(k % 5 == 0, "").when(k % 7 == 0, " ").otherwise(F.concat(F.lit("o"), k.cast("string")))
    back = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item_id"), text_of.alias("back_en"), k.alias("line_order"))
    return attach_back_translations(rows, back).select("item_id", "bt_raw")


@query("""select l_orderkey as item_id, l_returnflag as translator, round(avg(l_quantity), 6) as q_mean, min(l_quantity) as q_min, max(l_quantity) as q_max, count(l_quantity) as q_n from lineitem group by 1, 2""")
def q_segment_rollup(spark, sf_dir):
    long = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_returnflag").alias("translator"), F.col("l_quantity").alias("q"))
    return scores.segment_rollup(long, ["item_id", "translator"], ["q"]).withColumn("q_mean", r6("q_mean"))


@query("""select l_orderkey as item_id, round(avg(l_quantity) filter (l_returnflag = 'A'), 6) as A__q__mean, min(l_quantity) filter (l_returnflag = 'A') as A__q__min,
round(avg(l_quantity) filter (l_returnflag = 'N'), 6) as N__q__mean, min(l_quantity) filter (l_returnflag = 'N') as N__q__min from lineitem group by 1""")
def q_wide_pivot(spark, sf_dir):
    long = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_returnflag").alias("translator"), F.col("l_quantity").alias("q"))
    wide = scores.to_wide(long, ["q"], ["A", "N"])
    return wide.withColumns({c: r6(c) for c in wide.columns if c.endswith("__mean")})


_DOT = "list_sum(list_transform(range(1, 65), lambda i: cast({a}[i] as double) * cast({b}[i] as double)))"


@query(f"""select a.vec_id, round({_DOT.format(a='a.embedding', b='b.embedding')} / (sqrt({_DOT.format(a='a.embedding', b='a.embedding')}) * sqrt({_DOT.format(a='b.embedding', b='b.embedding')})), 5) as cos
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def q_cosine_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    both = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return both.select("vec_id", F.round(scores.cosine(F.col("a"), F.col("b")), 5).alias("cos"))


@query(f"""with e as (select vec_id // 16 as item_id, vec_id % 16 // 2 + 1 as seg, vec_id % 2 as side, embedding as v from embeddings),
x as (select h.item_id, h.seg as h, arg_max(s.seg, ({_DOT.format(a='s.v', b='h.v')})) as s from e h join e s on s.item_id = h.item_id where h.side = 1 and s.side = 0 group by 1, 2)
select item_id, count(*) filter (h <> s) as option_swap_n, coalesce(string_agg(substr('ABCDEFGHIJKL', cast(h as int), 1) || '->' || substr('ABCDEFGHIJKL', cast(s as int), 1), ';' order by h) filter (h <> s), '') as option_swaps from x group by 1""")
def q_option_swap(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("item_id"), (F.floor(F.col("vec_id") % 16 / 2) + 1).alias("seg"), (F.col("vec_id") % 2).alias("side"), F.col("embedding").alias("vec"))
    out = scores.option_swaps(e.filter("side = 0"), e.filter("side = 1"), ["item_id"])
    return out.withColumn("option_swap_n", F.col("option_swap_n").cast("long"))


@query("select l_orderkey, l_linenumber from lineitem l where not exists (select 1 from orders o where o.o_orderkey = l.l_orderkey and o.o_orderkey % 3 = 0)")
def q_incremental_antijoin(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 3 == 0).select(F.col("o_orderkey").alias("l_orderkey"))
    return left_to_do(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), done, ["l_orderkey"])


def _capitals():
    """A stand-in for a translator: capitals, and nothing for texts of more than 20 words."""
    return lambda texts: [t.upper() if len(t.split()) <= 20 else "" for t in texts]


# Sentences and their parts are beyond SQL: tests/test_whole_texts.py compares this with brute force.
@query()
def q_back_translation(spark, sf_dir):
    found = scores.back_translated(pairs(spark, sf_dir), _capitals, ["item_id", "translator"], "src", "hyp")
    return found.withColumn("back_en", F.md5("back_en"))


# ---- decisions

_HARD = "(" + " or ".join(f"{c} > 0" for c in quality.HARD_FLAGS) + " or abs(len_z) > 3.5)"
_REASON = ", ".join(f"case when {c} > 0 then 'hard:{c}' end" for c in quality.HARD_FLAGS)
_PCT = "case when {c} is not null then (rank() over (order by {c} nulls last) + (count(*) over (partition by {c}) - 1) / 2.0) / count({c}) over () end"
_DECIDED = f"""{ITEMS}, g as (select *, {_HARD} as hard, abs({_PCT.format(c='cometkiwi_mean')} - {_PCT.format(c='metricx_mean')}) as gap from items),
decided as (select *, case when hard or cometkiwi_min <= 0.05 then 'FLAG' when num_soft_n > 0 or coalesce(gap > 0.6, false) or coalesce(roundtrip_chrf < 12, false) then 'REVIEW' else 'PASS' end as decision,
concat_ws(';', {_REASON}, case when abs(len_z) > 3.5 then 'hard:len_z' end, case when cometkiwi_min <= 0.05 and not hard then 'flag:cometkiwi_min' end, case when num_soft_n > 0 and not hard then 'soft:num_soft_n' end,
case when gap > 0.6 and not hard then 'review:rank_gap' end, case when roundtrip_chrf < 12 and not hard then 'review:roundtrip_chrf' end) as decision_reason from g)"""


@query(f"with {ITEMS} select item_id, {_HARD} as hard from items")
def q_hard_flags(spark, sf_dir):
    df = items(spark, sf_dir)
    return df.select("item_id", quality.hard_flag(df).alias("hard"))


@query(f"with {_DECIDED} select item_id, translator, decision, decision_reason from decided")
def q_decide(spark, sf_dir):
    return quality.decide(items(spark, sf_dir), THRESHOLDS).select("item_id", "translator", "decision", "decision_reason")


@query(f"with {_DECIDED} select translator, count(*) filter (decision = 'FLAG') as FLAG, count(*) filter (decision = 'PASS') as PASS, count(*) filter (decision = 'REVIEW') as REVIEW from decided group by 1")
def q_decision_pivot(spark, sf_dir):
    return quality.decision_counts(quality.decide(items(spark, sf_dir), THRESHOLDS))


_POS, _SUM = "count(*) filter (coalesce({0}, 0) > 0)".format, "sum(coalesce({0}, 0))::bigint".format
_SUMMARY = {
    "records": "count(*)", "precomposed chars (items)": f"{_SUM('precomposed_n')} || ' (' || {_POS('precomposed_n')} || ')'", "option count mismatch (items)": _SUM("seg_mismatch"),
    "items with other-script letters": "count(*) filter (other_script_n + devanagari_n + assamese_n > 0)", "items with untranslated English (words)": f"{_POS('latin_word_n')} || ' (' || {_SUM('latin_word_n')} || ')'",
    "English gloss words": _SUM("gloss_n"), "items with a hard number miss": _POS("num_hard_n"), "items with a soft number miss": _POS("num_soft_n"), "items with duplicate options": _POS("dup_option_n"),
    "items with length z beyond 3.5": "count(*) filter (abs(len_z) > 3.5)", "items with option_swap": _POS("option_swap_n"), "items with any hard flag": "count(*) filter (hard)",
    "round-trip chrF mean (min)": "printf('%.1f (%.1f)', avg(roundtrip_chrf), min(roundtrip_chrf))",
} | {f"{c} (mean over items)": f"round(avg({c}), 3)" for c in ("cometkiwi_mean", "cometkiwi_min")} | {f"decision {d}": f"nullif(count(*) filter (decision = '{d}'), 0)" for d in ("PASS", "FLAG", "REVIEW")}


@query(f"with {_DECIDED} select * from (" + " union all ".join(f"""select '{k}' as "check", translator, ({v})::varchar as value from decided group by translator""" for k, v in _SUMMARY.items()) + ") where value is not null")
def q_summary(spark, sf_dir):
    return quality.summary(quality.decide(items(spark, sf_dir), THRESHOLDS))


_CLEAN = rf"""raw as (select * from pairs), clean as (select item_id, translator, translate(src, '{_FROM}', '{_TO}') as src, len(regexp_extract_all(hyp, '{text.PRECOMPOSED}')) as precomposed_n,
regexp_replace(translate(regexp_replace(regexp_replace(nfc_normalize(hyp), '\A{_WS}*ITEM_ID:[^\n]*\n?', ''), '\A{_WS}*QUESTION:{_WS}*', ''), '{_FROM}', '{_TO}'), '\A{_WS}+|{_WS}+\z', '', 'g') as hyp from raw)"""
_SEGMENTS = lambda c: _SEG.replace("(text,", f"({c},")
_QUOTED = lambda w: "'" + w.replace("'", "''") + "'"
_WORDS_OF = "map {" + ", ".join(f"'{k}': [{', '.join(map(_QUOTED, v))}]" for k, v in checks.NUMBER_WORDS.items()) + "}"
_ALONE = [c for c in quality.HARD_FLAGS if c != "option_swap_n"]

SCORE_SQL = rf"""with {PAIRS}, {_CLEAN},
seg as (select item_id, {_SEGMENTS(c='src')} as a, {_SEGMENTS(c='hyp')} as b from clean),
opt as (select item_id, len(a) as n_seg_src, len(b) as n_seg_hyp, (len(a) <> len(b))::int as seg_mismatch, list_transform(b[2:], lambda p: regexp_replace(regexp_replace(p, '{_WS}+', ' ', 'g'), '\A{_WS}+|{_WS}+\z', '', 'g')) as o from seg),
scr as (select item_id, case when len(regexp_extract_all(hyp, '\p{{L}}')) > 0 then len(list_filter(regexp_extract_all(hyp, '[\x{{980}}-\x{{9ff}}]'), lambda c: regexp_matches(c, '\p{{L}}'))) / len(regexp_extract_all(hyp, '\p{{L}}')) else 0.0 end as bengali_frac,
 len(regexp_extract_all(hyp, '[\x{{9f0}}\x{{9f1}}]')) as assamese_n, list_filter(regexp_extract_all(hyp, '[\x{{900}}-\x{{963}}\x{{966}}-\x{{97f}}]'), lambda c: not contains(src, c)) as d, len(regexp_extract_all(hyp, '\x{{9cd}}\x{{9cd}}')) as double_virama_n,
 list_filter(regexp_extract_all(hyp, '[\p{{L}}\p{{Nl}}\p{{No}}]'), lambda c: regexp_matches(c, '[^\x00-\x{{24f}}\x{{370}}-\x{{3ff}}\x{{900}}-\x{{9ff}}\x{{2000}}-\x{{206f}}]') and not contains(src, c)) as o,
 list_filter(regexp_extract_all(hyp, '[\x{{370}}-\x{{3ff}}]'), lambda c: not contains(src, c) and not contains('{checks.GREEK_SYMBOLS}', c)) as g,
 len(regexp_extract_all(hyp, '(?m)^{_WS}*[\x{{985}}-\x{{9b9}}][\x{{980}}-\x{{9ff}}]{{0,3}}[.:\x{{964}}]{_WS}')) as bn_option_labels_n from clean),
tok as (select item_id, {_TOKENS('src')} as st, hyp from clean),
alw as (select item_id, hyp, list_concat(list_transform(list_concat(list_concat(list_filter(st, lambda t: regexp_matches(t, '[A-Z0-9]')),
 list_filter(flatten(list_transform(list_filter(st, lambda t: regexp_matches(t, '[A-Z0-9]')), lambda t: string_split(t, '-'))), lambda t: regexp_matches(t, '[A-Z0-9]'))),
 list_filter(list_transform(range(1, len(st)), lambda i: case when list_contains({_UNITS}, lower(st[i])) and list_contains({_UNITS}, lower(st[i + 1])) then st[i] || st[i + 1] end), lambda t: t is not null)), lambda t: lower(t)), {_UNITS}) as allowed from tok),
lat as (select item_id, list_filter({_TOKENS(r"regexp_replace(hyp, '\(([^()]*[A-Za-z]{2,}[^()]*)\)', ' ', 'g')")}, lambda t: length(t) > 1 and not list_contains(allowed, lower(t))) as o,
 list_filter(flatten(list_transform(regexp_extract_all(hyp, '\(([^()]*[A-Za-z]{{2,}}[^()]*)\)', 1), lambda g: {_TOKENS('g')})), lambda t: length(t) > 1 and not list_contains(allowed, lower(t))) as g from alw),
num as (select item_id, hyp, list_sort({_NUM.format('src')}) as s, {_NUM.format(f"translate(hyp, '{text.BENGALI_DIGITS}', '0123456789')")} as h from clean),
mis as (select item_id, s, list_filter(s, lambda n: not list_contains(h, n) and len(list_filter(coalesce(({_WORDS_OF})[n], []), lambda w: contains(hyp, w))) = 0) as x from num),
har as (select *, len(list_filter(x, lambda n: contains(n, '.') or length(n) >= 3)) as hard from mis),
one as (select c.item_id, c.translator, c.precomposed_n, opt.seg_mismatch, n_seg_src, n_seg_hyp, length(hyp) / greatest(length(src), 1) as ratio, bengali_frac, assamese_n, len(scr.d) as devanagari_n, double_virama_n, len(scr.o) + len(scr.g) as other_script_n,
 array_to_string(list_sort(list_distinct(list_concat(list_concat(scr.o, scr.g), scr.d))), '') as other_script_chars, bn_option_labels_n, len(lat.o) as latin_word_n, array_to_string(lat.o, ' ') as latin_words, len(lat.g) as gloss_n,
 len(s) as num_src, len(x) as num_missing, hard as num_hard_n, len(x) - hard as num_soft_n, array_to_string(x, ' ') as num_missing_list, case when len(s) > 0 then 1 - len(x) / len(s) else 1.0 end as num_recall, len(opt.o) - len(list_distinct(opt.o)) as dup_option_n
 from clean c join opt on opt.item_id = c.item_id join scr on scr.item_id = c.item_id join lat on lat.item_id = c.item_id join har on har.item_id = c.item_id),
med as (select translator, median(ratio) as m from one group by 1), dev as (select one.translator, median(abs(ratio - m)) as d from one join med on med.translator = one.translator group by 1),
z as (select one.*, case when d = 0 then 0.0 else (ratio - m) / (1.483 * d) end as z from one join med on med.translator = one.translator join dev on dev.translator = one.translator),
h as (select *, ({" or ".join(f"{c} > 0" for c in _ALONE)} or abs(z) > 3.5) as hard from z)
select * exclude (ratio, z, hard, bengali_frac, num_recall), round(ratio, 6) as len_ratio, round(bengali_frac, 6) as bengali_frac, round(num_recall, 6) as num_recall, round(z, 6) as len_z, null::double as roundtrip_chrf,
case when hard then 'FLAG' when num_soft_n > 0 then 'REVIEW' else 'PASS' end as decision,
concat_ws(';', {", ".join(f"case when {c} > 0 then 'hard:{c}' end" for c in _ALONE)}, case when abs(z) > 3.5 then 'hard:len_z' end, case when num_soft_n > 0 and not hard then 'soft:num_soft_n' end) as decision_reason from h"""


@query(SCORE_SQL)
def q_score_pairs(spark, sf_dir):
    """The whole scoring job over conversation pairs, to one explained decision for each item."""
    p = pairs(spark, sf_dir).select("item_id", "translator", F.col("src").alias("src_raw"), F.col("hyp").alias("hyp_raw"), F.lit(None).cast("string").alias("bt_raw"))
    return quality.decide(quality.item_table(quality.prepared(p))).withColumns({c: r6(c) for c in ("len_ratio", "bengali_frac", "num_recall", "len_z")})


@query(f"with {ITEMS} select item_id, round(abs({_PCT.format(c='cometkiwi_mean')} - {_PCT.format(c='metricx_mean')}), 6) as rank_gap from items")
def q_rank_gap(spark, sf_dir):
    return stats.with_rank_gap(items(spark, sf_dir), "cometkiwi_mean", "metricx_mean").select("item_id", r6("rank_gap").alias("rank_gap"))


# ---- samples

_HASH = "substr(md5('42:' || {k}), 1, 15)"
_O = _HASH.format(k="item_id")


@query(f"with {ITEMS}, p as (select * from items order by cometkiwi_min, item_id limit (select count(*) // 10 from items)) select item_id from p order by {_O}, item_id limit 25")
def q_worst_decile(spark, sf_dir):
    df = items(spark, sf_dir).select("item_id", "cometkiwi_min")
    return sampling.draw(stats.lowest(df, "cometkiwi_min", "item_id", df.count() // 10), "item_id", 25).select("item_id")


@query(f"with {ITEMS}, g as (select item_id, abs({_PCT.format(c='cometkiwi_mean')} - {_PCT.format(c='metricx_mean')}) as gap from items) select item_id from g where gap is not null order by gap desc, item_id limit 25")
def q_top_disagree(spark, sf_dir):
    return sampling.largest(stats.with_rank_gap(items(spark, sf_dir), "cometkiwi_mean", "metricx_mean", "gap"), "gap", "item_id", 25).select("item_id")


_DRAW = f"drawn as (select item_id, translator from items qualify row_number() over (partition by translator order by {_O}, item_id) <= 50)"


@query(f"with {ITEMS}, {_DRAW} select * from drawn")
def q_stratified_draw(spark, sf_dir):
    return sampling.draw_by_stratum(items(spark, sf_dir).select("item_id", "translator"), "translator", "item_id", 50)


@query(f"with {ITEMS}, {_DRAW} select item_id from (select distinct item_id from items where item_id not in (select item_id from drawn)) order by {_O}, item_id limit 10")
def q_anchor(spark, sf_dir):
    df = items(spark, sf_dir).select("item_id", "translator")
    return quality.anchors(df, sampling.draw_by_stratum(df, "translator", "item_id", 50), "item_id").select("item_id")


@query(f"""with {ITEMS}, scored as (select * from items where cometkiwi_min is not null),
rand as (select * from scored qualify row_number() over (partition by translator order by {_O}, item_id) <= 150 // (select count(distinct translator) from scored)),
rest as (select * from scored where item_id not in (select item_id from rand)),
pool as (select * from rest order by cometkiwi_min, item_id limit (select greatest(25, count(*) // 10) from rest)), worst as (select * from pool order by {_O}, item_id limit 25),
rest2 as (select * from rest where item_id not in (select item_id from worst)), g as (select *, abs({_PCT.format(c='cometkiwi_mean')} - {_PCT.format(c='metricx_mean')}) as gap from rest2),
apart as (select * from g where gap is not null order by gap desc, item_id limit 25)
select item_id, translator, 'random' as part from rand union all select item_id, translator, 'targeted_worst' from worst union all select item_id, translator, 'targeted_disagree' from apart""")
def q_sample(spark, sf_dir):
    return quality.sample(items(spark, sf_dir), "item_id").select("item_id", "translator", "part")


@query(f"""with {RATED}, s as (select doc_id, part, row_number() over (partition by part = 'random' order by {_HASH.format(k='doc_id')}, doc_id) as r, count(*) over (partition by part = 'random') as n from rated) select doc_id, part from s where r <= n // 2""")
def q_second_rater(spark, sf_dir):
    return quality.second_rater(rated(spark, sf_dir).select("doc_id", "part"), "doc_id").select("doc_id", "part")


@query(f"""with {RATED}, v as (select doc_id, case when doc_id % 10 = 0 then 'D9' else tier end as tier, doc_id % 13 / 2.0 as fluency, case when doc_id % 4 = 0 then ['number', 'script'] when doc_id % 4 = 1 then ['bogus', 'Number'] else [] end as tags,
case when doc_id % 9 = 0 then 'maybe' else 'yes' end as ok from rated)
select doc_id as row_id, 'tier' as rule, '' as detail from v where tier = 'D9' union all select doc_id, 'fluency', '' from v where fluency < 1 or fluency > 5 union all select doc_id, 'tags', unnest(['bogus', 'Number']) from v where tags[1] = 'bogus'
union all select doc_id, 'meaning_tag', '' from v where tier in ('D2', 'D3') and not list_contains(tags, 'number') union all select doc_id, 'acceptable', '' from v where ok = 'maybe'""")
def q_rating_violations(spark, sf_dir):
    d, pick = F.col("doc_id"), F.when
    sheet = rated(spark, sf_dir).select(
        d.alias("row_id"), pick(d % 10 == 0, "D9").otherwise(F.concat(F.lit(" "), F.col("tier"), F.lit("\t"))).alias("tier"), ((d % 13) / 2).cast("string").alias("fluency"),
        pick(d % 4 == 0, "number; script").when(d % 4 == 1, "bogus; ;Number").otherwise("").alias("tags"), pick(d % 9 == 0, "maybe").otherwise(" Yes ").alias("acceptable"),
    )
    return quality.rating_violations(sheet)


# ---- statistics

_RANK = "(rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0)"


@query(f"with {RATED}, r as (select {_RANK.format(c='score')} as a, {_RANK.format(c='error')} as b from rated) select count(*) as n, round(corr(a, b), 6) as rho from r")
def q_spearman(spark, sf_dir):
    return stats.spearman(rated(spark, sf_dir), "score", "error").select("n", r6("rho").alias("rho"))


@query(f"""with {RATED}, r as (select doc_id, score as x, cast(substr(tier, 2) as int) as y from rated), p as (select sign(a.x - b.x) as sx, sign(a.y - b.y) as sy from r a join r b on a.doc_id < b.doc_id)
select (select count(*) from r) as n, round(sum(sx * sy) / sqrt(count(*) filter (sx <> 0) * cast(count(*) filter (sy <> 0) as double)), 6) as tau from p""")
def q_kendall(spark, sf_dir):
    r = rated(spark, sf_dir).withColumn("y", quality.tier_number(F.col("tier")).cast("double"))
    return stats.kendall(r, "score", "y").select("n", r6("tau").alias("tau"))


@query(f"with {RATED}, r as (select bad, (rank() over (order by -score) + (count(*) over (partition by score) - 1) / 2.0) as k from rated) select count(*) as n, sum(bad) as n_bad, round((sum(k) filter (bad = 1) - sum(bad) * (sum(bad) + 1) / 2.0) / (sum(bad) * (count(*) - sum(bad))), 6) as auroc from r")
def q_auroc(spark, sf_dir):
    return stats.auroc(rated(spark, sf_dir), "score", "bad").select("n", "n_bad", r6("auroc").alias("auroc"))


_LINE = "select {g} t as threshold, round(b / ab, 6) as recall, round(b / n, 6) as precision, round(n / an, 6) as flag_share from (select {g} score as t, sum(count(*)) over ({p} order by score) as n, sum(sum(bad)) over ({p} order by score) as b, sum(count(*)) over ({p}) as an, sum(sum(bad)) over ({p}) as ab from {t} group by {g} score) where ab > 0 and b / ab >= 0.9"


@query(f"with {RATED} select * from ({_LINE.format(g='', p='', t='rated')}) order by threshold limit 1")
def q_threshold(spark, sf_dir):
    return stats.threshold(rated(spark, sf_dir), "score", "bad", 0.9).select("threshold", *[r6(c).alias(c) for c in ("recall", "precision", "flag_share")])


@query(f"""with {RATED}, k as (select *, (row_number() over (partition by bad order by {_HASH.format(k='doc_id')}, doc_id) - 1) % 5 as f from rated), tr as (select g.f as fold, k.score, k.bad from k join (select distinct f from k) g on g.f <> k.f),
l as (select fold, min(threshold) as t from ({_LINE.format(g='fold,', p='partition by fold', t='tr')}) group by 1)
select cast(f as int) as fold, round(count(*) filter (bad = 1 and score <= t) / sum(bad), 6) as recall_cv, round(count(*) filter (bad = 1 and score <= t) / greatest(count(*) filter (score <= t), 1), 6) as precision_cv from k join l on l.fold = k.f where (select sum(bad) from k) >= 5 group by 1""")
def q_cv(spark, sf_dir):
    return stats.cross_validated(rated(spark, sf_dir), "doc_id", "score", "bad", 0.9).select("fold", r6("recall_cv").alias("recall_cv"), r6("precision_cv").alias("precision_cv"))


@query(f"""with {RATED}, r as (select cast(substr(tier, 2) as double) as a, cast((doc_id * 7 + bad * 2) % 4 as double) as b from rated)
select count(*) as n, round(1 - avg((a - b) * (a - b)) / (avg(a * a) - 2 * avg(a) * avg(b) + avg(b * b)), 6) as kappa from r""")
def q_kappa(spark, sf_dir):
    r = rated(spark, sf_dir).select(quality.tier_number(F.col("tier")).alias("a"), ((F.col("doc_id") * 7 + F.col("bad") * 2) % 4).alias("b"))
    return stats.weighted_kappa(r, "a", "b").select("n", r6("kappa").alias("kappa"))


@query(f"""with {RATED}, t as (select trim(unnest(string_split(case when doc_id % 3 = 0 then 'number; number;gloss' when doc_id % 3 = 1 then 'script' else '' end, ';'))) as tag, case when score <= 900 then 1 else 0 end as f from rated)
select tag, count(*) as n, round(avg(f), 6) as recall from t where tag <> '' group by 1""")
def q_tag_recall(spark, sf_dir):
    d = F.col("doc_id")
    r = rated(spark, sf_dir).withColumn("tags", F.when(d % 3 == 0, "number; number;gloss").when(d % 3 == 1, "script").otherwise(""))
    return stats.tag_recall(r, "tags", F.col("score") <= 900).select("tag", "n", r6("recall").alias("recall"))


@query(f"with {RATED} select round(quantile_cont(score, 0.9), 6) as cut, round(median(score), 6) as med from rated where bad = 1")
def q_chrf_cut(spark, sf_dir):
    return rated(spark, sf_dir).filter("bad = 1").agg(r6(F.percentile("score", 0.9)).alias("cut"), r6(F.median("score")).alias("med"))


_COPIES = "(" + " + ".join(f"(u >= {p})::int" for p in stats.POISSON) + ")"


@query(f"""with {RATED}, d as (select rep, score, error, ('0x' || substr(md5('42:' || rep || ':' || doc_id), 1, 13))::bigint as u from rated, range(200) as b(rep)),
c as (select rep, score, error, unnest(range({_COPIES})) as i from d), k as (select rep, (rank() over (partition by rep order by score) + (count(*) over (partition by rep, score) - 1) / 2.0) as a,
(rank() over (partition by rep order by error) + (count(*) over (partition by rep, error) - 1) / 2.0) as b from c), v as (select rep, corr(a, b) as rho from k group by 1)
select count(*) as n_boot_used, round(quantile_cont(rho, 0.025), 6) as lo, round(quantile_cont(rho, 0.975), 6) as hi from v where isfinite(rho)""")
def q_bootstrap_ci(spark, sf_dir):
    return stats.bootstrap_spearman(rated(spark, sf_dir), "score", "error", "doc_id", 200).select("n_boot_used", r6("lo").alias("lo"), r6("hi").alias("hi"))


_AREA = "select '{n}' as s, (sum(k) filter (bad = 1) - sum(bad) * (sum(bad) + 1) / 2.0) / (sum(bad) * (count(*) - sum(bad))) as v, count(*) as n, sum(bad) as b from (select bad, (rank() over (order by -score) + (count(*) over (partition by score) - 1) / 2.0) as k from {t})"


@query(f"""with {RATED}, rand as (select *, cast(substr(tier, 2) as double) as y from rated where part = 'random'),
rk as (select {_RANK.format(c='error')} as a, {_RANK.format(c='y')} as b from rand),
kp as (select sign(a.error - b.error) as sx, sign(a.y - b.y) as sy from rand a join rand b on a.doc_id < b.doc_id),
ar as ({_AREA.format(n='random', t='rand')} union all {_AREA.format(n='all_enriched', t='rated')}),
li as (select * from ({_LINE.format(g='', p='', t='rated')}) order by threshold limit 1),
k as (select *, (row_number() over (partition by bad order by {_HASH.format(k='doc_id')}, doc_id) - 1) % 5 as f from rated), tr as (select g.f as fold, k.score, k.bad from k join (select distinct f from k) g on g.f <> k.f),
l as (select fold, min(threshold) as t from ({_LINE.format(g='fold,', p='partition by fold', t='tr')}) group by 1),
cv as (select count(*) filter (bad = 1 and score <= t) / sum(bad) as r, count(*) filter (bad = 1 and score <= t) / greatest(count(*) filter (score <= t), 1) as p from k join l on l.fold = k.f group by k.f),
sums as (select 'spearman_random' as statistic, corr(a, b) as value from rk union all select 'n_random', count(*) from rk
union all select 'kendall_random', sum(sx * sy) / sqrt(count(*) filter (sx <> 0) * cast(count(*) filter (sy <> 0) as double)) from kp
union all select 'auroc_' || s, v from ar union all select 'auroc_n_' || s, n from ar union all select 'auroc_n_bad_' || s, b from ar
union all select 'cometkiwi_min_threshold', threshold from li union all select 'recall_in_sample', recall from li union all select 'precision_in_sample', precision from li union all select 'flag_share_in_sample', flag_share from li
union all select 'recall_cv', avg(r) from cv union all select 'precision_cv', avg(p) from cv)
select statistic, round(value, 5) as value from sums""")
def q_report(spark, sf_dir):
    r = rated(spark, sf_dir).withColumnsRenamed({"score": "cometkiwi_min", "error": "cometkiwi_mean"})
    return quality.report(r, key="doc_id").select("statistic", F.round("value", 5).alias("value"))


@query("""with m as (select *, case when event_type = 'error' or event_id % 2 = 0 then 1 else 0 end as f from events), k as (select *, row_number() over w - sum(f) over w as k from m window w as (partition by user_id order by ts, event_id))
select user_id, arg_min(event_id, (ts, event_id)) as start, count(*) as n_failed from k where f = 1 group by user_id, k having count(*) >= 3""")
def q_failure_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return stats.failure_runs(e, ["user_id"], ["ts", "event_id"], (F.col("event_type") == "error") | (F.col("event_id") % 2 == 0))


@query("select event_type, count(*) as n, round(sum(value) / 60 / count(*) * 12000 / 60, 4) as hours from events group by 1")
def q_throughput_projection(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    return e.select("event_type", "n", F.round(F.col("s") / 60 / F.col("n") * 12000 / 60, 4).alias("hours"))


@query("select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by 1")
def q_latest_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return stats.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")
