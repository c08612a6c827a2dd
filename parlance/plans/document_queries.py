"""Queries over documents, labels and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.functions import values as v
from parlance.operators import metadata as md
from parlance.operators import stats as st
from parlance.operators import tokens as tk
from parlance.plans import query
from parlance.plans.bindings import DOCUMENTS_SQL, documents, table
from parlance.plans.dialogue_queries import dedupe_sql

D = f"with {DOCUMENTS_SQL}"


def js(c: str) -> str:
    return f"array_to_string({c}, ' ')"


@query("a01_token_counts", f"{D} select token, count(*) as n from (select unnest(tokens) as token from d) group by token")
def token_counts(spark, sf):
    return tk.token_counts(documents(spark, sf))


TAG = "case when regexp_matches(token, '^[0-9]') then 'NUM' when ends_with(token, 'ing') then 'VBG' else 'X' end"


@query("a02_token_tag_counts", f"{D} select token, {TAG} as tag, count(*) as n from (select unnest(tokens) as token from d) group by all")
def token_tag_counts(spark, sf):
    tag = F.when(F.col("token").rlike("^[0-9]"), "NUM").when(F.col("token").endswith("ing"), "VBG").otherwise("X")
    return tk.token_tag_counts(documents(spark, sf), tag)


@query("j22_casing_variants", f"{D}, n as (select token, count(*) as n from (select unnest(tokens) as token from d) group by token) select lower(token) as folded, array_to_string(list_sort(list(token)), ' ') as variants, cast(sum(n) as bigint) as n from n group by lower(token) having count(*) > 1")
def casing_variants(spark, sf):
    return tk.casing_variants(tk.token_counts(documents(spark, sf), ordered=False)).withColumn("variants", F.array_join("variants", " "))


@query("p11_drop_outliers", f"{D} select doc_id, len(tokens) as token_count from d where len(tokens) <= 200")
def drop_outliers(spark, sf):
    return documents(spark, sf).select("doc_id", F.size("tokens").cast("long").alias("token_count")).where("token_count <= 200")


@query("p19_replace_ids", "select doc_id, replace(replace(replace(text, 'the', 'C'), 'an', 'A'), 'er', 'B') as text from documents")
def replace_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.replace_ids(F.col("text"), {"an": "A", "er": "B", "the": "C"}).alias("text"))


LAB = "l as (select lang, quality, cast(n_chars as double) as x, toxic from labels join documents using (doc_id))"


def labelled(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("x")), "doc_id")


@query("a15_rank_averages", f"with {LAB}, m as (select lang, quality, median(x) as med from l group by all) select l.lang, l.quality, count(*) as n, avg(x) as mean, case when count(*) > 1 then stddev_samp(x) end as sd, median(x) as median, 1.4826 * median(abs(x - med)) as mad from l join m on l.lang = m.lang and l.quality = m.quality group by all")
def rank_averages(spark, sf):
    return st.rank_averages(labelled(spark, sf), ["lang", "quality"], "x")


@query("a19_mixed_model", None)
def mixed_model(spark, sf):
    """The likelihood-ratio test of quality and its interaction with size, with a random intercept for each source."""
    rows = labelled(spark, sf).select("source", F.log1p("x").alias("y"), F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"), (F.col("quality") * F.col("toxic")).cast("double").alias("both"))
    small = st.random_intercept_ml(rows, "y", ["quality", "toxic"], "source")
    large = st.random_intercept_ml(rows, "y", ["quality", "toxic", "both"], "source")
    test = st.lr_test(small, large)
    out = [(name, large["coefs"][name], large["se"][name]) for name in large["coefs"]] + [("group_var", large["group_var"], None), ("residual_var", large["residual_var"], None), ("loglik", large["loglik"], None), ("chisq", test["chisq"], None), ("p", test["p"], None)]
    return spark.createDataFrame([(t, float(x), e) for t, x, e in out], "term string, value double, se double")


@query("w11_avg_rank", "select doc_id, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2 as rank from documents")
def avg_rank(spark, sf):
    return st.avg_rank(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", "rank")


@query("o03_natural_key", "select doc_id, 'src' || lpad(substr(source, 4), 20, '0') as key from documents")
def natural_key(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(tx.natural_key(F.col("source")), "").alias("key")).orderBy("key", "doc_id")


@query("u05_union_lists", "select distinct lang as word from documents union select distinct source from documents union select distinct role from conversations")
def union_lists(spark, sf):
    d, c = table(spark, sf, "documents"), table(spark, sf, "conversations")
    return tk.union_lists(d.select(F.col("lang").alias("word")), d.select(F.col("source").alias("word")), c.select(F.col("role").alias("word")))


@query("s22_word_list", "select distinct trim(regexp_replace(line, '\\|.*$', ''), ' ' || chr(9) || chr(13)) as word from (select unnest(string_split(text, chr(10))) as line from documents) where trim(regexp_replace(line, '\\|.*$', ''), ' ' || chr(9) || chr(13)) <> ''")
def word_list(spark, sf):
    from parlance.sources.text import words_in

    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return words_in(lines, "|")


@query("f04_disfluency", f"{D}, t as (select doc_id, unnest(tokens) as w from d), h as (select doc_id, case when len(w) > 9 then w[1:5] || '-' when len(w) = 2 then '-' || w else w end as t from t) select doc_id, count(*) as n, count(distinct t) as kinds from h where starts_with(t, '-') or ends_with(t, '-') group by doc_id")
def disfluency(spark, sf):
    """Long words are cut off after five letters, words of two letters have lost what was before."""
    t = documents(spark, sf).select("doc_id", F.explode("tokens").alias("w"))
    cut = F.when(F.length("w") > 9, F.concat(F.left("w", F.lit(5)), F.lit("-"))).when(F.length("w") == 2, F.concat(F.lit("-"), "w")).otherwise(F.col("w"))
    return t.select("doc_id", cut.alias("t")).where(tx.is_disfluency(F.col("t"))).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("t").alias("kinds"))


@query("f05_metalanguage", f"{D} select doc_id, len(list_filter(tokens, lambda t: upper(t) in {tx.METALANGUAGE})) as n from d")
def metalanguage(spark, sf):
    return documents(spark, sf).select("doc_id", F.size(F.filter("tokens", lambda t: tx.is_metalanguage(F.upper(t)))).cast("long").alias("n"))


@query("f06_filler", f"{D} select doc_id, len(list_filter(tokens, lambda t: lower(t) in {tx.FILLERS})) as n from d")
def filler(spark, sf):
    return documents(spark, sf).select("doc_id", F.size(F.filter("tokens", lambda t: tx.is_filler(F.lower(t)))).cast("long").alias("n"))


STOP = ("the", "of", "and", "to", "in", "der", "die", "la", "de", "que")


@query("f07_stopwords", f"{D} select doc_id, {js(f'list_filter(tokens, lambda t: t not in {STOP})')} as tokens from d")
def stopwords(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(tx.remove_stopwords(F.col("tokens"), STOP), " ").alias("tokens"))


@query("f08_tokenise", "select doc_id, len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+(?:-[\\p{L}\\p{N}]+)*|''(?:s|S|d|D|m|M|ll|LL|re|RE|ve|VE)\\b|[^\\s\\p{L}\\p{N}]')) as n from documents")
def tokenise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(tx.tokenise(F.col("text"))).cast("long").alias("n"))


@query("f09_lemmatise", f"{D}, b as (select distinct unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+')) as token from benchmark), x as (select token, rtrim(lower(token), '.,') as lemma from b where token <> ''), t as (select doc_id, unnest(tokens) as token, unnest(range(len(tokens))) as pos from d), l as (select doc_id, string_agg(coalesce(lemma, token), ' ' order by pos) as lemmas from t left join x using (token) group by doc_id) select doc_id, coalesce(lemmas, '') as lemmas from d left join l using (doc_id)")
def lemmatise(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(tx.split_words(F.col("text"))).alias("token")).distinct()
    lexicon = words.select("token", F.regexp_replace(F.lower("token"), "[.,]+$", "").alias("lemma"))
    return tk.lemmatise(documents(spark, sf), lexicon, "doc_id").select("doc_id", F.array_join("lemmas", " ").alias("lemmas"))


@query("f11_chunks", f"{D} select doc_id, array_to_string(list_transform(range(0, (len(tokens) + 2) // 3), lambda i: {js('tokens[3 * i + 1 : 3 * i + 3]')}), '|') as c from d")
def chunks(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(F.transform(tx.chunks(F.col("tokens"), 3), lambda c: F.array_join(c, " ")), "|").alias("c"))


@query("f12_dedupe_chunks", f"{D} select doc_id, {js(dedupe_sql('tokens'))} as c from d")
def dedupe_chunks(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(F.flatten(tx.dedupe_chunk_pairs(tx.chunks(F.col("tokens"), 2))), " ").alias("c"))


@query("f13_dedupe_bigrams", f"{D}, k as (select doc_id, list_transform(tokens, lambda t: lower(t)) as t from d) select doc_id, {js(dedupe_sql('t'))} as tokens from k")
def dedupe_bigrams(spark, sf):
    low = F.transform("tokens", lambda t: F.lower(t))
    return documents(spark, sf).select("doc_id", "tokens", low.alias("t")).select("doc_id", F.array_join(tx.dedupe_bigrams(F.col("t")), " ").alias("tokens"))


@query("f17_string_utilities", f"{D}, k as (select doc_id, text, tokens as t from d) select doc_id, upper(text[1]) || substr(text, 2) as uc, lower(text[1]) || substr(text, 2) as lc, len(text) - len(replace(text, 'e', '')) as n_e, case when len(t) > 1 then array_to_string(t[1:len(t) - 1], ', ') || ' and ' || t[len(t)] else array_to_string(t, ', ') end as enumerated from k")
def string_utilities(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", tx.uc_first(F.col("text")).alias("uc"), tx.lc_first(F.col("text")).alias("lc"), tx.count_char(F.col("text"), "e").cast("long").alias("n_e"), tx.enumerate_join(F.col("tokens"), ", ", " and ").alias("enumerated"))


@query("f18_file_names", "select page_id, regexp_replace(url, '[/\\n\\r\\t\\x00\\f`?*\\\\<>|\":]', '-', 'g') as name, regexp_extract(url, '(?s)(\\.[^.]*)$', 1) as ext, left(url, len(url) - len(regexp_extract(url, '(?s)(\\.[^.]*)$', 1))) as base from pages")
def file_names(spark, sf):
    base, ext = tx.split_ext(F.col("url"))
    return table(spark, sf, "pages").select("page_id", tx.sanitise_name(F.col("url")).alias("name"), ext.alias("ext"), base.alias("base"))


@query("f19_dom_id", "select doc_id, replace(replace(replace(regexp_replace(text, '[ \\t\\n\\f\\r\\v]', '-', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as id from documents")
def dom_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.dom_id(F.col("text")).alias("id"))


@query("f20_query_params", "select page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') as page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') as ref from pages")
def query_params(spark, sf):
    m = tx.query_params(F.col("url"))
    return table(spark, sf, "pages").select("page_id", m["page"].alias("page"), m["ref"].alias("ref"))


@query("f21_replace_all", "select doc_id, regexp_replace(text, '([a-z])\\1+', '\\1', 'g') as text from documents".replace("regexp_replace(text, '([a-z])\\1+', '\\1', 'g')", "regexp_replace(text, '([0-9]+)', '<\\1>', 'g')"))
def replace_all(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.replace_all(F.col("text"), "([0-9]+)", "<$1>").alias("text"))


@query("f49_index_map", f"{D} select doc_id, len(tokens) - list_position(list_reverse(tokens), 'the') as last_the from d where list_contains(tokens, 'the')")
def index_map(spark, sf):
    d = documents(spark, sf).select("doc_id", v.index_map(F.col("tokens"))["the"].cast("long").alias("last_the"))
    return d.where("last_the is not null")


@query("o04_order_by_list", "select o_orderkey, case o_orderpriority when '3-MEDIUM' then 1 when '1-URGENT' then 2 else 3 end as rank from orders")
def order_by_list(spark, sf):
    o = table(spark, sf, "orders")
    return md.order_by_list(o, "o_orderpriority", ["3-MEDIUM", "1-URGENT"], "o_orderkey").select("o_orderkey", md.list_rank(F.col("o_orderpriority"), ["3-MEDIUM", "1-URGENT"]).cast("int").alias("rank"))


@query("j19_upsert_metadata", "select coalesce(c.c_custkey, s.s_suppkey) as key, coalesce(s.s_acctbal, c.c_acctbal) as value, 2 as rank from customer c full join supplier s on s.s_suppkey = c.c_custkey".replace("2 as rank", "case when coalesce(c.c_custkey, s.s_suppkey) = 5 then 1 else 2 end as rank"))
def upsert_metadata(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    new = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value"))
    return md.upsert_metadata(old, new, ["key"], "value", [5]).withColumn("rank", F.col("rank").cast("int"))
