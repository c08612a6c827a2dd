"""The registered training-data queries: thin calls of the operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.bpe import encode_and_decode
from parlance.llm.chat import format_chats
from parlance.llm.common import sha256_text, table
from parlance.llm.decontam import contamination
from parlance.llm.langid import identify
from parlance.llm.lines import drop_repeated_lines
from parlance.llm.minhash import fingerprint_documents
from parlance.llm.repair import repair_report
from parlance.llm.sharding import shuffle_to_shards
from parlance.llm.simhash import near_duplicates
from parlance.llm.sitetree import extract
from parlance.llm.toxicity import score_documents
from parlance.llm.urls import judge
from parlance.llm.whitening import whiten

ORACLE_SQL: dict[str, str] = {}


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt uniformly into 24 shards of sizes at most one apart."""
    return shuffle_to_shards(table(spark, sf_dir, "documents"), 24)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations that are no snapshots of longer ones, rendered."""
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE_SQL["op2_chat"] = r"""
with t as (select distinct conv_id, turn, role, text from conversations),
o as (select *, md5(case when role is null then 'true' else 'false' end || ':' || coalesce(role, '') || case when text is null then 'true' else 'false' end || ':' || coalesce(text, '')) as tie from t),
c as (select conv_id, list((role, text) order by turn nulls first, tie) as l from o group by conv_id),
u as (select l, min(conv_id) as conv_id, count(*) as n_copies from c group by l),
k as (select conv_id, n_copies, l from u where not exists (select 1 from c where len(c.l) > len(u.l) and c.l[1] = u.l[1] and c.l[1 : len(u.l)] = u.l))
select conv_id, cast(len(l) as bigint) as n_turns, n_copies, array_to_string(list_transform(l, lambda x: '<|im_start|>' || coalesce(x[1], '') || chr(10) || coalesce(x[2], '') || '<|im_end|>' || chr(10)), '') as text from k"""


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by rules and by its host's reputation."""
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


ORACLE_SQL["op3_urls"] = r"""
with p as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
lab as (select doc_id, max(cast(quality = 0 or toxic = 1 as int)) as bad from labels where doc_id is not null group by doc_id),
o as (select host, bad from p left join lab on lab.doc_id = try_cast(nullif(regexp_extract(path, '^/[^/]*/([0-9]{1,18})', 1), '') as bigint)),
b as (select host, bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as bare from o),
g as (select host, bad, bare, string_split(bare, '.') as l, regexp_matches(bare, '^[0-9]+(\.[0-9]+){3}$|^\[') as address,
  regexp_matches(bare, '(^|\.)(ac|co|com|edu|gov|mil|net|org)\.[a-z]{2}$') or array_to_string(string_split(bare, '.')[-2:], '.') in ('github.io', 'blogspot.com') as two from b),
h as (select host, count(bad) as n, coalesce(sum(bad), 0) as bad, case when address then bare when two then array_to_string(l[-3:], '.') else array_to_string(l[-2:], '.') end as domain,
  case when address then 'ip' when two then array_to_string(l[-2:], '.') else l[-1] end as suffix from g group by host, bare, l, address, two),
d as (select domain, suffix, sum(n) as n, sum(bad) as bad from h group by all),
s as (select suffix, sum(n) as n, sum(bad) as bad from d group by suffix),
e as (select sum(n) as pn, sum(bad) as pbad from s),
lv as (select 's' as lv, n, bad, pn, pbad from s, e union all select 'd', d.n, d.bad, s.n, s.bad from d join s using (suffix) union all select 'h', h.n, h.bad, d.n, d.bad from h join d using (domain)),
m as (select lv, sum(n * pow(bad / n - pbad / pn, 2)) - sum(pbad / pn * (1 - pbad / pn) * (1 - n / pn)) as excess, sum(n - n * n / pn) as room, avg(pbad / pn * (1 - pbad / pn)) as var from lv where n > 0 group by lv),
k as (select lv, greatest(1, least(1000, case when room > 0 and excess / room > 0 then var / (excess / room) - 1 else 1000 end)) as k from m),
ks as (select coalesce(max(k) filter (lv = 's'), 1000) as s, coalesce(max(k) filter (lv = 'd'), 1000) as d, coalesce(max(k) filter (lv = 'h'), 1000) as h from k),
ms as (select suffix, (bad + ks.s * case when pn > 0 then pbad / pn else 0.5 end) / (n + ks.s) as m from s, e, ks),
md as (select domain, (bad + ks.d * m) / (n + ks.d) as m from d join ms using (suffix), ks),
ab as (select host, bad + ks.h * m as a, n - bad + ks.h * (1 - m) as b from h join md using (domain), ks),
bo as (select host, a / (a + b) as mean, a / (a + b) - 1.645 * sqrt(a * b / (a + b) / (a + b) / (a + b + 1)) as bound from ab),
li as (select r + 1.645 * sqrt(r * (1 - r) / (ks.h + 1)) as lim from (select case when pn > 0 then pbad / pn else 0.5 end as r from e), ks),
r as (select * from (values ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')) as v(rule, rh, rp, says)),
q as (select host, path, arg_max(rule, len(rule)) as rule, arg_max(says, len(rule)) as says from (select distinct host, path from p) join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by host, path)
select page_id, p.host, p.path, rule, coalesce(says, case when bound > lim then 'block' else 'allow' end) as verdict, cast(h.n as bigint) as n, cast(h.bad as bigint) as bad,
  round(mean, 6) as mean, round(bound, 6) as bound, round(lim, 6) as "limit"
from p join bo using (host) join h using (host), li left join q on q.host = p.host and q.path = p.path"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages of 10 words or more, and benchmark texts near by, in every document."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10, 20)


ORACLE_SQL["op4_decontamination"] = r"""
with letters as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as u, 'abcdefghijklmnopqrstuvwxyz' as l),
docs as (select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents, letters),
items as (select row_number() over () as ino, * from (select distinct item_id, regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark, letters)),
sized as (select item_id, w, least(10, len(w)) as n from items where len(w) > 0),
wins as (select distinct item_id, n, array_to_string(w[s + 1 : s + n], ' ') as k from (select item_id, w, n, unnest(range(0, len(w) - n + 1)) as s from sized)),
spans as (select rid, w, n, unnest(range(0, len(w) - n + 1)) as s from docs, (select distinct n from wins) where len(w) >= n),
hits as (select distinct rid, item_id, n, s from (select rid, n, s, array_to_string(w[s + 1 : s + n], ' ') as k from spans) join wins using (n, k)),
places as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(s, s + n)) as p from hits) group by rid),
who as (select rid, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct rid, cast(item_id as varchar) as i from hits) group by rid),
terms as (select distinct ino, unnest(w) as t from items),
few as (select ino, count(*) as n from terms group by ino having count(*) > 1),
postings as (select rid, unnest(w) as t, generate_subscripts(w, 1) as pos from docs),
held as (select rid, ino from (select distinct rid, t from postings) join terms using (t) join few using (ino) group by rid, ino, n having count(*) = n),
spread as (select rid, ino, n, count(distinct t) over (partition by rid, ino order by pos range between current row and n + 18 following) as k from held join terms using (ino) join postings using (rid, t) join few using (ino)),
near as (select rid, count(distinct ino) as n_near from spread where k = n group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated, coalesce(n_near, 0) as n_near
from docs left join places using (rid) left join who using (rid) left join near using (rid)"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with a byte-level vocabulary of 50,257 tokens."""
    import public_tokenizers

    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from at most 400 documents of each."""
    return identify(table(spark, sf_dir, "documents"), 400)


def op7_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and of its edited text, and their likeness."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from at most 3000 labelled documents of each class."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 3000)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"), 3).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without long lines that five documents or more share."""
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"), 40, 5)
    return kept.select("doc_id", "n_lines", "n_dropped", sha256_text(F.col("text")).alias("kept_sha256"))


ORACLE_SQL["op11_lines"] = r"""
with d as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select rid, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, max(doc_id) as holder from k where len(key) >= 40 group by key having count(distinct doc_id) + max(cast(doc_id is null as int)) >= 5),
g as (select rid, doc_id, line, pos, f.key is not null and k.doc_id is distinct from f.holder as gone from k left join f on f.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from g group by rid, doc_id"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding along the first 16 principal components, at unit variance."""
    return whiten(table(spark, sf_dir, "embeddings"), "embedding", 16)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after planted damage."""
    return repair_report(table(spark, sf_dir, "conversations"))


def _plus(state: str, cost: str, edit: str) -> str:
    """SQL for a path of op13, nine digits of cost and then the audit, with one more edit."""
    return f"lpad(cast(cast({state}[1:9] as bigint) + {cost} as varchar), 9, '0') || {state}[10:] || {edit}"


_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_READ = {c: {x: _plus(x, f"late + case when i = '{c}' then 0 else 2 end", f"case when i = '{c}' then 'K' else 'R' end") for x in "bsua"} for c in "ua"}
_DROP, _MORE = {x: _plus(x, "3", "'D'") for x in "bsua"}, {x: _plus(x, "2", "'I'") for x in "bsua"}

#: a fold over rows: the best path to each state (b: begin, s, u, a)
ORACLE_SQL["op13_repair"] = f"""
with recursive src as (select *, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations),
lots as (select *, xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(name, ''), lambda x: cast(ascii(x) as bigint))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [cast(x as bigint) for x in range(8)]), lambda z, o: xor(z >> 1, (z & 1) * 3988292384)))) % 20 as lot from src),
dam as (select conv_id, turn, case when lot = 4 then 'user' else coalesce(role, ' ') end as role,
  case when lot = 1 then '' when lot = 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text, unnest(range(case lot when 0 then 0 when 3 then 2 else 1 end)) as copy from lots),
num as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as pos, rtrim(text, {_BLANKS}) as r from dam),
near as (select *, min(pos) over (partition by conv_id, role, text) as seen, left(role, 1) as i, lag(left(role, 1)) over (partition by conv_id order by pos) || left(role, 1) as pair from num),
flt as (select *, case when r = '' then 1 when pos > seen then 2 when right(r, 1) not in ('.', '!', '?') then 3 else 0 end as fault from near),
sums as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
  count(*) filter (fault = 3) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from flt group by conv_id),
walk as (select conv_id, cast(0 as bigint) as pos, '000000000' as b, cast(null as varchar) as s, '000000002I' as u, '000000004II' as a from sums
  union all select conv_id, pos, b, s, u, least(a, {_MORE["u"]}) as a from (select conv_id, pos, b, s, least(u, {_MORE["b"]}, {_MORE["s"]}, {_MORE["a"]}) as u, a from (
    select conv_id, pos, {_DROP["b"]} as b, least({_DROP["s"]}, case when kept and i = 's' then {_plus("b", "late", "'K'")} end) as s,
      least({_DROP["u"]}, case when kept then least({_READ["u"]["b"]}, {_READ["u"]["s"]}, {_READ["u"]["a"]}) end) as u, least({_DROP["a"]}, case when kept then {_READ["a"]["u"]} end) as a
    from (select w.conv_id, f.pos, f.i, f.fault not in (1, 2) as kept, cast(f.fault = 3 as int) as late, b, s, u, a from walk w join flt f on f.conv_id is not distinct from w.conv_id and f.pos = w.pos + 1)))),
best as (select w.conv_id, least(b, a) as p from walk w join sums on sums.conv_id is not distinct from w.conv_id and w.pos = sums.n),
marks as (select conv_id, unnest(string_split(p[10:], '')) as e, generate_subscripts(string_split(p[10:], ''), 1) as k from best),
spots as (select conv_id, e, sum(cast(e <> 'I' as int)) over (partition by conv_id order by k) as pos, sum(cast(e <> 'D' as int)) over (partition by conv_id order by k) as place,
  sum(cast(e <> 'D' as int)) over (partition by conv_id) % 2 as odd from marks where e <> ''),
done as (select m.conv_id, string_agg(case when e = 'K' then f.role when odd = 1 and place = 1 then 'system' when (place - odd) % 2 = 1 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else f.text end,
  chr(10) order by place) as t from spots m left join flt f on f.conv_id is not distinct from m.conv_id and f.pos = m.pos where e <> 'D' group by m.conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cast(p[1:9] as bigint), 0) as cost, coalesce(p[10:], '') as audit, sha256(coalesce(t, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join sums on sums.conv_id is not distinct from c.conv_id left join best on best.conv_id is not distinct from c.conv_id left join done on done.conv_id is not distinct from c.conv_id"""


QUERIES: dict[str, Callable] = {f.__name__: f for f in (op1_sharding, op2_chat, op3_urls, op4_decontamination, op5_bpe, op6_language, op7_extraction, op8_minhash, op9_toxicity, op10_simhash, op11_lines, op12_whitening, op13_repair)}
