"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattgrid.llm import (
    alignment,
    chat,
    conversation_repair,
    exact_dedup,
    html_text,
    langid,
    mixing,
    ngram_join,
    pieces,
    quality_rules,
    secret_scan,
    url_rules,
    vector_search,
)

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}

WHITE_CLASS = r"[\x20\x09-\x0D]"
WEIGHTS = (1, 2, 3)


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIX_SQL = rf"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         ('0x' || substr(md5('1|' || coalesce(cast(doc_id as varchar), '')), 1, 9))::bigint as hash
  from documents),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
named as (select *, [1.0::double, 2.0, 3.0][(row_number() over (order by source nulls last) - 1)::int % 3 + 1] as weight from totals),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over (order by source_size * 3 / weight, source nulls last
              rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by source_size * 3 / weight, source nulls last rows between current row and unbounded following) as level
  from named),
open as (select first(level order by source_size * 3 / weight, source nulls last) filter (not (3 * source_size < level * weight)) as level from levels),
targets as (
  select source, source_size, case when 3 * source_size < l.level * weight then (3 * source_size)::double else o.level * weight end as target
  from levels l, open o),
budgets as (
  select *, case when source_size > 0 then least(3, floor(target / source_size)) else 0 end::bigint as base from targets),
p0 as (
  select s.*, b.source_size, b.target, b.base, floor(b.target - b.base * b.source_size) as room,
         sum(size) over (partition by s.source order by hash) <= floor(b.target - b.base * b.source_size) as t0
  from sized s join budgets b on s.source is not distinct from b.source),
r0 as (select *, room - coalesce(sum(case when t0 then size end) over (partition by source), 0) as room1 from p0),
p1 as (
  select *, not t0 and size <= room1 and sum(case when not t0 and size <= room1 then size else 0 end) over (partition by source order by hash) <= room1 as t1 from r0),
r1 as (select *, room1 - coalesce(sum(case when t1 then size end) over (partition by source), 0) as room2 from p1),
edge as (select *, min(case when not t0 and not t1 and size <= room1 then hash end) over (partition by source) as place1 from r1),
p2 as (
  select *, not t0 and not t1 and hash >= coalesce(place1, 1::bigint << 40) and size <= room2
     and sum(case when not t0 and not t1 and hash >= coalesce(place1, 1::bigint << 40) and size <= room2 then size else 0 end) over (partition by source order by hash) <= room2 as t2 from edge)
select doc_id, size::bigint as size, source_size, target, ((base + case when base < 3 and size > 0 and (t0 or t1 or t2) then 1 else 0 end) * size)::bigint as taken
from p2"""


@query("op2_mixing", MIX_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = mixing.checkpointed(mixing.sized(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "hash"))
    return mixing.apply_plan(slim, mixing.mix_plan(slim, list(WEIGHTS))).select("doc_id", "size", "source_size", "target", "taken")


@query("op3_exact_dedup", rf"""
with d as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '{WHITE_CLASS}', '', 'g')) as h from documents),
r as (select *, first_value(doc_id) over (partition by h order by n desc, doc_id) as keep_id, count(*) over (partition by h) as group_size from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, h as text_sha256 from r""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.digests(table(spark, sf_dir, "documents")).select("doc_id", "text_sha256", "text_chars")
    return exact_dedup.mark_copies(rows).drop("text_chars")


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, _ = quality_rules.quality_rules(docs, table(spark, sf_dir, "labels"))
    return rows.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept", "rule")


def _spans_sql(rule: secret_scan.Rule, number: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    value = f"regexp_extract(p[i], '{pattern}', {rule.value_group})"
    return rf"""
  select doc_id, sum_before as start, {number} as number, '{rule.kind}' as kind, sum_before + length(p[i]) as "end" from (
    select doc_id, p, i, list_sum([0] || list_transform(p[:i - 1], lambda x: length(x)))::bigint as sum_before from (
      select doc_id, p, unnest(range(2, len(p) + 1, 2)) as i from (
        select doc_id, string_split(regexp_replace(text, '({pattern})', chr(1) || '\1' || chr(1), 'g'), chr(1)) as p from documents
        where regexp_matches(text, '{pattern}'))))
  where length({value}) >= {rule.least}"""


SECRETS_SQL = f"""
with spans as ({' union all '.join(_spans_sql(r, n) for n, r in enumerate(secret_scan.RULES))}),
named as (select *, kind || ':' || start || ':' || "end" as said from spans),
per as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(said, ',' order by start, number) filter (number < 3) as base, string_agg(said, ',' order by start, number) as spans
  from named group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents left join per using (doc_id)"""


@query("op10_secret_scan", SECRETS_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["number"] < len(secret_scan.BASE))
    of = lambda n: F.size(F.filter(spans, lambda s: s["number"] == n)).cast("long")
    return rows.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
                       F.sha2(secret_scan.described(base).cast("binary"), 256).alias("base_sha256"), secret_scan.described(spans).alias("spans"))


URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

URL_SQL = rf"""
with rules(rhost, rpath, said) as (values {', '.join(str(r) for r in URL_RULES)}),
cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_rules.UPPER}', '{url_rules.LOWER}') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
fits as (
  select page_id, first(rhost || rpath order by length(rhost || rpath) desc) as rule, first(said order by length(rhost || rpath) desc) as verdict
  from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join fits using (page_id)"""


@query("op6_url_filter", URL_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def _quoted_controls() -> str:
    return chat.ANY.replace("'", "''")


CHAT_SQL = rf"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
formed as (
  select *, length(regexp_replace(text, '({_quoted_controls()})', '\\\1', 'g')) + length(regexp_replace(role, '({_quoted_controls()})', '\\\1', 'g'))
            + {len(chat.START + chat.SEP + chat.END) + 1} as n from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256, sum(n)::bigint as formatted_chars
from formed group by conv_id"""


@query("op4_chat_format", CHAT_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, n, role, "</s>[INST] ok [/INST]") for n, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_chats(chat.turn_log(turns)))


@query("op5_html_extract")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.Vocabulary.load()
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    back = coded.withColumn("decoded", pieces.decode(F.col("ids"), vocabulary))
    return back.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", F.coalesce(langid.remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", F.col("lang_rejected").alias("rejected"))


NGRAM_SQL = r"""
with recursive words as (
  select doc_id, [w for w in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if w <> ''] as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) end as s from words),
items as (select doc_id, len(s) as n, unnest(s) as g from sets),
common as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as n, any_value(b.n) as m, count(*) as k
           from items a join items b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select x, y from common where 100 * k >= 85 * (n + m - k)),
reach as (select doc_id as x, doc_id as y from documents union select r.x, l.y from reach r join links l on r.y = l.x),
least_of as (select x, min(y) as component_id from reach group by x)
select doc_id, len(s) as n_shingles, component_id from sets join least_of on x = doc_id"""


@query("op8_ngram_join", NGRAM_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


REPAIR_SQL = r"""
with recursive crc as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint)),
      lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, k: xor(y >> 1, 3988292384::bigint * (y & 1)))), 4294967295::bigint) % 20 as kind
  from conversations),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text, unnest(case when kind = 3 then [0, 1] else [0] end) as copy
  from crc where kind <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from damaged),
faulty as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end as fault,
    left(role, 1) as c, lag(left(role, 1)) over (partition by conv_id order by i) as p
  from placed),
counts as (
  select conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (p is not null and p || c not in ('su', 'ua', 'au')) as illegal
  from faulty group by conv_id),
walk(conv_id, i, s0, s1, s2, s3) as (
  select conv_id, 0::bigint, {'c': 0::bigint, 'a': '', 't': ''}, {'c': 1000000000000::bigint, 'a': '', 't': ''}, {'c': 1000000000000::bigint, 'a': '', 't': ''}, {'c': 1000000000000::bigint, 'a': '', 't': ''}
  from (select distinct conv_id from conversations)
  union all
  select conv_id, i, d0,
    list_min([d1] || case when not gone and c = 's' then [{'c': s0.c + cut, 'a': s0.a || 'K', 't': s0.t || said}] else [] end),
    list_min([d2] || case when gone then [] else list_transform([s0, q1, q3], lambda s: {'c': s.c + cut + 1, 'a': s.a || 'R', 't': s.t || 'user:' || text || chr(10)}) end
                  || case when not gone and c = 'u' then list_transform([s0, q1, q3], lambda s: {'c': s.c + cut, 'a': s.a || 'K', 't': s.t || said}) else [] end),
    list_min([d3] || case when gone then [] else [{'c': q2.c + cut + 1, 'a': q2.a || 'R', 't': q2.t || 'assistant:' || text || chr(10)}] end
                  || case when not gone and c = 'a' then [{'c': q2.c + cut, 'a': q2.a || 'K', 't': q2.t || said}] else [] end)
  from (
    select *, {'c': s0.c + 2, 'a': s0.a || 'D', 't': s0.t} as d0, {'c': q1.c + 2, 'a': q1.a || 'D', 't': q1.t} as d1, {'c': q2.c + 2, 'a': q2.a || 'D', 't': q2.t} as d2,
      {'c': q3.c + 2, 'a': q3.a || 'D', 't': q3.t} as d3
    from (
      select *, s1 as q1, list_min([s2] || list_transform([s0, s1, s3], lambda s: {'c': s.c + 5, 'a': s.a || 'I', 't': s.t || 'user:' || chr(10)})) as q2,
        list_min([s3] || list_transform([s2], lambda s: {'c': s.c + 5, 'a': s.a || 'I', 't': s.t || 'assistant:' || chr(10)})
                      || list_transform([s0, s1], lambda s: {'c': s.c + 10, 'a': s.a || 'II', 't': s.t || 'user:' || chr(10) || 'assistant:' || chr(10)})) as q3
      from (
        select w.conv_id, w.i + 1 as i, s0, s1, s2, s3, f.text, f.c, fault in ('blank', 'duplicate') as gone, case when fault = 'truncated' then 5 else 0 end as cut,
          f.role || ':' || f.text || chr(10) as said
        from walk w join faulty f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1)))),
ended as (
  select w.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
    list_min([s0, s3, {'c': s2.c + 5, 'a': s2.a || 'I', 't': s2.t || 'assistant:' || chr(10)}, {'c': s1.c + 10, 'a': s1.a || 'II', 't': s1.t || 'user:' || chr(10) || 'assistant:' || chr(10)}]) as e
  from walk w left join counts k on k.conv_id is not distinct from w.conv_id where w.i = coalesce(k.n, 0))
select conv_id, gaps, blank, duplicate, truncated, illegal, e.c as cost, e.a as audit, sha256(left(e.t, greatest(length(e.t) - 1, 0))) as repaired_sha256 from ended"""


@query("op11_structure_repair", REPAIR_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.repair(conversation_repair.damaged(turns), turns)


@query("op12_exact_search", r"""
with v as (
  select vec_id, row_number() over () as place, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
met as (select q.place, q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id % 20 = 0 and q.place <> c.place),
best as (select *, row_number() over (partition by place order by score desc, vec_id nulls last) as rank from met)
select query_id, rank::integer as rank, vec_id, score from best where rank <= 20""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


@query("op13_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = alignment.ByteLevel(), alignment.Pieces()
    found = alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), a, b)
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return alignment.weigh_links(found.withColumn("groups_sha256", digest).drop("groups"), len(b.bytes))
