"""The queries of this subpackage, each over the whole of its table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, chat, decontam, fim, fingerprint, langid, minhash, packing, sharding, tokencount, trie, urllist, warc
from .common import new_path, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "tier", "step_group")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), told.alias("text"))
    return chat.read_conversations(chat.format_conversations(rows.unionByName(extra)))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path, least_revisit=0)
    return warc.archived_pages(warc.read_archive(spark, path, payloads=False))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs.select("doc_id", "text"), langid.fit(docs), keep=["doc_id"])
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts of pages and the domains above them, by a rule: three
    of each host, whose day and action come from its MD5."""
    hosts = pages.select(urllist.host(F.col("url")).alias("host")).where("host is not null").distinct()
    each = hosts.select("host", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
    each = each.withColumn("x", F.conv(F.substring(F.md5(F.concat("host", F.lit("/"), F.col("k").cast("string")).cast("binary")), 1, 7), 16, 10).cast("long"))
    above = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    day = F.expr("cast('2024-01-01' as timestamp_ntz) + make_dt_interval(cast(x % 365 as int))")
    action = F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("clear")), (F.floor(F.col("x") / 365) % 3 + 1).cast("int"))
    domain = F.when((F.col("k") == 2) & (above != ""), above).otherwise(F.col("host"))
    return each.select(domain.alias("domain"), day.alias("effective_at"), action.alias("action"))


def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.expr("cast('2024-01-01' as timestamp_ntz) + make_dt_interval(cast(pmod(page_id * 7919, 365) as int), 0, 0, pmod(page_id * 104729, 86400))"))
    return urllist.filter_urls(captures, list_entries(pages))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fim.restore(outputs.withColumn("output_sha256", F.sha2(F.col("output").cast("binary"), 256)), keep=["doc_id", "n", "prefix_chars", "middle_chars", "form", "output_sha256"])
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = bestfit.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "certified")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_pack, op2_chat, op3_near_duplicates, op4_fingerprints, op5_token_counts, op6_warc, op7_shards, op8_language, op9_decontaminate, op10_url_lists, op11_fill_in_middle, op12_prefix_trie, op13_best_fit)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_CHAT = r"""
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
    union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
    select *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|SYS\]|ROLE))', '\1\2\\\3', 'g'))
        + case role when 'system' then 13 when 'user' then 15 when 'assistant' then 5 else 16 + length(to_json(role)) end as n
    from turns
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    cast(3 + sum(n) as bigint) as formatted_chars
from sized group by conv_id
"""

_WARC = r"""
with p as (
    select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as sha, octet_length(encode(coalesce(html, ''))) as n from pages
), f as (
    select *, min(page_id) over (partition by sha, n) as first_id from p
)
select page_id, cast(n as bigint) as payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        cast((('0x' || substr(sha, cast(i // 4 * 5 + 1 as int), 5))::bigint >> cast(15 - 5 * (i % 4) as int)) & 31 as int) + 1, 1)), '') as payload_digest,
    case when page_id = first_id then 'response' else 'revisit' end as record_type,
    case when page_id = first_id then null else first_id end as refers_to
from f
"""

_NEAR = rf"""
with recursive d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') as w from documents
), s as (
    select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)
), n as (
    select doc_id, count(*) as n from s group by doc_id
), pairs as (
    select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all
), links as (
    select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y where 100 * common >= 85 * (p.n + q.n - common)
), reach(a, b) as (
    select doc_id, doc_id from d union select r.a, l.t from reach r join (select x as f, y as t from links union all select y, x from links) l on l.f = r.b
), c as (
    select a as doc_id, min(b) as component_id from reach group by a
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from d left join n using (doc_id) join c using (doc_id)
"""

_SHARDS = """
with recursive polynomial(i, c, k) as (
    select range, range, 0 from range(256) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from polynomial where k < 8
), steps as (
    select list(c order by i) as step from polynomial where k = 8
), jumps(shards, doc_id, key, place) as (
    select shards, doc_id, ((coalesce(doc_id, 0)::hugeint + 18446744073709551616) % 18446744073709551616)::uhugeint, 0::bigint from (select distinct doc_id from documents), (select unnest([40, 41]) as shards)
    union all
    select shards, doc_id, key, goes from (
        select shards, doc_id, key, floor((place + 1) * (2147483648.0::double / ((key >> 33)::double + 1)))::bigint as goes
        from (select shards, doc_id, place, (key * 2862933555777941757::uhugeint + 1::uhugeint) % 18446744073709551616::uhugeint as key from jumps)) where goes < shards
), landed as (
    select doc_id, cast(max(place) filter (shards = 40) as int) as shard, cast(max(place) filter (shards = 41) as int) as grown_shard from jumps group by doc_id
), sized as (
    select doc_id, octet_length(encode(coalesce(text, ''))) + 16 as size, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda b: ('0x' || b)::bigint)),
        lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32 from documents, steps
)
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'key' as law, shard,
    row_number() over (partition by shard order by ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 7))::bigint % 256, doc_id nulls first, size, text_crc32) - 1 as slot, grown_shard
from sized join landed using (doc_id)
"""

_DECONTAM = rf"""
with d as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
    select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bw as (
    select distinct item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as g
    from (select item, w, least(len(w), 10) as k, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)
), dw as (
    select doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') as g
    from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from bw) where len(w) >= k)
), hits as (
    select doc_id, k, i, item from dw join bw using (k, g)
), covered as (
    select doc_id, count(distinct p) as n_hit from (select distinct doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id
), named as (
    select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct doc_id, item from hits) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit > 0, false) as contaminated
from d left join covered using (doc_id) left join named using (doc_id)
"""

_URLS = r"""
with p as (
    select page_id, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') as host,
        timestamp '2024-01-01' + to_days(cast((page_id * 7919) % 365 as int)) + to_seconds((page_id * 104729) % 86400) as fetched_at
    from pages
), e as (
    select host, k, ('0x' || substr(md5(host || '/' || k), 1, 7))::bigint as x
    from (select distinct host from p where host is not null), (select unnest(range(0, 3)) as k)
), entries as (
    select case when k = 2 and regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> '' then regexp_extract(host, '([^.]+\.[^.]+)$', 1) else host end as domain,
        timestamp '2024-01-01' + to_days(cast(x % 365 as int)) as since, ['clear', 'allow', 'block'][3 - cast(x // 365 % 3 as int)] as action,
        3 - x // 365 % 3 as strength
    from e
), one as (
    select domain, since, max_by(action, strength) as action from entries group by domain, since
), valid as (
    select domain, action, since as valid_from, lead(since) over (partition by domain order by since) as valid_to from one
), matched as (
    select p.page_id, v.action, v.domain, v.valid_from, v.valid_to,
        row_number() over (partition by p.page_id order by length(v.domain) desc) as r
    from p join valid v on (p.host = v.domain or contains(v.domain, '.') and ends_with(p.host, '.' || v.domain))
        and p.fetched_at >= v.valid_from and (v.valid_to is null or p.fetched_at < v.valid_to) and v.action <> 'clear'
)
select p.page_id, p.host, p.fetched_at, coalesce(m.action, 'none') as verdict, m.domain as matched, m.valid_from, m.valid_to
from p left join matched m on p.page_id = m.page_id and m.r = 1
"""


_FIM = r"""
with d as (
    select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as x from documents
), h as (
    select doc_id, t, w, len(w) as n, ('0x' || substr(x, 1, 8))::bigint as h1, ('0x' || substr(x, 9, 8))::bigint as h2, ('0x' || substr(x, 17, 8))::bigint as h3, ('0x' || substr(x, 25, 8))::bigint as h4 from d
), c as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form
    from h
), p as (
    select *, array_to_string(list_slice(w, 1, a), '') as prefix, array_to_string(list_slice(w, a + 1, b), '') as middle, array_to_string(list_slice(w, b + 1, n), '') as suffix from c
)
select doc_id, cast(n as bigint) as n, form, cast(case when form <> 'plain' then length(prefix) end as bigint) as prefix_chars, cast(case when form <> 'plain' then length(middle) end as bigint) as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(t) as restored_sha256
from p
"""

_TRIE = """
with recursive polynomial(i, c, k) as (
    select range, range, 0 from range(256) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from polynomial where k < 8
), steps as (
    select list(c order by i) as step from polynomial where k = 8
), texts as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), hashed as (
    select conv_id, turn, role, length(text) as n, sha256(length(role) || ':' || role || text) as sha from texts
), t as (
    select conv_id, sha, n, row_number() over (partition by conv_id order by turn nulls first, role, sha) as k from hashed
), convs as (
    select conv_id, conv_id - conv_id % 100 as base, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(cast(conv_id as varchar)), '..'), lambda b: ('0x' || b)::bigint)),
        lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 6 as h from (select distinct conv_id from t), steps
), parts as (
    select c.conv_id, 0 as own, k, sha, n from convs c join t on t.conv_id = c.base where k <= h
    union all select c.conv_id, 1, k, sha, n from convs c join t using (conv_id) where k > h
), placed as (
    select *, row_number() over (partition by conv_id order by own, k) as d from parts
), paths as (
    select conv_id, 0 as d, '' as p, 0 as n from convs
    union all select conv_id, d, sha256(string_agg(sha, '') over (partition by conv_id order by d rows between unbounded preceding and current row)), n from placed
), lengths as (
    select conv_id, max(d) as total from paths group by conv_id
), nodes as (
    select p, d, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(n) as saved,
        sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (total = d), '')) as ends_sha256
    from paths join lengths using (conv_id) group by p, d
), parents as (
    select x.*, q.p as parent from nodes x left join paths q on q.conv_id = x.conv_id and q.d = x.d - 1
), children as (
    select parent as p, count(*) as n_children from parents where parent is not null group by parent
), own as (
    select x.*, coalesce(n_children, 0) as n_children from parents x left join children using (p)
), below as (
    select q.p, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum(saved) as saved_tokens from own x join paths q on q.conv_id = x.conv_id and q.d <= x.d group by q.p
)
select x.conv_id, cast(x.d as bigint) as depth, u.conv_id as parent_conv_id, cast(x.n_convs as bigint) as n_convs, cast(x.n_children as bigint) as n_children,
    cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, x.ends_sha256
from own x join below using (p) left join nodes u on u.p = x.parent
"""


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB where it can express the operator; the others are tested against brute force."""
    return {"op2_chat": _CHAT, "op3_near_duplicates": _NEAR, "op7_shards": _SHARDS, "op6_warc": _WARC, "op9_decontaminate": _DECONTAM, "op10_url_lists": _URLS, "op11_fill_in_middle": _FIM, "op12_prefix_trie": _TRIE}
