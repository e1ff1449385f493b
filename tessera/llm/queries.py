"""The queries op1 to op10 over whole tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, line_dedup, ngram_join, packing, quality_classifier, quality_rules, substring_dedup, token_counts, url_rules, vector_search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, size=1024, end_id=0)


#: Rules for hosts and paths, in the form verdict, host/path.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"), URL_RULES, _table(spark, sf_dir, "labels"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=20, digest=True)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.counted(_table(spark, sf_dir, "documents"), min_chars=20, min_docs=3).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return vector_search.nearest(table, table.where("vec_id % 20 = 0"), k=20)


QUERIES = {f.__name__: f for f in (op1_hilbert_packing, op2_url_rules, op3_byte_bpe, op4_ngram_join, op5_quality_rules, op6_substring_dedup, op7_quality_classifier, op8_line_dedup, op9_token_counts, op10_vector_search)}

SQL = {
    "op8_line_dedup": r"""
with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lined as (select doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as pos from docs),
keyed as (
    select doc_id, line, pos,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
    from lined
),
frequent as (select k, max(doc_id) as last_doc from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (select keyed.doc_id, line, pos, coalesce(keyed.doc_id <> last_doc, false) as dropped from keyed left join frequent using (k))
select doc_id, count(*) as n_lines, cast(sum(cast(dropped as int)) as bigint) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id
""",
    "op5_quality_rules": r"""
with docs as (
    select doc_id, coalesce(source, chr(1)) as host, coalesce(text, '') as text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
        string_split(coalesce(text, ''), chr(10)) as lines
    from documents
),
windows as (
    select doc_id, pos, array_to_string(words[pos : pos + 7], ' ') as w
    from (select doc_id, words, unnest(range(1, len(words) - 6)) as pos from docs)
),
twice as (select doc_id, pos from (select doc_id, pos, count(*) over (partition by doc_id, w) as n from windows) where n > 1),
covered as (select doc_id, count(distinct pos + k) as n_repeat_words from twice, (select unnest(range(8)) as k) group by doc_id),
lined as (select doc_id, host, unnest(lines) as line from docs),
solid as (select *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as w from lined),
dups as (select doc_id, count(*) - count(distinct line) as n_dup_lines from solid where len(w) > 0 group by doc_id),
keyed as (
    select doc_id, host, len(w) as n,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
    from solid where len(w) > 0
),
hosts as (select host, count(distinct doc_id) as host_docs from docs group by host),
frequent as (
    select host, k from keyed join hosts using (host) group by host, k, host_docs
    having count(distinct doc_id) > greatest(5, least(0.1 * host_docs, 2 * sqrt(host_docs)))
),
lost as (select doc_id, cast(sum(n) as bigint) as lost_words from keyed join frequent using (host, k) group by doc_id),
base as (
    select doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
        cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(lost_words, 0) as lost_words
    from docs left join dups using (doc_id) left join covered using (doc_id) left join lost using (doc_id)
),
failed as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words,
    not base_failed and not (lost_words > 0 and (n_words - lost_words < 20 or n_words - lost_words <= 0.5 * n_words)) as kept
from failed
""",
    "op6_substring_dedup": r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (
    select doc_id, pos, md5(array_to_string(words[pos : pos + 19], ' ')) as w
    from (select doc_id, words, unnest(range(1, len(words) - 18)) as pos from docs)
),
later as (select doc_id, pos from (select doc_id, pos, row_number() over (partition by w order by doc_id, pos) as n from windows) where n > 1),
gone as (select distinct doc_id, pos + k as pos from later, (select unnest(range(20)) as k)),
placed as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as pos from docs),
kept as (select doc_id, string_agg(word, ' ' order by pos) as kept, count(*) as n_kept from placed anti join gone using (doc_id, pos) group by doc_id)
select doc_id, cast(len(words) as bigint) as n_words, len(words) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from docs left join kept using (doc_id)
""",
    "op2_url_rules": r"""
with rest as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (
    select page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from rest
),
given as (
    select *, case
        when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/7') then 'example.com/en/7'
        when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/de/8') then 'example.net/de/8'
        when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/en/') then 'com/en/'
        when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/de/') then 'net/de/'
        when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/es/') then 'org/es/' end as rule
    from parts
),
urls as (select url, any_value(host) as host, any_value(path) as path from given where url is not null group by url),
raw as (
    select url, unnest(string_split(host, '.')) as t, 'host:' as kind from urls
    union all select url, lower(unnest(string_split_regex(path, '[/._-]'))), 'path:' from urls
    union all select url, split_part(unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')), '=', 1), 'query:' from urls
),
tokens as (select distinct url, kind || regexp_replace(t, '[0-9]+', '0', 'g') as t from raw where t <> '' and not ends_with(t, ':')),
known as (select doc_id, bool_or(coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1) as bad from labels where doc_id is not null group by doc_id),
labelled as (select row_number() over () as id, url, case when bad then 'block' else 'allow' end as label from given join known on page_id = doc_id where url is not null),
shares as (select label, count(*) / (select count(*) from labelled) as share from labelled group by label),
held as (select id, label, t from labelled join tokens using (url)),
sets as (
    select id, label, [t] as s from held
    union all select id, a.label, [a.t, b.t] from held a join held b using (id) where a.t < b.t
    union all select id, a.label, [a.t, b.t, c.t] from held a join held b using (id) join held c using (id) where a.t < b.t and b.t < c.t
),
counts as (select s, label, count(*) as n from sets group by s, label),
totals as (select s, sum(n) as total from counts group by s),
sure as (
    select s, label, (cast(n as double) / cast(total as double) - share) / (1 - share) as certainty
    from counts join totals using (s) join shares using (label) where n >= 0.02 * (select count(*) from labelled) and share < 1
),
above as (select * from sure where certainty >= 0.1),
rules as (
    select * from above r
    where not exists (select 1 from above p where p.label = r.label and len(p.s) < len(r.s) and list_has_all(r.s, p.s) and p.certainty >= r.certainty)
),
all_tokens as (select url, list(t) as ts from tokens group by url),
hits as (select url, arg_max(label, (certainty, label)) as verdict from all_tokens join rules on list_has_all(ts, s) group by url)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule,
    case when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 'block' when rule is not null then 'allow' else coalesce(verdict, 'allow') end as verdict
from given left join hits using (url)
""",
    "op4_ngram_join": r"""
with recursive docs as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
    from documents
),
placed as (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) as pos from docs where len(words) > 0),
shingles as (select distinct doc_id, array_to_string(words[pos : pos + 3], ' ') as s from placed),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as n_shared from shingles a join shingles b using (s) where a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (
    select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * n_shared >= 85 * (p.n + q.n - n_shared)
),
both_ways as (select x, y from links union all select y, x from links),
reach as (select x, y from both_ways union select reach.x, b.y from reach join both_ways b on b.x = reach.y),
least_reached as (select x as doc_id, min(y) as low from reach group by x)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(least(doc_id, low), doc_id) as component_id
from docs left join sizes using (doc_id) left join least_reached using (doc_id)
""",
}
