"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cyclewright.llm import chat, decontaminate, exact_dedup, licenses, mixing, packing, pages, passages, periods, prefixes
from cyclewright.llm import quality, secrets, simhash
from cyclewright.llm.common import table
from cyclewright.llm.queries import query

MIX_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), s as (select source, sum(size)::bigint as source_size from d group by source
), r as (
  select *, (row_number() over (order by source is null, source) - 1) % 3 + 1 as weight, 3 * source_size as most from s
), f as (
  select *, (sum(source_size) over () - coalesce(sum(most) over (order by most::double / weight, source is null, source
      rows between unbounded preceding and 1 preceding), 0))::bigint as left_words,
    (sum(weight) over (order by most::double / weight, source is null, source
      rows between current row and unbounded following))::bigint as left_weight,
    row_number() over (order by most::double / weight, source is null, source) as place
  from r
), level as (
  select left_words, left_weight, place from f
  where left_words::hugeint * weight <= most::hugeint * left_weight order by place limit 1
), t as (
  select f.source, f.source_size, case when f.place < level.place then f.most::double
    else level.left_words::double * f.weight::double / level.left_weight::double end as target
  from f, level
), w as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from t
), x as (select *, round(target - whole * source_size)::bigint as rest from w
), p as (
  select d.doc_id, d.size, x.source_size, x.target, x.whole, x.rest,
    sum(d.size) over (partition by d.source
      order by md5(concat_ws(':', '20', d.doc_id::varchar, d.size::varchar)), d.doc_id rows unbounded preceding) - d.size as before
  from d join x on d.source is not distinct from x.source
)
select doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, rest - before)))::bigint as taken
from p
"""


@query(MIX_SQL)
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


@query(None)
def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate group of every document."""
    return simhash.near_groups(table(spark, sf_dir, "documents"))


EXACT_SQL = r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
  row_number() over (partition by text_sha256 order by doc_id) = 1 as kept, text_sha256
from d window same as (partition by text_sha256)
"""


@query(EXACT_SQL)
def op9_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


CHAT_SQL = r"""
with t as (
  select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null and turn is not null
), p as (
  select conv_id, row_number() over w as place, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as line,
    count(*) over (partition by conv_id) as n_turns
  from t window w as (partition by conv_id order by turn, role, text)
), c as (
  select conv_id, place, n_turns, string_agg(line, '') over (partition by conv_id order by place) as text from p
), whole as (
  select min(conv_id) as conv_id, n_turns, count(*) as copies, text from c where place = n_turns group by n_turns, text
)
select conv_id, n_turns, copies, text from whole
where not exists (select 1 from c where c.place < c.n_turns and c.place = whole.n_turns and c.text = whole.text)
"""


@query(CHAT_SQL)
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered conversations without snapshots of longer ones."""
    return chat.formatted(table(spark, sf_dir, "conversations"))


@query(None)
def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that leak into documents."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(None)
def op10_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight, key and fate of every document."""
    return quality.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _license_sql() -> str:
    def start(phrase: str) -> str:
        same = " and ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split(), 1))
        return f"select r, doc_id, i, '{licenses.PHRASES[phrase]}' as label from pos where {same}"

    templates = ", ".join(
        f"('{label}', {licenses.template_words(text)}, {licenses.least_overlap(len(licenses.template_words(text)))})"
        for label, text in licenses.TEMPLATES
    )
    word = licenses.WORD
    return rf"""
with d as (
  select row_number() over () as r, doc_id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), w as (select r, doc_id, t, regexp_extract_all(t, '{word}') as w from d
), pos as (select r, doc_id, w, unnest(range(len(w))) as i from w
), base as ({" union all ".join(start(p) for p in licenses.PHRASES)}
), b as (
  select r, count(*) as n_base, min(i) as first_word, max(i) as last_word, list(distinct label) as labels from base group by r
), blocks as (
  select r, unnest(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\n[\x20\x09\x0B-\x0D]*\n'))) as block from d
), block_words as (select r, regexp_extract_all(block, '{word}') as w from blocks
), own as (
  select r, w[start + 1 : start + {licenses.WINDOW}] as w from (
    select r, w, unnest(range(0, greatest(len(w) - {licenses.STEP}, 1), {licenses.STEP})) as start from block_words where len(w) > {licenses.WINDOW}
  )
  union all select r, w from block_words where len(w) <= {licenses.WINDOW}
), tpl(label, own, least) as (values {templates}
), m as (
  select r, list(distinct label) as labels, max(len(list_intersect(tpl.own, own.w)) / len(tpl.own)) as containment
  from own, tpl
  where len(own.w) >= tpl.least
    and len(list_intersect(tpl.own, own.w)) >= tpl.least
  group by r
)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(b.n_base, 0)::bigint as n_base, b.first_word, b.last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') as labels,
  case when b.n_base > 0 then 1.0 else coalesce(m.containment, 0.0) end::double as score
from w left join b using (r) left join m using (r)
"""


@query(_license_sql())
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scanned(table(spark, sf_dir, "documents"))


@query(None)
def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pages.extracted(table(spark, sf_dir, "pages"))


@query(None)
def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query(None)
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret candidates of every document with the forest's verdict."""
    return secrets.scanned(table(spark, sf_dir, "documents"))


TRIE_SQL = r"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, digest) as place, digest, n_bytes
  from (
    select conv_id, turn, strlen(coalesce(text, '')) as n_bytes,
      md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as digest
    from conversations where conv_id is not null
  )
), ids as (
  select conv_id, conv_id - conv_id % 5 as base, xor(list_reduce(
      list_concat([4294967295], list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))
    ), 4294967295) % 9 as h
  from (select distinct conv_id from t)
), taken as (
  select ids.conv_id, t.place, t.digest, t.n_bytes from ids join t on t.conv_id = ids.base and t.place <= ids.h
), n_taken as (select conv_id, count(*) as n from taken group by conv_id
), r as (
  select * from taken
  union all
  select t.conv_id, t.place - ids.h + coalesce(n_taken.n, 0), t.digest, t.n_bytes
  from t join ids using (conv_id) left join n_taken using (conv_id) where t.place > ids.h
), pre as (
  select conv_id, place as depth, string_agg(digest, '') over (partition by conv_id order by place) as key, n_bytes from r
  union all
  select conv_id, 0, '', 0 from ids
), n as (
  select key, depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * max(n_bytes) as saved,
    case when depth > 0 then left(key, 32 * (depth - 1)) end as above
  from pre group by key, depth
), c as (select above, count(*) as n_children from n where above is not null group by above
), s as (
  select pre.key, sum(n.saved) as saved_tokens, count(*) filter (where c.above is null) as n_leaves
  from n left join c on c.above = n.key join pre on pre.conv_id = n.conv_id and pre.depth <= n.depth
  group by pre.key
), e as (
  select key, string_agg(conv_id::varchar, ',' order by conv_id) as ends
  from (select conv_id, arg_max(key, depth) as key from pre group by conv_id) group by key
)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children,
  s.n_leaves, s.saved_tokens::bigint as saved_tokens, sha256(coalesce(e.ends, '')) as ends_sha256
from n join s using (key) left join n p on p.key = n.above left join c on c.above = n.key left join e on e.key = n.key
"""


@query(TRIE_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations."""
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


@query(None)
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(None)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, and its text without their repeats."""
    return periods.periodic_runs(table(spark, sf_dir, "documents"))
