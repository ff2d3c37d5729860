"""The queries op1 to op13 over the tables of sf_dir, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import attribution, chat, decontaminate, embedding_dedup, langid, line_dedup, lm, ngram_join, packing, quality, substring_dedup, toxicity, whitening
from lectern.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_conversations(table(spark, sf_dir, "conversations"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_passages(table(spark, sf_dir, "documents")).drop("kept_text")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.vector_components(table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"))


def op11_click_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_toxicity, op3_line_dedup, op4_ngram_jaccard, op5_chat_formatting, op6_decontamination, op7_substring_dedup, op8_embedding_dedup, op9_language_id, op10_quality_classifier, op11_click_attribution, op12_lm_scoring, op13_embedding_whitening)}


OP5_SQL = """
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos,
         coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
p as (
  select conv_id, pos, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '|') over (partition by conv_id order by pos)) as prefix,
         count(*) over (partition by conv_id) as n_turns
  from t),
ends as (select conv_id, n_turns, prefix from p where pos = n_turns),
gone as (
  select distinct e.conv_id from ends e join p on p.prefix = e.prefix and p.pos = e.n_turns
  where p.n_turns > e.n_turns or (p.n_turns = e.n_turns and p.conv_id < e.conv_id))
select conv_id, count(*) as n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) order by pos) as rendered
from t where conv_id not in (select conv_id from gone) group by conv_id
"""

OP8_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(node, root) as (
  select a, a from l union select l.b, reach.root from reach join l on l.a = reach.node),
c as (select node, min(root) as component_id from reach group by node),
n as (select a, count(*) as n_links from l group by a)
select e.vec_id, coalesce(n.n_links, 0) as n_links, coalesce(c.component_id, e.vec_id) as component_id,
       e.vec_id = coalesce(c.component_id, e.vec_id) as kept
from embeddings e left join n on n.a = e.vec_id left join c on c.node = e.vec_id
"""

OP11_SQL = """
with tbl as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
clean as (
  select click_id, client_id, epoch_us(ts) as ts, arrived_at from clicks where click_id is not null and client_id is not null and ts is not null
  qualify row_number() over (partition by click_id order by arrived_at, ts, client_id) = 1),
sold as (select row_number() over () as ref, sale_id, client_id, epoch_us(sold_at) as sold, arrived_at from sales where client_id is not null and sold_at is not null),
ids as (select distinct click_id as id from clean union select distinct sale_id from sold),
crc as (
  select id, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(id::varchar) + 1), lambda i: ascii(substr(id::varchar, i, 1))::bigint)),
                             lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % 4 as m
  from ids, tbl where id is not null),
c as (select click_id, client_id, ts, epoch_us(arrived_at) // 3600000000 + case when m = 0 then 240 else 0 end as h from clean join crc on id = click_id),
s as (select ref, sale_id, client_id, sold, epoch_us(arrived_at) // 3600000000 + case when m = 0 then 240 else 0 end as h from sold left join crc on id = sale_id),
e as (select coalesce(min(h), 0) as lo, coalesce(max(h), 0) as hi from c),
cb as (select c.*, coalesce(floor(10 * (h - lo) / (hi - lo + 1)), 0)::int as batch from c, e),
sb as (select s.*, coalesce(greatest(0, least(9, floor(10 * (h - lo) / (hi - lo + 1)))), 0)::int as batch from s, e),
b as (select unnest(range(10))::int as batch),
w as (
  select b.batch, least((select max(ts) from cb where cb.batch < b.batch), (select max(sold) from sb where sb.batch < b.batch)) as low,
         (select max(ts) from cb where cb.batch < b.batch) is not null and (select max(sold) from sb where sb.batch < b.batch) is not null as both_known
  from b),
marks as (select batch, case when both_known then low - 172800000000 end as mark from w),
live as (select cb.* from cb join marks using (batch) where mark is null or ts >= mark),
fate as (
  select sb.*, mark is not null and sold < mark as late,
         coalesce((select min(m.batch) from marks m where m.batch > sb.batch and sold < m.mark), 10) as closing
  from sb join marks using (batch)),
found as (
  select ref, count(click_id) as n_clicks, arg_max(click_id, (ts, click_id)) as click_id
  from fate f join live l on l.client_id = f.client_id and l.ts between f.sold - 604800000000 and f.sold and l.batch <= f.closing
  where not late group by ref)
select sale_id, case when late then batch else closing end as batch, late, found.click_id, coalesce(n_clicks, 0) as n_clicks
from fate left join found using (ref)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_click_attribution": OP11_SQL, "op5_chat_formatting": OP5_SQL, "op8_embedding_dedup": OP8_SQL}
