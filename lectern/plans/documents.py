"""Queries over documents, benchmark passages and vectors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import evaluation as E
from lectern.operators import generation as G
from lectern.operators import ingest as I
from lectern.operators import retrieval as R
from lectern.session import dealt
from lectern.staging import staged


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark, d) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("document_id"), "lang")


def asked(spark, d) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def gold(spark, d) -> DataFrame:
    """Items that a document holds verbatim; the items are the stated small side."""
    return holders(dealt(chunks(spark, d).select("chunk_id", "text")), asked(spark, d))


def holders(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, chunk_id): texts (chunk_id, text) that contain the text of an item (query_id, text), which isn't empty.

    A text that holds an item has each of its words between two spaces as a word of its own, so texts meet items by the longest of these and only
    then are they searched; items without such a word are looked for in all texts.
    """
    parts = F.split(F.col("text"), " ")
    inner = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    q = items.where("text <> ''").select("query_id", F.col("text").alias("passage"), F.array_max(inner)["w"].alias("anchor"))
    words = texts.select("chunk_id", "text", F.explode(F.array_distinct(parts)).alias("anchor"))
    met = words.join(F.broadcast(q.where("anchor <> ''")), "anchor").where(F.contains("text", "passage"))
    rest = texts.join(F.broadcast(q.where("coalesce(anchor, '') = ''")), F.contains("text", "passage"))
    return met.select("query_id", "chunk_id").unionByName(rest.select("query_id", "chunk_id"))


def found(spark, d, k=10) -> DataFrame:
    return R.bm25_top_k(chunks(spark, d), asked(spark, d), k)


def short(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+(?:[''\-][\p{L}\p{N}]+)*')"
POSTINGS = f"""w as (select doc_id as chunk_id, {WORDS} as w from documents),
p as (select chunk_id, len(w) as length, unnest(w) as term from w),
tf as (select chunk_id, length, term, count(*) as tf from p group by all),
st as (select count(*) as n, avg(len(w)) as avg_length from w),
df as (select term, count(*) as df from tf group by term),
q as (select distinct item_id as query_id, unnest({WORDS}) as term from benchmark),
sc as (select query_id, chunk_id, sum(case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))) as score
  from tf join df using (term) join (select * from q where length(term) >= 2) using (term), st group by all),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from sc),
gold as (select item_id as query_id, doc_id as chunk_id from documents d join benchmark b on contains(d.text, b.text) where b.text <> '')"""
DENSE = """v as (select vec_id as chunk_id, embedding::double[] as e, label from embeddings),
d as (select a.chunk_id as query_id, b.chunk_id, list_cosine_similarity(a.e, b.e) as score, b.label from v a, v b where a.chunk_id % 50 = 0),
dr as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from d)"""


def vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_queries(spark, d):
    return vectors(spark, d).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")


def dense_top(spark, d, k=10, where=None):
    v = vectors(spark, d)
    return R.dense_top_k(v if where is None else v.where(where), vector_queries(spark, d), k)


def fused(spark, d):
    """Passages by their words, and by the vectors of their ids where there are some; a branch of weight 0 isn't built."""
    v = vectors(spark, d).select("chunk_id", "embedding")
    q = asked(spark, d).join(v.withColumnRenamed("chunk_id", "query_id"), "query_id")
    dense = R.dense_top_k(v, q, 20)
    return R.fuse({"dense": (dense, 1.0), "sparse": (found(spark, d, 20), 0.6), "off": (dense, 0.0)}).select("query_id", "chunk_id", "rrf", "branches", "best_rank", "rank")


FUSED = POSTINGS + """,
v as (select vec_id as chunk_id, embedding::double[] as e from embeddings),
dn as (select a.chunk_id as query_id, b.chunk_id, list_cosine_similarity(a.e, b.e) as score from v a join benchmark on item_id = a.chunk_id, v b),
dr as (select query_id, chunk_id, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from dn),
u as (select query_id, chunk_id, rank, 1.0 / (60 + rank) as part from dr where rank <= 20 union all select query_id, chunk_id, rank, 0.6 / (60 + rank) from r where rank <= 20),
f as (select query_id, chunk_id, sum(part) as rrf, count(*) as branches, min(rank) as best_rank from u group by all)"""


def ranked_chunks(spark, d):
    """BM25 hits as leaves: the document is the source, the parent a run of five ids, the sibling the id itself."""
    c = chunks(spark, d).select("chunk_id", "document_id")
    return found(spark, d, 20).join(c, "chunk_id").withColumns({"parent_id": F.floor(F.col("chunk_id") / 5).cast("long") + 1_000_000, "sibling": F.col("chunk_id")})


RANKED = f"{POSTINGS}, h as (select r.*, source as document_id, chunk_id // 5 + 1000000 as parent_id from r join documents on doc_id = chunk_id where rank <= 20)"


def ngram_pool(spark, d):
    hits = found(spark, d, 20).select("query_id", "chunk_id")
    return staged(hits.join(chunks(spark, d).select("chunk_id", "text"), "chunk_id"), "ngram-pool")


def elements_count(spark, d):
    tree = I.chunk_tree(read(spark, d, "documents").select("doc_id", "text"))
    return tree.groupBy("document_id").agg(F.count_if(F.col("level") == "L1").alias("sections"), F.count_if(F.col("level") == "L2").alias("leaves"), F.max(F.length("text")).alias("longest"))


def cer_pairs(spark, d):
    b = asked(spark, d)
    return E.char_error_rate(b.withColumn("noisy", F.regexp_replace("text", "e", "c")), "text", "noisy").select("query_id", F.round("cer", 6).alias("cer"))


def map_reduce_answers(spark, d):
    """Answers to passages from their twenty best documents, a source at a time, then reduced."""
    texts = chunks(spark, d).select("chunk_id", "document_id", "text")
    evidence = found(spark, d, 20).join(texts, "chunk_id").select("query_id", F.col("rank").alias("ordinal"), "document_id", "text")
    return G.map_reduce_answers(evidence, asked(spark, d), 2000, 200)


def misread(spark, d):
    """Turns of conversations beside what a poor reader might have made of them: letters swapped, joined, lost and added."""
    noisy = F.translate("text", "öi", "o1")
    for found, made in (("rn", "m"), ("(?<=s)e(?=[a-m])", "c"), ("th", "h"), (r"(?<=[aou]) (?=t)", " '")):
        noisy = F.regexp_replace(noisy, found, made)
    return read(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("reference"), noisy.alias("hypothesis"))


def confusions(spark, d):
    return E.confusions(misread(spark, d), "role")


def numbered(spark, d):
    return chunks(spark, d).select("document_id", "chunk_id", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_id")).alias("ordinal"))


def page_table(spark, d):
    """Documents as pages, with measures made of their ids."""
    text, i = F.coalesce("text", F.lit("")), F.col("doc_id")
    kind = T.page_class(F.length(text), i % 10 / 10, T.mojibake_ratio(text), i % 5 / 10, F.when(i % 7 < 6, i % 7 / 10))
    rows = read(spark, d, "documents").select("doc_id", kind.alias("page_class"))
    return rows.select("doc_id", "page_class", T.cost_weight(T.is_scan(F.col("page_class")), i % 3 == 0, i % 5 == 0, i % 9).alias("cost"), T.quality_grade(i % 11 / 10).alias("grade"))


PAGE_TABLE = r"""with t as (select doc_id, coalesce(text, '') as t, doc_id % 10 / 10 as b, doc_id % 5 / 10 as c, case when doc_id % 7 < 6 then doc_id % 7 / 10 end as l from documents),
m as (select *, case when length(t) > 0 then (2 * length(t) - length(regexp_replace(t, '/glyph<[^>]{0,16}>|/g\d+', '', 'g')) - length(regexp_replace(t, '[\x{FFFD}\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}\x00-\x08\x0B\x0E-\x1F]', '', 'g'))) / length(t) else 0 end as moj from t),
k as (select *, case when length(t) < 40 then case when b >= 0.3 then 'SCANNED' else 'DIGITAL_CLEAN' end when moj > 0.02 or (c > 0.3 and l < 0.45) then 'DIGITAL_BROKEN' when b >= 0.3 then 'MIXED' else 'DIGITAL_CLEAN' end as page_class from m)
select doc_id, page_class, 1 + 3 * (page_class in ('SCANNED', 'DIGITAL_BROKEN'))::int + 2 * (doc_id % 3 = 0)::int + (doc_id % 5 = 0)::int + 0.5::double * least(doc_id % 9, 6) as cost,
  case when doc_id % 11 / 10 >= 0.9 then 'EXCELLENT' when doc_id % 11 / 10 >= 0.8 then 'GOOD' when doc_id % 11 / 10 >= 0.5 then 'FAIR' else 'POOR' end as grade from k"""
DIVERSE = f"""with {RANKED}, b as (select *, max(score) over (partition by query_id) as best, row_number() over (partition by query_id, document_id order by rank) as place from h),
e as (select *, row_number() over (partition by query_id order by (place > 2)::int, rank) <= 2 as chosen from b where score >= 0.6 * best),
s as (select *, max(chosen::int) over (partition by query_id, document_id) = 1 as seen from e),
n as (select query_id, count(distinct document_id) as eligible, count(distinct document_id) filter (chosen) as had from s group by 1),
nw as (select query_id, chunk_id, row_number() over (partition by query_id order by rank) as k from s where place = 1 and not seen),
o as (select query_id, chunk_id, row_number() over (partition by query_id order by rank desc) as k from s where chosen and place > 1),
x as (select n.query_id, least(least(2, eligible) - had, (select count(*) from nw where nw.query_id = n.query_id), (select count(*) from o where o.query_id = n.query_id)) as swaps from n),
z as (select s.* from s join x using (query_id) where (chosen and not exists (select 1 from o where o.query_id = s.query_id and o.chunk_id = s.chunk_id and o.k <= x.swaps))
  or exists (select 1 from nw where nw.query_id = s.query_id and nw.chunk_id = s.chunk_id and nw.k <= x.swaps))
select query_id, chunk_id, document_id, row_number() over (partition by query_id order by rank) as position from z"""


def headings(spark, d):
    return read(spark, d, "documents").select(F.col("source").alias("document_id"), F.col("doc_id").alias("place"), (F.col("doc_id") % 3 + 1).alias("level"), F.lit("t").alias("title"))


NESTED = """with h as (select source, doc_id as place, doc_id % 3 + 1 as level, row_number() over (partition by source order by doc_id) as i, count(*) over (partition by source) as n from documents),
e as (select a.source, a.place, a.level, a.i, a.n, coalesce(min(b.i), any_value(a.n) + 1) as ends from h a left join h b on a.source = b.source and b.i > a.i and b.level <= a.level group by all),
p as (select a.source, a.place, count(*) as depth, max(b.place) as parent_place from e a join e b on a.source = b.source and b.i < a.i and b.ends > a.i group by all)
select source as document_id, place, level, parent_place, 2 * i - 1 - coalesce(depth, 0) as lft, 2 * i - 1 - coalesce(depth, 0) + 2 * (ends - i - 1) + 1 as rgt from e left join p using (source, place)"""
SPANS = "c as (select source, doc_id, sum(length(coalesce(text, '')) + 2) over (partition by source order by doc_id)::bigint - 2 - length(coalesce(text, '')) as char_from from documents)"


def offsets_on_pages(spark, d):
    docs = read(spark, d, "documents")
    pages = I.char_spans(docs, "source", "doc_id", "text").select(F.col("source").alias("document_id"), F.col("doc_id").alias("page"), "char_from")
    asked_ = docs.select(F.col("source").alias("document_id"), (F.col("doc_id") * 37 % 5000).alias("offset"))
    return I.page_of(asked_, pages)


def gold_questions(spark, d):
    q = asked(spark, d).select(F.col("query_id").alias("question_id"), F.substring("text", 1, 30).alias("question"), F.concat(F.lit("c"), (F.col("query_id") % 2).cast("string")).alias("collection_id"), F.when(F.col("query_id") % 5 != 0, F.array(F.col("query_id").cast("string"), (F.col("query_id") * 1000 + 7).cast("string"))).alias("gold_uids"))
    c = chunks(spark, d).select(F.col("chunk_id").cast("string").alias("chunk_uid"), F.concat(F.lit("c"), (F.col("chunk_id") % 4 % 3).cast("string")).alias("collection_id"), F.when(F.col("chunk_id") % 3 == 0, "L1").otherwise("L2").alias("level"))
    return E.gold_issues(q, c)


GOLD_ISSUES = r"""with q as (select item_id as question_id, trim(regexp_replace(lower(coalesce(text[1:30], '')), '\s+', ' ', 'g')) as t, 'c' || (item_id % 2) as collection_id, item_id % 5 <> 0 as has from benchmark),
n as (select *, row_number() over (partition by t order by question_id) as k from q),
u as (select question_id, collection_id, unnest([question_id::varchar, (question_id * 1000 + 7)::varchar]) as uid from q where has),
c as (select doc_id::varchar as uid, 'c' || (doc_id % 4 % 3) as cc, case when doc_id % 3 = 0 then 'L1' else 'L2' end as level from documents),
m as (select * from u left join c using (uid))
select question_id, 'empty_question' as issue, null as uid from n where t = '' union all select question_id, 'duplicate', null from n where t <> '' and k > 1
union all select question_id, 'no_gold', null from q where not has union all select question_id, 'stale_uid', uid from m where level is null
union all select question_id, 'foreign_uid', uid from m where level is not null and cc <> collection_id union all select question_id, 'not_leaf', uid from m where level = 'L1'
union all select null, 'too_few', null from (select count(*) as n from q where has) where n < 38"""
METRICS = f"""with {POSTINGS}, z as (select query_id, count(*) as rel from gold group by 1),
hit as (select query_id, rank, row_number() over (partition by query_id order by rank) as so_far from r semi join gold using (query_id, chunk_id) where rank <= 10),
ks as (select unnest([1, 3, 5, 10]) as k),
m as (select z.query_id, rel, k, count(rank) filter (rank <= k) as hits, min(rank) filter (rank <= k) as first, sum(so_far / rank) filter (rank <= k) as ap, sum(1 / log2(rank + 1)) filter (rank <= k) as dcg
  from z cross join ks left join hit using (query_id) group by z.query_id, rel, k),
v as (select *, list_sum(list_transform(range(1, least(rel, k) + 1), lambda i: 1 / log2(i + 1))) as ideal from m),
o as (
  select query_id, 'recall@' || k as metric, hits / rel as value from v union all select query_id, 'precision@' || k, hits / k from v
  union all select query_id, 'mrr@' || k, coalesce(1 / first, 0) from v union all select query_id, 'ndcg@' || k, coalesce(dcg / ideal, 0) from v
  union all select query_id, 'hit_rate@' || k, (hits > 0)::int from v union all select query_id, 'hits@' || k, hits from v
  union all select query_id, 'map@' || k, coalesce(ap / least(rel, k), 0) from v
  union all select z.query_id, 'first_hit_rank', min(rank) from z left join hit using (query_id) group by 1)
select query_id, metric, round(value, 6)::double as value from o"""


def metrics_at_k(spark, d):
    """All 29 metrics of each passage that a document holds."""
    return short(E.metrics_at(found(spark, d), gold(spark, d)), "value")



def assistants(spark, d):
    return read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "role", F.concat("text", F.when(F.col("turn") % 3 == 1, F.concat(F.lit(" [1] [2][1] ["), F.col("turn").cast("string"), F.lit("]"))).otherwise("")).alias("content"), (F.col("conv_id") % 7 == 0).alias("abstained"))


VALIDITY = r"""with m as (select conv_id * 1000 + turn as message_id, turn, text || case when turn % 3 = 1 then ' [1] [2][1] [' || turn || ']' else '' end as content from conversations where role = 'assistant' and conv_id % 7 <> 0),
r as (select *, len(list_distinct(regexp_extract_all(coalesce(content, ''), '\[(\d{1,3})\]', 1))) as shown, case when turn % 5 = 0 then 1 else 0 end as lost from m)
select count(*) as messages, coalesce(sum(shown + lost), 0)::bigint as emitted, coalesce(sum(lost), 0)::bigint as unresolved, count(*) filter (lost > 0) as messages_with_unresolved, count(*) filter (shown = 0) as uncited_messages,
  round(sum(shown) / sum(shown + lost), 6) as valid_ratio, round(sum(lost) / sum(shown + lost), 6) as hallucinated_ratio from r"""


def judged_labels(spark, d):
    return read(spark, d, "labels").select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("rank"), (F.col("quality") + F.col("toxic")).alias("relevance"))


def searched(spark, d):
    """All documents as leaves, each five of a parent, with the vector of their id if there is one; the items' passages as queries, likewise."""
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    docs = read(spark, d, "documents").join(v, F.col("doc_id") == F.col("vec_id"), "left")
    leaf = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), (F.floor(F.col("doc_id") / 5) + 1_000_000).alias("parent_id"), F.lit("L2").alias("level"), "text", F.lit("//").alias("header_path"), F.col("doc_id").alias("sibling"), "embedding")
    parent = leaf.groupBy("parent_id").agg(F.min("document_id").alias("document_id"), F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("text"))
    parent = parent.select(F.col("parent_id").alias("chunk_id"), "document_id", F.lit(None).cast("long").alias("parent_id"), F.lit("L1").alias("level"), "text", F.lit("//").alias("header_path"), F.lit(0).cast("long").alias("sibling"), F.lit(None).cast("array<float>").alias("embedding"))
    queries = asked(spark, d).join(v.withColumnRenamed("vec_id", "query_id"), "query_id", "left")
    return leaf.unionByName(parent), queries


def cells(spark, d):
    w = read(spark, d, "documents").select(F.col("source").alias("table_id"), "doc_id", F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("value"))
    return E.cell_f1(w.where("doc_id % 2 = 0"), w.where("doc_id % 2 = 1")).select("table_id", "shared", "gold", "found", F.round("f1", 6).alias("f1"))


QUERIES = {
    "tokenize": (lambda s, d: read(s, d, "documents").select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct")), f"select doc_id, len(w) as n_tokens, len(list_distinct(w)) as n_distinct from (select doc_id, {WORDS} as w from documents)"),
    "char_ngrams": (lambda s, d: asked(s, d).select("query_id", F.explode(T.char_ngrams(F.lower("text"))).alias("gram")).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gram").alias("n_distinct")), "with t as (select item_id as query_id, ' ' || lower(text) || ' ' as t from benchmark), n as (select unnest([3, 4, 5]) as n), g as (select query_id, substr(t, i, n) as gram from t, n, lateral (select unnest(range(1, length(t) - n + 2)) as i)) select query_id, count(*) as n, count(distinct gram) as n_distinct from g group by 1"),
    "token_estimate": (lambda s, d: read(s, d, "documents").select("doc_id", T.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens")), r"select doc_id, case when coalesce(text, '') = '' then 0 else cast(greatest(floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 2.35), floor(length(text) / 3.2)) + 1 as bigint) end as tokens from documents"),
    "lexical_anchor": (lambda s, d: asked(s, d).select("query_id", T.lexical_anchor(F.col("text")).alias("anchored")), r"""select item_id as query_id, regexp_matches(text, '\d') or regexp_matches(text, '["«»„“”]') or regexp_matches(upper(text), '(^|[^\p{L}\p{N}_])(ДСТУ|ГОСТ|ТУ|ДБН|ISO|IEC|EN|STANAG|MIL[-\s]?STD|NATO|НАТО)($|[^\p{L}\p{N}_])') as anchored from benchmark"""),
    "cyrillic_ratio": (lambda s, d: short(read(s, d, "documents").select("doc_id", T.cyrillic_ratio(F.translate(F.coalesce("text", F.lit("")), "aeo", "аео")).alias("ratio")), "ratio"), r"with t as (select doc_id, translate(coalesce(text, ''), 'aeo', 'аео') as text from documents) select doc_id, case when length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0 then round(length(regexp_replace(text, '[^\x{0400}-\x{052F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}]', '', 'g')) / length(regexp_replace(text, '[^\p{L}]', '', 'g')), 6) else 0 end as ratio from t"),
    "page_classify": (page_table, PAGE_TABLE),
    "postings": (lambda s, d: R.postings(chunks(s, d)), f"with {POSTINGS} select chunk_id, length, term, tf from tf"),
    "bm25_stats": (lambda s, d: short(R.corpus_stats(chunks(s, d)), "avg_length"), f"with {POSTINGS} select n, round(avg_length, 6) as avg_length from st"),
    "bm25_topk": (lambda s, d: short(found(s, d), "score"), f"with {POSTINGS} select query_id, chunk_id, round(score, 6) as score, rank from r where rank <= 10"),
    "dense_topk": (lambda s, d: short(dense_top(s, d), "score"), f"with {DENSE} select query_id, chunk_id, round(score, 6) as score, rank from dr where rank <= 10"),
    "dense_filtered": (lambda s, d: short(dense_top(s, d, where=R.metadata_filter({"label": [1, 2, 3]})), "score"), f"with {DENSE}, x as (select query_id, chunk_id, score, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from d where label in (1, 2, 3)) select query_id, chunk_id, round(score, 6) as score, rank from x where rank <= 10"),
    "filter_selectivity": (lambda s, d: short(R.selectivity(read(s, d, "documents"), R.metadata_filter({"lang": ["de", "fr"], "source": []}, ("n_chars", 100, None))), "selectivity"), "select count(*) filter (lang in ('de', 'fr') and n_chars >= 100) as allowed, count(*) as total, round(count(*) filter (lang in ('de', 'fr') and n_chars >= 100) / count(*), 6) as selectivity from documents"),
    "ngram_topk": (lambda s, d: short(R.top_k(R.ngram_scores(ngram_pool(s, d), asked(s, d)), 5), "score"), f"with {POSTINGS}, l as (select query_id, chunk_id, substr(lower(text), 1, 800) as low from r join documents on doc_id = chunk_id where rank <= 20), t as (select item_id as query_id, ' ' || substr(lower(text), 1, 120) || ' ' as t from benchmark), n as (select unnest([3, 4, 5]) as n), g as (select distinct query_id, substr(t, i, n) as gram from t, n, lateral (select unnest(range(1, length(t) - n + 2)) as i)), hit as (select query_id, chunk_id, gram, length(low) as len, (length(low) - length(replace(low, gram, ''))) // length(gram) as tf from l join g using (query_id)), hh as (select * from hit where tf > 0), dg as (select query_id, gram, count(*) as dfg from hh group by all), sz as (select query_id, count(*) as nn, avg(length(low)) as al from l group by 1), s2 as (select query_id, chunk_id, sum((ln((nn + 1) / (dfg + 1)) + 1) * (1 + ln(tf)) / (0.25 + 0.75 * len / al)) as score from hh join dg using (query_id, gram) join sz using (query_id) group by all), z as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from s2) select query_id, chunk_id, round(score, 6) as score, rank from z where rank <= 5"),
    "rrf_fuse": (lambda s, d: short(fused(s, d), "rrf"), f"with {FUSED} select query_id, chunk_id, round(rrf, 6) as rrf, branches, best_rank, row_number() over (partition by query_id order by round(rrf, 12) desc, branches desc, best_rank, chunk_id) as rank from f"),
    "abstain_threshold": (lambda s, d: short(R.abstention(dense_top(s, d).where("rank > 1"), vector_queries(s, d), 0.35), "confidence"), f"with {DENSE} select query_id, round(max(score), 6) as confidence, count(*) filter (score >= 0.35) as supporting, count(*) filter (score >= 0.35) < 1 as abstain from dr where rank between 2 and 10 group by 1"),
    "diversify_quota": (lambda s, d: R.diversify(ranked_chunks(s, d), 2, 2, 0.6).select("query_id", "chunk_id", "document_id", "position"), DIVERSE),
    "automerge": (lambda s, d: short(R.automerge(ranked_chunks(s, d)), "score"), f"with {RANKED}, n as (select *, count(*) over (partition by query_id, parent_id) as n from h) select query_id, case when n >= 2 then parent_id else chunk_id end as node_id, n >= 2 as merged, round(max(score), 6) as score from n group by 1, 2, 3"),
    "reorder_blocks": (lambda s, d: R.reading_order(ranked_chunks(s, d)).select("query_id", "chunk_id", "block", "position"), f"with {RANKED}, g as (select *, chunk_id - row_number() over (partition by query_id, document_id order by chunk_id) as run from h), m as (select *, min(rank) over (partition by query_id, document_id, run) as best from g), k as (select *, dense_rank() over (partition by query_id order by best) as block from m) select query_id, chunk_id, block, row_number() over (partition by query_id order by case when block % 2 = 1 then block else 1000000 - block end, chunk_id) as position from k"),
    "ranking_metrics": (lambda s, d: short(E.ranking_metrics(found(s, d), gold(s, d), 10), "recall", "precision", "mrr", "ndcg", "map", "hit"), f"with {POSTINGS}, z as (select query_id, count(*) as rel from gold group by 1), hit as (select query_id, rank, row_number() over (partition by query_id order by rank) as so_far from r semi join gold using (query_id, chunk_id) where rank <= 10), a as (select query_id, count(*) as hits, min(rank) as first, sum(1 / log2(rank + 1)) as dcg, sum(so_far / rank) as ap from hit group by 1) select query_id, round(coalesce(hits / rel, 0), 6) as recall, round(coalesce(hits / 10, 0), 6) as precision, round(coalesce(1 / first, 0), 6) as mrr, round(coalesce(dcg / list_sum(list_transform(range(1, least(rel, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) as ndcg, round(coalesce(ap / least(rel, 10), 0), 6) as map, round(coalesce((hits > 0)::int, 0)::double, 6) as hit from z left join a using (query_id)"),
    "youden_tau": (lambda s, d: short(E.youden(read(s, d, "labels").join(read(s, d, "documents").select("doc_id", "n_chars"), "doc_id"), "n_chars", "quality"), "j"), "with p as (select n_chars as tau, count(*) filter (quality = 1) as pos, count(*) filter (quality = 0) as neg from labels join documents using (doc_id) group by 1) select tau, round(round(sum(pos) over (order by tau desc) / sum(pos) over () - sum(neg) over (order by tau desc) / sum(neg) over (), 9), 6) as j from p order by j desc, tau limit 1"),
    "cer": (cer_pairs, "select item_id as query_id, case when length(text) > 0 then round(levenshtein(text, replace(text, 'e', 'c')) / length(text), 6) else 0 end as cer from benchmark"),
    "confusions": (confusions, None),
    "map_reduce_answers": (map_reduce_answers, None),
    "cell_f1": (cells, f"with w as (select source as table_id, doc_id, unnest({WORDS}) as value from documents), a as (select table_id, value, count(*) as c from w where doc_id % 2 = 0 group by all), b as (select table_id, value, count(*) as p from w where doc_id % 2 = 1 group by all) select table_id, sum(least(coalesce(c, 0), coalesce(p, 0)))::bigint as shared, sum(coalesce(c, 0))::bigint as gold, sum(coalesce(p, 0))::bigint as found, round(2 * sum(least(coalesce(c, 0), coalesce(p, 0))) / (sum(coalesce(c, 0)) + sum(coalesce(p, 0))), 6) as f1 from a full join b using (table_id, value) group by 1"),
    "chunks": (elements_count, None),
    "char_spans": (lambda s, d: I.char_spans(read(s, d, "documents").select("source", "doc_id", "text"), "source", "doc_id", "text").select("doc_id", "char_from", "char_to"), "select doc_id, sum(length(coalesce(text, '')) + 2) over (partition by source order by doc_id)::bigint - 2 - length(coalesce(text, '')) as char_from, sum(length(coalesce(text, '')) + 2) over (partition by source order by doc_id)::bigint - 2 as char_to from documents"),
    "page_labels_offset": (lambda s, d: I.label_offset(read(s, d, "documents").withColumn("label", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") + F.when(F.col("doc_id") % 6 == 1, 1).otherwise(0) + 12)), "source", "doc_id", "label").select("source", "samples", "page_offset", "agree"), "with x as (select source, 12 + (doc_id % 6 = 1)::int as o from documents where doc_id % 7 <> 0), c as (select source, o, count(*) as n from x group by all), b as (select source, sum(n)::bigint as samples, arg_max(o, n * 1000 - o)::bigint as page_offset, max(n) as agree from c group by 1) select * from b where samples >= 5 and agree >= 0.8 * samples"),
    "neighbours": (lambda s, d: I.neighbours(numbered(s, d), numbered(s, d), 2).select("document_id", "centre", "chunk_id"), "with o as (select source, doc_id, row_number() over (partition by source order by doc_id) as n from documents) select a.source as document_id, a.n as centre, b.doc_id as chunk_id from o a join o b on a.source = b.source and b.n between a.n - 2 and a.n + 2"),
    "cache_reuse": (lambda s, d: I.reusable(read(s, d, "documents")), "with f as (select text, min(doc_id) as source_id from documents where text is not null group by 1) select doc_id, source_id from documents join f using (text) where doc_id <> source_id"),
    "page_range_merge": (lambda s, d: I.merge_page_ranges(read(s, d, "documents").select("source", (F.col("doc_id") % 97).alias("page_from"), (F.col("doc_id") % 97 + F.col("doc_id") % 4).alias("page_to")), ["source"]), "with t as (select source, doc_id % 97 as page_from, doc_id % 97 + doc_id % 4 as page_to from documents), m as (select *, max(page_to) over (partition by source order by page_from, page_to rows between unbounded preceding and 1 preceding) as prev from t), n as (select *, sum((prev is null or prev + 1 < page_from)::int) over (partition by source order by page_from, page_to rows unbounded preceding) as run from m) select source, min(page_from) as page_from, max(page_to) as page_to from n group by source, run"),
    "metrics_at_k": (metrics_at_k, METRICS),
    "stratified_sample": (lambda s, d: E.stratified_sample(chunks(s, d).withColumn("level", F.lit("L2")), 30, 3).select("chunk_id", "document_id", "turn"), "with f as (select doc_id as chunk_id, source as document_id, row_number() over (partition by source order by md5('20260101/' || doc_id)) as turn from documents where length(text) >= 250) select * from f where turn <= 3 order by turn, document_id limit 30"),
    "gold_validation": (gold_questions, GOLD_ISSUES),
    "abstention_rates": (lambda s, d: short(E.abstention_rates(read(s, d, "labels").select(F.col("doc_id").alias("question_id"), (F.col("quality") == 1).alias("answerable")), read(s, d, "labels").where("doc_id % 4 <> 0").select(F.col("doc_id").alias("question_id"), (F.col("toxic") == 1).alias("abstained"))), "correct_refusals", "false_refusals", "balanced_accuracy"), "with r as (select quality = 1 as a, toxic = 1 and doc_id % 4 <> 0 as no from labels), c as (select count(*) filter (not a) as unanswerable, count(*) filter (not a and no) as unanswerable_refused, count(*) filter (a) as answerable, count(*) filter (a and no) as answerable_refused from r) select *, round(unanswerable_refused / unanswerable, 6) as correct_refusals, round(answerable_refused / answerable, 6) as false_refusals, round((unanswerable_refused / unanswerable + 1 - answerable_refused / answerable) / 2, 6) as balanced_accuracy from c"),
    "citation_validity": (lambda s, d: short(G.citation_validity(assistants(s, d), assistants(s, d).where("role = 'assistant' and message_id % 1000 % 5 = 0").select("message_id")), "valid_ratio", "hallucinated_ratio"), VALIDITY),
    "nested_sets": (lambda s, d: I.nested_sets(headings(s, d)).drop("title"), NESTED),
    "offset_to_page": (offsets_on_pages, f"with {SPANS}, o as (select source, doc_id * 37 % 5000 as off from documents) select o.source as document_id, off as \"offset\", c.doc_id as page from o asof left join (select source, char_from, max(doc_id) as doc_id from c group by all) c on o.source = c.source and o.off >= c.char_from"),
    "document_quality": (lambda s, d: I.document_quality(read(s, d, "documents").select(F.col("source").alias("document_id"), (F.col("doc_id") * 31 % 100 / 100).alias("score"))), "with l as (select source, list_sort(list(doc_id * 31 % 100 / 100)) as s from documents group by 1), q as (select source as document_id, s[1 + case when len(s) >= 10 then greatest(0, floor(len(s) * 0.1)::int - 1) else 0 end] as score from l) select *, case when score >= 0.9 then 'EXCELLENT' when score >= 0.8 then 'GOOD' when score >= 0.5 then 'FAIR' else 'POOR' end as grade from q"),
    "graded_ndcg": (lambda s, d: short(E.graded_ndcg(judged_labels(s, d)), "ndcg"), "with j as (select doc_id % 40 as query_id, doc_id as rank, quality + toxic as rel from labels), p as (select *, row_number() over (partition by query_id order by rank) as k, row_number() over (partition by query_id order by rel desc, rank) as i from j), s as (select query_id, sum((2 ** rel - 1) / log2(k + 1)) filter (k <= 10) as dcg, sum((2 ** rel - 1) / log2(i + 1)) filter (i <= 10) as idcg from p group by 1) select query_id, round(case when idcg > 0 then dcg / idcg else 0 end, 6) as ndcg from s"),
    "near_simhash": (lambda s, d: R.near_pairs(chunks(s, d).select("chunk_id", (F.col("chunk_id") % 500 * 4294967311).alias("simhash")), 3), "with t as (select doc_id, doc_id % 500 * 4294967311 as h from documents) select a.doc_id as a, b.doc_id as b, bit_count(xor(a.h, b.h))::int as hamming from t a join t b on a.doc_id < b.doc_id where bit_count(xor(a.h, b.h)) <= 3"),
    "retrieve": (lambda s, d: R.retrieve(*searched(s, d))["selected"].select("query_id", "chunk_id", "ordinal", "merged"), None),
    "explain": (lambda s, d: R.retrieve(*searched(s, d))["candidates"], None),
}
