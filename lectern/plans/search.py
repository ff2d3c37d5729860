"""Queries that search stored indexes over documents and vectors, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import morphology as M
from lectern.operators import embedding as B
from lectern.operators import inverted_index as N
from lectern.operators import retrieval as R
from lectern.operators import vector_index as V
from lectern.plans.documents import DENSE, WORDS, asked, chunks, read, short, vector_queries, vectors
from lectern.staging import new_folder, staged

#: Characters of a document that the self-test gives a model at a time.
PIECE = 300


def vector_index(spark: SparkSession, d: str) -> V.VectorIndex:
    return V.build(vectors(spark, d), new_folder(spark, "vectors"), ("label",))


def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector's ten nearest, by the cells that the index chooses to probe."""
    return short(V.search(vector_index(spark, d), vector_queries(spark, d), 10), "score")


def ann_full_probe(spark: SparkSession, d: str) -> DataFrame:
    """The same by all cells, which is exact."""
    return short(V.exact_search(vector_index(spark, d), vector_queries(spark, d), 10), "score")


def ann_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of few labels: the filter's share decides on the strategy."""
    return short(V.filtered_search(vector_index(spark, d), vector_queries(spark, d), 10, R.metadata_filter({"label": [1, 2, 3]}))[0], "score")


def text_index(spark: SparkSession, d: str) -> N.InvertedIndex:
    return N.build(N.search_fields(chunks(spark, d)), new_folder(spark, "terms"))


def weighted_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of each benchmark passage, by a stored index of words, parts of compounds and codes."""
    return short(N.search(text_index(spark, d), N.query_fields(asked(spark, d)), 10), "score")


def markup(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select(F.col("page_id").alias("chunk_id"), F.col("html").alias("text"))


def coded(spark: SparkSession, d: str) -> DataFrame:
    """Codes that are asked for: those of pages whose id is divisible by 50, and their last five characters."""
    own = N.search_fields(markup(spark, d).where("chunk_id % 50 = 0")).where("size(codes) > 0")
    whole = F.array_distinct("codes")
    return own.select(F.col("chunk_id").alias("query_id"), F.array_distinct(F.concat(whole, F.transform(whole, lambda c: F.right(c, F.lit(5))))).alias("codes"))


def code_search(spark: SparkSession, d: str) -> DataFrame:
    """Pages that have the codes of every fiftieth page, by an index of codes alone."""
    return N.code_search(N.build(N.search_fields(markup(spark, d)), new_folder(spark, "codes"), {}), coded(spark, d))


def lemma_table(spark: SparkSession, d: str) -> DataFrame:
    """Base forms of all words of documents and passages; the passages' are added to those of the documents."""
    first = staged(M.grown(M.empty_table(spark), M.placed(chunks(spark, d)).where("not code")), "lemmas")
    return staged(M.grown(first, M.placed(asked(spark, d), "query_id").where("not code")), "lemmas")


def lemma_streams(spark: SparkSession, d: str) -> DataFrame:
    """Each document's streams, as their sizes and contents."""
    s = M.lemma_streams(chunks(spark, d), lemma_table(spark, d))
    return s.select("chunk_id", *[F.size(c).alias(f"n_{c}") for c in ("words", "forms", "codes")], F.md5(F.array_join("words", " ")).alias("words"), F.md5(F.array_join("forms", " ")).alias("forms"), F.md5(F.array_join("codes", " ")).alias("codes"))


def lemma_bm25(spark: SparkSession, d: str) -> DataFrame:
    """The ten best documents of each passage by base forms, surfaces and designations."""
    table = lemma_table(spark, d)
    index = N.build(M.lemma_streams(chunks(spark, d), table), new_folder(spark, "lemma-terms"))
    return short(N.search(index, M.lemma_queries(asked(spark, d), table), 10), "score")


def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Each document's vector, as its norm, how many numbers are not 0, and a sum that weighs each by its place."""
    v = B.hashed_embedding(chunks(spark, d))
    places = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.select("chunk_id", F.size(F.filter("embedding", lambda x: F.abs(x) > 1e-12)).cast("long").alias("filled"), F.round(places, 5).alias("placed"))


def passages(docs: DataFrame, prefix: str) -> DataFrame:
    """(chunk_id, text): all of each text in pieces of PIECE characters, each behind the prefix."""
    pieces = docs.select("chunk_id", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("piece"))
    return pieces.select("chunk_id", F.concat(F.lit(prefix), "piece").alias("text"))


def embedding_self_test(spark: SparkSession, d: str) -> DataFrame:
    """The checks on hashed vectors of documents: the vectors of the same texts with wider spaces have to be the same; prefix and budget hold for all passages."""
    docs = chunks(spark, d).where("length(text) > 0")
    again = B.hashed_embedding(docs.withColumn("text", F.regexp_replace("text", " ", "  ")))
    vectors = staged(B.hashed_embedding(docs), "self-test-vectors")  # read twice
    return short(B.self_test(vectors, again, passages(docs, "passage: "), "passage: "), "worst")


HASHED_SQL = f"""with w as (select doc_id as chunk_id, unnest({WORDS}) as word from documents),
c as (select chunk_id, word, count(*) as n from w group by all),
f as (
  select chunk_id, 'w:' || word as feature, 1.0::double as x, n from c
  union all select chunk_id, 'g:' || substr('<' || word || '>', i::int, 3), {B.TRIGRAM}::double, n from (select chunk_id, word, n, unnest(range(1, length(word) + 1)) as i from c)),
g as (select chunk_id, feature, x * (1 + ln(sum(n))) as weight from f group by chunk_id, feature, x),
s as (
  select chunk_id, ('0x' || substr(md5(feature), 1, 7))::bigint % {B.DIMS} as place, sum(case when ('0x' || substr(md5(feature), 9, 7))::bigint % 2 = 0 then weight else -weight end) as v from g group by all),
n as (select chunk_id, sqrt(sum(v * v)) as norm from s group by 1),
t as (select chunk_id, count(*) filter (abs(v / norm) > 1e-12) as filled, sum(v / norm * (place + 1)) as placed from s join n using (chunk_id) group by 1)
select doc_id as chunk_id, coalesce(filled, 0) as filled, round(coalesce(placed, 0), 5) as placed from documents left join t on chunk_id = doc_id"""


RULES_SQL = ", ".join(f"('{a.replace(chr(39), chr(39) * 2)}', '{b}', {n}, {str(x).lower()})" for a, b, n, x in M.RULES)
LEMMAS = f"""rules(suffix, new, least, dbl) as (values {RULES_SQL}),
tokens as (select chunk_id, unnest(w) as surface, generate_subscripts(w, 1) as place from (select doc_id as chunk_id, {WORDS} as w from documents)),
surf as (select distinct surface from tokens),
fit as (select surface, arg_max({{'suffix': suffix, 'new': new, 'dbl': dbl}}, length(suffix)) as r from surf join rules on ends_with(surface, suffix) and length(surface) > length(suffix) and length(surface) - length(suffix) >= least
  where not regexp_matches(surface, '\\d') group by surface),
stem as (select surface, r, left(surface, length(surface) - length(r.suffix)) as s from fit),
lem as (select surface, (case when r.dbl and contains('{M.CONSONANTS}', right(s, 1)) and right(s, 2) = right(s, 1) || right(s, 1) then left(s, length(s) - 1) else s end) || r.new as lemma from stem),
p as (select chunk_id, place, t.surface, coalesce(lemma, t.surface) as lemma, regexp_matches(t.surface, '\\d') and regexp_matches(t.surface, '\\p{{L}}') as code from tokens t left join lem using (surface))"""
LEMMA_SQL = f"""with {LEMMAS}
select chunk_id, count(*) filter (not code)::int as n_words, count(*) filter (not code and lemma <> surface)::int as n_forms, count(*) filter (code)::int as n_codes,
  md5(coalesce(string_agg(lemma, ' ' order by place) filter (not code), '')) as words, md5(coalesce(string_agg(surface, ' ' order by place) filter (not code and lemma <> surface), '')) as forms,
  md5(coalesce(string_agg(surface, ' ' order by place) filter (code), '')) as codes from p group by chunk_id"""

RUNS = r"list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_-]+'), lambda w: length(w) >= 2 and regexp_matches(w, '\p{L}') and regexp_matches(w, '\p{N}')), lambda w: lower(w))"
PARTS = r"flatten(list_transform(list_filter({w}, lambda w: contains(w, '-')), lambda w: list_distinct(list_filter(string_split(w, '-'), lambda p: length(p) >= 3 and not regexp_matches(p, '^\d+$')))))"
WEIGHTED_SQL = f"""with f as (select doc_id as chunk_id, {WORDS} as w, {RUNS} as c from documents),
g as (select chunk_id, w, {PARTS.format(w="w")} as p, c from f),
a as (select chunk_id, len(w) + len(p) + len(c) as length, list_concat(list_transform(w, lambda t: {{'t': t, 'x': 1.0::double}}), list_transform(p, lambda t: {{'t': t, 'x': 0.4::double}}), list_transform(c, lambda t: {{'t': t, 'x': 2.5::double}})) as l from g),
st as (select count(*) as n, avg(length) as avg_length from a),
u as (select chunk_id, length, unnest(l) as e from a),
tf as (select chunk_id, length, e.t as term, sum(e.x) as tf from u group by all),
df as (select term, count(*) as df from tf group by term),
b as (select item_id as query_id, {WORDS} as w, {RUNS} as c from benchmark),
q as (select distinct query_id, unnest(list_concat(w, {PARTS.format(w="w")}, c)) as term from b),
sc as (select query_id, chunk_id, sum(case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))) as score
  from tf join df using (term) join q using (term), st where length(term) >= 2 group by all),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as rank from sc)
select query_id, chunk_id, round(score, 6) as score, rank from r where rank <= 10"""
CODE_SQL = f"""with c as (select page_id as chunk_id, unnest(list_distinct({RUNS})) as code from (select page_id, html as text from pages)),
q as (select distinct chunk_id as query_id, code as wanted from c where chunk_id % 50 = 0 union select chunk_id, right(code, 5) from c where chunk_id % 50 = 0)
select query_id, chunk_id, count(distinct wanted) as hits from q join c on contains(code, wanted) where length(wanted) >= 3 group by all"""
ANN_SQL = f"with {DENSE} select query_id, chunk_id, round(score, 6) as score, rank from dr where rank <= 10"

QUERIES = {
    "ann_topk": (ann_topk, None),
    "ann_full_probe": (ann_full_probe, ANN_SQL),
    "ann_filtered": (ann_filtered, None),
    "weighted_bm25": (weighted_bm25, WEIGHTED_SQL),
    "code_search": (code_search, CODE_SQL),
    "hashed_embedding": (hashed_embedding, HASHED_SQL),
    "embedding_self_test": (embedding_self_test, None),
    "lemma_streams": (lemma_streams, LEMMA_SQL),
    "lemma_bm25": (lemma_bm25, None),
}
