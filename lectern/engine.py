"""One object over a corpus: ingest, retrieve, answer, explain, and what is asked about documents, jobs and sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.functions import text as T
from lectern.operators import generation as G
from lectern.operators import ingest as I
from lectern.operators import operations as O
from lectern.operators import retrieval as R
from lectern.operators.embedding import hashed_embedding
from lectern.staging import staged


class Engine:
    """Tables by name (documents, chunks, pages, jobs, messages, events, feedback) and settings; every method returns a plan.

    Models are given as functions on frames: embedder takes (chunk_id, text) and returns (chunk_id, embedding); reranker takes candidates and
    queries and adds rerank_score. Without them vectors are hashed words and trigrams, and scores shares of words.
    """

    def __init__(self, tables: dict[str, DataFrame], config: Config | None = None, embedder: Callable[[DataFrame], DataFrame] | None = None, reranker: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> None:
        self.tables, self.config = tables, config or Config()
        self.embedder, self.reranker = embedder or hashed_embedding, reranker

    def ingest(self, docs: DataFrame, title: str | None = None) -> DataFrame:
        """The chunks of docs (doc_id, text) that no earlier document has word for word, leaves with their vectors: rows for the table chunks."""
        fresh = docs.join(I.reusable(docs).select("doc_id"), "doc_id", "left_anti")
        tree = staged(I.chunk_tree(fresh, title=title), "ingest-tree")
        leaves = tree.where("level = 'L2'").select("chunk_id", T.embed_text(F.lit(""), F.col("header_path"), F.col("text")).alias("text"))
        return tree.join(self.embedder(leaves).select("chunk_id", "embedding"), "chunk_id", "left")

    def asked(self, queries: DataFrame) -> DataFrame:
        """queries with a vector, the embedder's where they bring none."""
        if "embedding" in queries.columns:
            return queries
        vectors = self.embedder(queries.select(F.col("query_id").alias("chunk_id"), "text"))
        return queries.join(vectors.select(F.col("chunk_id").alias("query_id"), "embedding"), "query_id", "left")

    def retrieve(self, queries: DataFrame, predicate: Column | None = None) -> dict[str, DataFrame]:
        return R.retrieve(self.tables["chunks"], self.asked(queries), self.config, predicate, reranker=self.reranker)

    def evidence(self, queries: DataFrame, got: dict[str, DataFrame] | None = None) -> DataFrame:
        """What the prompt of each query shows: chunks in their order, cut to fit. got: what retrieve gave, if it was asked already."""
        selected = (got or self.retrieve(queries))["selected"].withColumn("rank", F.col("ordinal"))
        titles = self.tables["documents"].select("document_id", "title")
        rows = G.fit_evidence(selected, self.config).join(titles, "document_id", "left")
        return rows.select("query_id", "ordinal", F.col("chunk_id").cast("string").alias("chunk_uid"), "document_id", F.coalesce("title", F.lit("")).alias("title"), "header_path", F.lit("").alias("label"), F.col("cut_text").alias("text"))

    def answer(self, queries: DataFrame) -> DataFrame:
        """(query_id, abstain, answer): extracted sentences with their sources, or a refusal where the evidence is too weak."""
        got = self.retrieve(queries)
        decisions, evidence = got["decisions"], staged(self.evidence(queries, got), "answer-evidence")
        said = G.extractive_answers(evidence, queries).withColumnRenamed("answer", "said")
        no = G.refusal(evidence.withColumn("rank", F.col("ordinal")), queries).withColumnRenamed("answer", "refusal")
        return decisions.join(said, "query_id", "left").join(no, "query_id").select("query_id", "abstain", F.when(F.col("abstain") | F.col("said").isNull(), F.col("refusal")).otherwise(F.col("said")).alias("answer"))

    def explain(self, queries: DataFrame) -> DataFrame:
        return self.retrieve(queries)["candidates"]

    def playground(self, queries: DataFrame) -> DataFrame:
        """The head before and after the reranker, side by side."""
        after = self.retrieve(queries)["candidates"]
        order = R.ranked_list(after.where("duplicate_of is null"), self.config.rerank_top_k).withColumnRenamed("rank", "after")
        return after.withColumnRenamed("rank", "before").join(order, ["query_id", "chunk_id"], "left")

    def prompt_preview(self, queries: DataFrame) -> DataFrame:
        return G.prompts(self.evidence(queries), queries, self.config.prompt_tier)

    def documents(self, most: int = 50) -> DataFrame:
        """The newest documents with their numbers of chunks."""
        counts = self.tables["chunks"].groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
        return O.latest(self.tables["documents"].join(counts, "document_id", "left"), "created_at", "document_id", most)

    def delete(self, gone: DataFrame) -> dict[str, DataFrame]:
        """Documents without those gone (document_id), and their chunks and pages."""
        return {n: O.cascade_delete(self.tables[n], gone, "document_id") for n in ("documents", "chunks", "pages") if n in self.tables}

    def pages(self, document_id: str) -> DataFrame:
        return self.tables["pages"].where(F.col("document_id") == document_id).orderBy("page")

    def jobs(self) -> DataFrame:
        return self.tables["jobs"].where(F.col("state").isin("QUEUED", "LEASED", "RUNNING")).orderBy("priority", "created_at", "job_id")

    def sessions(self) -> DataFrame:
        """(session_id, messages, title): the title is the first question, 80 characters at most."""
        asked = F.min(F.when(F.col("role") == "user", F.struct("message_id", "content")))
        return self.tables["messages"].groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.substring(T.squeezed(asked["content"]), 1, 80).alias("title"))

    def messages(self, session_id: str) -> DataFrame:
        return self.tables["messages"].where(F.col("session_id") == session_id).orderBy("message_id")

    def events(self, after: int = 0, size: int = 512) -> DataFrame:
        return O.replay(self.tables["events"], after, size)

    def telemetry_summary(self) -> DataFrame:
        return O.telemetry(self.tables["events"], "name", "duration_ms", ~F.col("ok"))

    def feedback(self) -> DataFrame:
        return self.tables["feedback"].groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
