"""From selected chunks to prompts, and from answers to citations and their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.functions import text as T
from lectern.staging import staged

#: Characters that evidence is cut to, in turn, and the tokens that a source's heading takes.
CAPS, HEADING_TOKENS = (2000, 1400, 1000, 700, 500), 24
#: Markers like [1] and [1, 2], and abbreviations that end no sentence.
MARKER = r"\[(\d{1,3}(?:\s*,\s*\d{1,3})*)\]"
ABBREVIATIONS = "с стор рис табл мал арт див напр тис млн млрд гр п пп ст розд им т тобто зокрема мм см км кг хв год обр зр".split()
#: The words of prompts, and what is said where the evidence is too weak.
UNTITLED, QUESTION, SOURCES, ANSWER = "Без назви", "Питання: ", "ДЖЕРЕЛА:", "Відповідь:"
BRIEF = "ЯК ВІДПОВІДАТИ: факти бери тільки з поданих джерел і познач кожен номером [n]; якщо даних бракує, так і напиши; пиши українською, коротко й без повторів."
RULES = {"compact": BRIEF, "full": f"{BRIEF} Коли джерела говорять про різні сторони питання, зведи їх разом. Саме питання не повторюй і нічого не дописуй після відповіді."}
REFUSAL = ("Подані джерела не дають змоги відповісти на це питання.", "Найближче до теми в них таке:", "Щоб одержати відповідь, додайте документ із цієї теми.")
#: What may open a sentence: a capital or a digit, behind one quotation mark or bracket at most; what a sentence ends in.
OPENING, ENDING = "^[«\"(\\[]?[\\p{Lu}\\d]", "[.!?…]$"


def fit_evidence(selected: DataFrame, config: Config | None = None, context_tokens: int = 8192, least: int = 2) -> DataFrame:
    """selected (query_id, rank, text) as far as it fits the context: the worst ranks go first, then texts are cut to the first cap that fits.

    Adds cap (null: whole texts) and cut_text; at least `least` chunks of a query stay.
    """
    c = config or Config()
    budget = context_tokens - c.max_tokens - c.system_tokens - c.reserve_tokens
    order = Window.partitionBy("query_id").orderBy("rank")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = selected.withColumns({"_n": F.row_number().over(order), "_sum": F.sum(T.token_estimate(text) + HEADING_TOKENS).over(order)})
    if budget <= 0:
        return rows.where(F.col("_n") <= least).withColumns({"cap": F.lit(600), "cut_text": F.substring(text, 1, 600)}).drop("_n", "_sum")
    # sums grow with the rank, so what fits is a head; below it the least chunks stay and are cut
    rows = rows.where((F.col("_sum") <= budget) | (F.col("_n") <= least))
    whole = Window.partitionBy("query_id")
    rows = rows.withColumn("_fits", F.max("_sum").over(whole) <= budget)
    cap = F.when(F.col("_fits"), F.lit(None).cast("int"))
    for n in CAPS:
        cap = cap.when(F.sum(T.token_estimate(F.substring(text, 1, n)) + HEADING_TOKENS).over(whole) <= budget, n)
    rows = rows.withColumn("cap", cap.when(~F.col("_fits"), CAPS[-1]))
    return rows.withColumn("cut_text", F.when(F.col("cap").isNull(), text).otherwise(F.substring(text, F.lit(1), F.col("cap")))).drop("_n", "_sum", "_fits")


def source_block(ordinal: Column, title: Column, path: Column, label: Column, text: Column) -> Column:
    """One numbered source: its title, path and pages, and its text below."""
    bits = F.array(F.coalesce(F.when(title != "", title), F.lit(UNTITLED)), F.array_join(F.filter(F.split(path, "/"), lambda t: t != ""), " › "), label)
    return F.concat(F.lit("["), ordinal.cast("string"), F.lit("] "), F.array_join(F.filter(bits, lambda b: b.isNotNull() & (b != "")), " — "), F.lit("\n"), F.trim(text))


def prompts(evidence: DataFrame, queries: DataFrame, tier: str = "compact") -> DataFrame:
    """(query_id, prompt, citations): question, sources in order, rules, question; citations maps a number to its chunk_uid.

    evidence: query_id, ordinal, chunk_uid, title, header_path, label, text.
    """
    block = source_block(F.col("ordinal"), F.col("title"), F.col("header_path"), F.col("label"), F.col("text"))
    own = F.struct("ordinal", block.alias("block"), "chunk_uid")
    lists = evidence.groupBy("query_id").agg(F.sort_array(F.collect_list(own)).alias("e"))
    head = F.concat(F.lit(QUESTION), F.trim("text"))
    prompt = F.concat_ws("\n\n", head, F.concat(F.lit(SOURCES + "\n"), F.array_join(F.col("e.block"), "\n\n")), F.lit(RULES[tier]), F.concat(head, F.lit("\n" + ANSWER)))
    citations = F.map_from_entries(F.transform("e", lambda x: F.struct(x["ordinal"].cast("string"), x["chunk_uid"])))
    return queries.select("query_id", "text").join(lists, "query_id").select("query_id", prompt.alias("prompt"), citations.alias("citations"))


def strategy(total_tokens: Column, budget: Column, documents_before: Column, documents_after: Column) -> Column:
    """How a query is answered: directly, with less or cut evidence, or document by document if trimming would lose a document."""
    return F.when(total_tokens <= budget, "direct").when(documents_after < documents_before, "map-reduce").otherwise("trimmed")


def extractive_answers(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, answer): of each source the sentence that shares most words with the question, with its marker; a stand-in for a model."""
    sentences = evidence.select("query_id", "ordinal", F.posexplode(F.split(T.squeezed(F.col("text")), r"(?<=[.!?…])\s+")).alias("place", "sentence"))
    asked = queries.select("query_id", T.content_words(F.col("text")).alias("_q"))
    scored = sentences.join(asked, "query_id").withColumn("shared", F.size(F.array_intersect(T.content_words(F.col("sentence")), F.col("_q"))))
    best = scored.groupBy("query_id", "ordinal").agg(F.max_by("sentence", F.struct("shared", -F.col("place"))).alias("sentence"))
    line = F.struct("ordinal", F.concat("sentence", F.lit(" ["), F.col("ordinal").cast("string"), F.lit("]")).alias("line"))
    return best.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(line)).getField("line"), " ").alias("answer"))


def best_lines(rows: DataFrame, tokens: int) -> DataFrame:
    """rows (question, text) with answer: the lines of text that share most words with the question, as many as `tokens` hold, in their order.

    A line that shares none is left out, so the answer may be empty; the best line stays whatever its size. A stand-in for a model.
    """
    wanted = T.content_words(F.col("question"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.size(F.array_intersect(T.content_words(x), F.col("_q"))).alias("shared"), (-i).alias("place"), x.alias("line")))
    ranked = F.reverse(F.array_sort(F.filter(lines, lambda x: x["shared"] > 0)))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<place: int, line: string>>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        size = T.token_estimate(x["line"])
        fits = (F.size(state["kept"]) == 0) | (state["used"] + size <= tokens)
        return F.when(fits, F.struct((state["used"] + size).alias("used"), F.concat(state["kept"], F.array(F.struct(x["place"].alias("place"), x["line"].alias("line")))).alias("kept"))).otherwise(state)

    kept = F.aggregate("_r", start, step, lambda s: F.reverse(F.array_sort(s["kept"])))
    marked = rows.withColumn("_q", wanted).withColumn("_r", ranked).withColumn("_k", kept)
    return marked.withColumn("answer", F.array_join(F.col("_k.line"), "\n")).drop("_q", "_r", "_k")


def map_reduce_answers(evidence: DataFrame, queries: DataFrame, budget: int = 4000, tokens: int = 400, answerer: Callable[[DataFrame, int], DataFrame] = best_lines) -> DataFrame:
    """(query_id, answer, documents, levels): an answer of each document first, then answers of neighbouring answers, until one is left.

    evidence: query_id, ordinal, document_id, text; queries: query_id, text. A document's sources are taken in order as far as the budget of tokens holds them
    (one at least), sentence by sentence with their markers. The answerer, a model or best_lines, takes rows with question and text and adds an answer of
    about `tokens`; an empty one drops out. A level joins neighbours while they fit the budget, two at least, so no group holds more than that
    and levels grow with the logarithm of a query's documents. A query whose evidence says nothing has no row.
    """
    asked = queries.select("query_id", F.col("text").alias("question"))
    order = Window.partitionBy("query_id", "document_id").orderBy("ordinal")
    sized = evidence.select("query_id", "document_id", "ordinal", F.coalesce("text", F.lit("")).alias("text"))
    sized = sized.withColumns({"_sum": F.sum(T.token_estimate(F.col("text"))).over(order), "_n": F.row_number().over(order)}).where((F.col("_sum") <= budget) | (F.col("_n") == 1))
    said = F.transform(sentences(F.col("text")), lambda x: F.concat(x, F.lit(" ["), F.col("ordinal").cast("string"), F.lit("]")))
    lines = sized.select("query_id", "document_id", "ordinal", F.array_join(said, "\n").alias("lines"))
    mapped = lines.groupBy("query_id", "document_id").agg(F.min("ordinal").alias("place"), F.array_join(F.sort_array(F.collect_list(F.struct("ordinal", "lines"))).getField("lines"), "\n").alias("text"))
    parts = answerer(mapped.join(asked, "query_id"), tokens).where("answer <> ''").select("query_id", "place", F.col("answer").alias("text"), F.lit(1).cast("long").alias("documents"), F.lit(1).alias("levels"))
    parts = staged(parts, "answers-mapped")
    while (parts.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0) > 1:
        w = Window.partitionBy("query_id").orderBy("place")
        filled = F.floor((F.sum(T.token_estimate(F.col("text"))).over(w) - 1) / budget)
        grouped = parts.withColumn("bin", F.least(filled, F.floor((F.row_number().over(w) - 1) / 2)))
        whole = grouped.groupBy("query_id", "bin").agg(F.min("place").alias("place"), F.sum("documents").alias("documents"), F.max("levels").alias("levels"), F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(F.struct("place", "text"))).getField("text"), "\n").alias("text"))
        again = answerer(whole.where("n > 1").join(asked, "query_id"), tokens).where("answer <> ''").select("query_id", "place", F.col("answer").alias("text"), "documents", (F.col("levels") + 1).alias("levels"))
        parts = staged(whole.where("n = 1").select("query_id", "place", "text", "documents", "levels").unionByName(again), "answers-reduced")
    return parts.select("query_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("answer"), "documents", "levels")


def leaves_of(selected: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, leaf_id): the leaves below each selected section; a leaf stands for itself."""
    below = chunks.where("level = 'L2' and parent_id is not null").select(F.col("parent_id").alias("chunk_id"), F.col("chunk_id").alias("_leaf"))
    return selected.select("query_id", "chunk_id").join(below, "chunk_id", "left").select("query_id", "chunk_id", F.coalesce("_leaf", "chunk_id").alias("leaf_id"))


def refusal(near: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, answer): what is said instead of an answer, with the three nearest chunks (query_id, rank, title, label)."""
    label = F.concat(F.lit("— "), F.coalesce("title", F.lit(UNTITLED)), F.when(F.col("label") != "", F.concat(F.lit(", "), "label")).otherwise(""))
    lists = near.where("rank <= 3").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", label.alias("line")))).getField("line").alias("lines"))
    lines = F.when(F.size("lines") > 0, F.concat(F.array(F.lit(REFUSAL[0]), F.lit(REFUSAL[1])), F.col("lines"), F.array(F.lit(REFUSAL[2])))).otherwise(F.array(F.lit(REFUSAL[0])))
    return queries.select("query_id").join(lists, "query_id", "left").select("query_id", F.array_join(lines, "\n").alias("answer"))


def markers(answers: DataFrame) -> DataFrame:
    """(message_id, place, ordinal): the numbers that an answer (message_id, content) cites, in order of first appearance."""
    groups = F.regexp_extract_all("content", F.lit(MARKER), F.lit(1))
    numbers = F.array_distinct(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda n: F.trim(n).cast("int")))
    return answers.select("message_id", F.posexplode(numbers).alias("place", "ordinal"))


def resolve_citations(answers: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, citations, unresolved): answers with unknown markers taken out, their citations in order, and the unknown markers.

    evidence: message_id, ordinal and what a citation shows. Cleaned texts have no blank before punctuation and no double blanks.
    """
    cited = markers(answers)
    known = evidence.select("message_id", "ordinal").distinct().withColumn("_known", F.lit(True))
    judged = cited.join(known, ["message_id", "ordinal"], "left")
    unresolved = judged.where("_known is null").select("message_id", F.concat(F.lit("["), F.col("ordinal").cast("string"), F.lit("]")).alias("marker"))
    citations = judged.where("_known").drop("_known").join(evidence, ["message_id", "ordinal"])
    lists = known.groupBy("message_id").agg(F.collect_set("ordinal").alias("_all"))
    rows = answers.join(lists, "message_id", "left").withColumn("_all", F.coalesce("_all", F.array().cast("array<int>")))
    # the pieces between markers, each behind the markers of it that are known
    pieces = F.split("content", MARKER)
    groups = F.regexp_extract_all("content", F.lit(MARKER), F.lit(1))
    kept = F.transform(groups, lambda g: F.array_join(F.transform(F.filter(F.transform(F.split(g, ","), lambda n: F.trim(n).cast("int")), lambda n: F.array_contains(F.col("_all"), n)), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ""))
    text = F.array_join(F.flatten(F.zip_with(pieces, kept, lambda p, k: F.array(p, F.coalesce(k, F.lit(""))))), "")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\s+([,.;:!?…»])", "$1"), r"[ \t]{2,}", " "), r"[ \t]+\n", "\n")
    texts = rows.select("message_id", F.regexp_replace(text, r"^\s+|\s+$", "").alias("content"))
    return texts, citations, unresolved


def merge_citations(citations: DataFrame) -> DataFrame:
    """Citations (message_id, document_id, ordinal, page_from, page_to) of a document merged where their pages overlap or touch, under the least number."""
    doc = Window.partitionBy("message_id", "document_id").orderBy(F.col("page_from").asc_nulls_last(), "ordinal")
    before = F.max("page_to").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((before + 1 < F.col("page_from")).cast("int"), F.lit(1))
    runs = citations.withColumn("_new", new).withColumn("_run", F.sum("_new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("message_id", "document_id", "_run").agg(F.min("ordinal").alias("ordinal"), F.min("page_from").alias("page_from"), F.max(F.coalesce("page_to", "page_from")).alias("page_to")).drop("_run")


def citation_validity(messages: DataFrame, unresolved: DataFrame, include_abstained: bool = False) -> DataFrame:
    """One row over the assistant's messages (message_id, role, content, abstained): how many markers were given, and how many led nowhere.

    Unknown markers are no longer in the texts, so the given ones are those in the texts and the rows of unresolved (message_id).
    """
    own = messages.where("role = 'assistant'")
    own = own if include_abstained else own.where(~F.coalesce("abstained", F.lit(False)))
    single = F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"\[(\d{1,3})\]"), F.lit(1)))
    lost = unresolved.groupBy("message_id").agg(F.count(F.lit(1)).alias("lost"))
    rows = own.select("message_id", F.size(single).alias("shown")).join(lost, "message_id", "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    out = rows.agg(F.count(F.lit(1)).alias("messages"), F.coalesce(F.sum(F.col("shown") + F.col("lost")), F.lit(0)).alias("emitted"), F.coalesce(F.sum("lost"), F.lit(0)).alias("unresolved"), F.count_if(F.col("lost") > 0).alias("messages_with_unresolved"), F.count_if(F.col("shown") == 0).alias("uncited_messages"))
    share = lambda x: F.when(F.col("emitted") > 0, x / F.col("emitted"))
    return out.withColumns({"valid_ratio": share(F.col("emitted") - F.col("unresolved")), "hallucinated_ratio": share(F.col("unresolved"))})


def sentences(text: Column) -> Column:
    """The sentences of a text, as an array: word by word, one ends where a word ends in . ! ? or … and the next word may open one.

    A word that is an abbreviation or a number before its full stop ends none.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s\p{Z}]+"), lambda w: w != "")
    bare = lambda w: F.lower(F.regexp_replace(F.regexp_replace(w, r"\.+$", ""), '^[«»"()]+|[«»"()]+$', ""))
    goes_on = lambda w: bare(w).isin(ABBREVIATIONS) | bare(w).rlike(r"^\d+$")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, word: Column) -> Column:
        ended = state["open"].rlike(ENDING) & word.rlike(OPENING) & ~goes_on(F.substring_index(state["open"], " ", -1))
        longer = F.struct(state["done"].alias("done"), F.when(state["open"] == "", word).otherwise(F.concat_ws(" ", state["open"], word)).alias("open"))
        return F.when(ended, F.struct(F.concat(state["done"], F.array(state["open"])).alias("done"), word.alias("open"))).otherwise(longer)

    return F.aggregate(words, start, step, lambda s: F.filter(F.concat(s["done"], F.array(s["open"])), lambda x: x != ""))


def claims(answers: DataFrame, least: int = 12) -> DataFrame:
    """(message_id, claim_no, claim) of answers (message_id, content): sentences of `least` characters or more, counted from 0."""
    long_enough = F.filter(sentences(F.col("content")), lambda c: F.length(c) >= least)
    return answers.select("message_id", F.posexplode(long_enough).alias("claim_no", "claim"))


def lexical_verdicts(claimed: DataFrame, evidence: DataFrame, threshold: float = 0.5) -> DataFrame:
    """claimed (message_id, claim) with verdict (YES, PARTLY, NO, UNKNOWN), score and cited, by shared words and numbers with the message's evidence.

    Half of the claim's words have to be in the evidence (message_id, text); numbers that aren't there make it partly so.
    """
    pool = evidence.groupBy("message_id").agg(F.flatten(F.collect_list(T.content_words(F.col("text")))).alias("_words"), F.flatten(F.collect_list(T.numbers(F.col("text")))).alias("_numbers"))
    bare = F.regexp_replace("claim", r"\[(\d{1,3})\]", " ")
    rows = claimed.join(pool, "message_id", "left").withColumns({"_w": T.content_words(bare), "_n": T.numbers(bare)})
    none = F.array().cast("array<string>")
    overlap = F.when(F.size("_w") > 0, F.size(F.array_intersect("_w", F.coalesce("_words", none))) / F.size("_w")).otherwise(0.0)
    fits = F.size(F.array_except("_n", F.coalesce("_numbers", none))) == 0
    verdict = F.when((F.size("_w") == 0) & (F.size("_n") == 0), "UNKNOWN").when((overlap >= threshold) & fits, "YES").when(overlap >= threshold, "PARTLY").otherwise("NO")
    rows = rows.withColumns({"verdict": verdict, "cited": F.regexp_extract_all("claim", F.lit(r"\[(\d{1,3})\]"), F.lit(1))})
    score = F.when(F.col("verdict") == "YES", 1.0).when(F.col("verdict") == "PARTLY", 0.5).otherwise(0.0)
    return rows.withColumn("score", score).drop("_w", "_n", "_words", "_numbers")


def groundedness(verdicts: DataFrame) -> DataFrame:
    """(message_id, claims, supported, uncited, groundedness): means over a message's judged claims."""
    return verdicts.groupBy("message_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("verdict") == "YES").alias("supported"), F.count_if(F.size("cited") == 0).alias("uncited"), F.avg("score").alias("groundedness"))
