"""Turning texts into elements, chunks, page spans and labels."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.pages import references
from lectern.session import dealt, ship
from lectern.staging import staged

#: Characters of a leaf: its target, the soft and the hard most, the least; the most of a section; and what leaves cut by force share.
TARGET, SOFT, HARD, LEAST, SECTION, OVERLAP = 1400, 2200, 3600, 250, 6000, 300
#: Headings of a run, about: what one task nests at a time.
RUN = 50_000
#: Kinds of elements that are never cut, but for tables between their rows.
ATOMIC = ("table", "code")
_HEADING = re.compile(r"(#{1,6})\s+(.*)")


def elements(text: str | None) -> list[tuple[str, int, str]]:
    """(kind, heading level, text) of a Markdown text: headings, fences, tables, lists, paragraphs."""
    out: list[tuple[str, int, list[str]]] = []
    fenced = False
    for line in (text or "").split("\n"):
        bare = line.strip()
        if bare.startswith("```"):
            if fenced:
                out[-1][2].append(line)
            else:
                out.append(("code", 0, [line]))
            fenced = not fenced
            continue
        if fenced:
            out[-1][2].append(line)
            continue
        heading = _HEADING.fullmatch(bare)
        kind = "heading" if heading else "blank" if not bare else "table" if bare.startswith("|") and bare.endswith("|") and len(bare) > 1 else "list" if re.match(r"([-*+]|\d+[.)])\s", bare) else "paragraph"
        if heading:
            out.append((kind, len(heading[1]), [heading[2]]))
        elif out and out[-1][0] == kind and kind != "blank":
            out[-1][2].append(line)
        else:
            out.append((kind, 0, [line]))
    return [(k, n, "\n".join(t)) for k, n, t in out if k != "blank"]


def split_text(text: str, limit: int = SOFT) -> list[str]:
    """Pieces of at most limit characters, each cut behind the coarsest of paragraph, line, sentence, word in reach; else hard."""
    out, rest = [], text
    while len(rest) > limit:
        cuts = [(rest.rfind(mark, 1, limit), len(mark)) for mark in ("\n\n", "\n", ". ", " ")]
        cut = next((at + size for at, size in cuts if at > 0), min(limit, TARGET))
        out.append(rest[:cut].rstrip())
        rest = rest[cut:]
    return [p for p in (*out, rest) if p.strip()]


def overlapped(parts: list[str]) -> list[str]:
    """Parts of one text cut by force, each behind the last words of the one before."""
    tails = [p[-OVERLAP:].partition(" ")[2] or p[-OVERLAP:] for p in parts[:-1]]
    return [*parts[:1], *[f"{t.strip()} {p}".strip() for t, p in zip(tails, parts[1:], strict=True)]]


def table_parts(text: str) -> list[str]:
    """A table cut between its rows only."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        if out[-1] and sum(len(x) + 1 for x in out[-1]) + len(line) + 1 > SOFT:
            out.append([])
        out[-1].append(line)
    return ["\n".join(x) for x in out]


def leaves_of(units: list[tuple[str, str]]) -> list[str]:
    """The leaves of a section's units (kind, text): packed to the target, the small and those of headings only merged into neighbours."""
    packed: list[list[str]] = [[]]
    for kind, text in units:
        size = sum(len(t) + 2 for t in packed[-1])
        if len(text) > (HARD if kind in ATOMIC else SOFT):
            parts = table_parts(text) if kind == "table" else [text] if kind in ATOMIC else overlapped(split_text(text))
            packed += [*[[p] for p in parts], []]
        else:
            if packed[-1] and size + len(text) + 2 > SOFT:
                packed.append([])
            packed[-1].append(text)
            if sum(len(t) + 2 for t in packed[-1]) >= TARGET:
                packed.append([])
    out: list[str] = []
    for text in ("\n\n".join(p) for p in packed if p):
        if out and small(text) and len(out[-1]) + len(text) + 2 <= HARD:
            out[-1] += "\n\n" + text
        else:
            out.append(text)
    if len(out) > 1 and small(out[0]) and len(out[0]) + len(out[1]) + 2 <= HARD:
        out[:2] = ["\n\n".join(out[:2])]
    return out


def small(text: str) -> bool:
    """A text below the least size, or of short lines that no sentence ends."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    return len(text) < LEAST or all(len(x) <= 80 and x[-1] not in ".:;!?" for x in lines)


def path_of(titles: list[str]) -> str:
    return "//" + "".join(t.strip().replace("/", "∕") + "//" for t in titles if t.strip())


def chunk_rows(document_id: int, text: str | None, title: str = "") -> list[dict]:
    """The chunks of a document: its card (L0), all sections (L1), then all leaves (L2), so that leaves are numbered without gaps.

    A section is what stands below a heading, its path the headings above by level; sections beyond SECTION characters are cut between
    units. parent is an ordinal, sibling a leaf's place in its section. A null or blank text has no chunks.
    """
    sections: list[tuple[str, list[tuple[str, str]]]] = [("//", [])]
    path: list[tuple[int, str]] = []
    parts = elements(text)
    for kind, level, body in parts:
        if kind == "heading":
            path = [(n, t) for n, t in path if n < level] + [(level, body)]
            sections.append((path_of([t for _, t in path]), []))
        elif body.strip():
            unit, units = (kind, body.strip()), sections[-1][1]
            if units and sum(len(t) + 2 for _, t in units) + len(unit[1]) + 2 > SECTION:
                sections.append((sections[-1][0], [unit]))
            else:
                units.append(unit)
    sections = [s for s in sections if s[1]]
    if not sections:
        return []
    heads = [b.strip() for k, _, b in parts if k == "heading" and b.strip()][:30]
    first = next((b.strip() for k, _, b in parts if k == "paragraph" and len(b.strip()) > 80), "")
    card = "\n".join(x for x in (f"Документ: {title}", "Зміст: " + "; ".join(heads) if heads else "", first[:400]) if x)
    leaves = [(n, p, i, len(own), t) for n, (p, units) in enumerate(sections, 1) for own in [leaves_of(units)] for i, t in enumerate(own)]
    rows = [("L0", None, "//", card, 0, 1), *[("L1", 0, p, "\n\n".join(t for _, t in units), 0, 1) for p, units in sections], *[("L2", n, p, t, i, size) for n, p, i, size, t in leaves]]
    return [dict(zip(("document_id", "ordinal", "level", "parent", "header_path", "text", "sibling", "siblings"), (document_id, k, *r), strict=True)) for k, r in enumerate(rows)]


def chunk_tree(docs: DataFrame, key: str = "doc_id", title: str | None = None) -> DataFrame:
    """The chunks of docs, as retrieve takes them: sequential within a document, parallel across them.

    chunk_id and parent_id are hashes of document and ordinal (a card and its sections have no parent section: a section's parent is the card, a leaf's
    its section), chunk_uid is one of the text too; simhash is that of a leaf's words, null for sections and cards; refs tells the pictures, tables and
    formulas of a chunk's text.
    """
    ship(docs.sparkSession)
    columns = ["document_id", "ordinal", "level", "parent", "header_path", "text", "sibling", "siblings"]

    def run(frames):
        for pdf in frames:
            rows = [r for d, t, n in zip(pdf["document_id"], pdf["text"], pdf["title"], strict=True) for r in chunk_rows(d, t, n)]
            out = pd.DataFrame(rows, columns=columns)
            out["parent"] = out["parent"].astype("Int64")
            yield out

    named = F.coalesce(F.col(title), F.lit("")) if title else F.lit("")
    tree = dealt(docs.select(F.col(key).alias("document_id"), "text", named.alias("title"))).mapInPandas(run, "document_id long, ordinal int, level string, parent long, header_path string, text string, sibling int, siblings int")
    tree = tree.withColumn("text", T.sanitize_display(F.col("text")))
    number = lambda ordinal: F.xxhash64("document_id", ordinal)
    uid = F.substring(F.sha2(F.concat_ws("\x1f", F.col("document_id").cast("string"), F.col("ordinal").cast("string"), "text"), 256), 1, 32)
    return tree.withColumns({
        "chunk_id": number(F.col("ordinal").cast("long")),
        "parent_id": F.when(F.col("parent").isNotNull(), number(F.col("parent").cast("long"))),
        "chunk_uid": uid,
        "simhash": F.when(F.col("level") == "L2", T.simhash(T.tokens(F.col("text")))),
        "refs": references(F.col("text")),
    })


def char_spans(pages: DataFrame, key: str, order: str, text: str, gap: int = 2) -> DataFrame:
    """char_from and char_to of each page in its document's joined text."""
    size = F.coalesce(F.length(text), F.lit(0))
    end = F.sum(size + gap).over(Window.partitionBy(key).orderBy(order))
    return pages.withColumn("char_to", (end - gap).cast("long")).withColumn("char_from", (F.col("char_to") - size).cast("long"))


def label_offset(pages: DataFrame, key: str, number: str, label: str, least: int = 5, agreement: float = 0.8) -> DataFrame:
    """The offset printed label - page number that at least `agreement` of at least `least` pages have; the smaller of equals."""
    counts = pages.where(F.col(label).isNotNull()).groupBy(key, (F.col(label) - F.col(number)).alias("page_offset")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.sum("n").alias("samples"), F.max_by("page_offset", F.struct("n", -F.col("page_offset"))).alias("page_offset"), F.max("n").alias("agree"))
    return best.where((F.col("samples") >= least) & (F.col("agree") >= agreement * F.col("samples")))


def header_offset(headers: DataFrame, least: int = 5, agreement: float = 0.8) -> DataFrame:
    """(document_id, page_offset, confidence): label_offset where a page's header (document_id, page, header) may hold several numbers, Arabic or Roman."""
    numbers = F.filter(F.transform(F.regexp_extract_all("header", F.lit(r"\d{1,4}"), F.lit(0)), lambda x: x.cast("int")), lambda x: x > 0)
    found = F.array_distinct(F.concat(numbers, F.filter(F.array(T.from_roman(F.col("header")).cast("int")), lambda x: x.isNotNull())))
    each = headers.select("document_id", "page", F.explode(found).alias("label")).distinct()
    pages = each.groupBy("document_id").agg(F.count_distinct("page").alias("samples"))
    counts = each.groupBy("document_id", (F.col("label") - F.col("page")).alias("page_offset")).agg(F.count_distinct("page").alias("agree"))
    best = counts.groupBy("document_id").agg(F.max_by(F.struct("page_offset", "agree"), F.struct("agree", -F.col("page_offset"))).alias("b")).select("document_id", "b.*")
    return best.join(pages, "document_id").where((F.col("samples") >= least) & (F.col("agree") >= agreement * F.col("samples"))).select("document_id", "page_offset", (F.col("agree") / F.col("samples")).alias("confidence"))


def range_labels(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """(document_id, page, label): of each page (from 1) the printed label of the last range (document_id, start from 0, style, prefix, first) that begins at or before it."""
    marks = ranges.select("document_id", (F.col("start") + 1).alias("page"), F.struct((F.col("start") + 1).alias("at"), "style", "prefix", F.coalesce("first", F.lit(1)).alias("first")).alias("range"))
    both = pages.select("document_id", "page", F.lit(None).cast(marks.schema["range"].dataType).alias("range"), F.lit(1).alias("asked")).unionByName(marks.withColumn("asked", F.lit(0)))
    last = F.last("range", ignorenulls=True).over(Window.partitionBy("document_id").orderBy("page", "asked"))
    rows = both.withColumn("r", last).where("asked = 1 and r is not null")
    return rows.select("document_id", "page", T.page_label(F.col("r.style"), F.col("r.prefix"), F.col("r.first") + F.col("page") - F.col("r.at")).alias("label"))


def resolved_labels(pages: DataFrame, listed: DataFrame, offsets: DataFrame) -> DataFrame:
    """(document_id, page, label, source): a page's listed label, else its number moved by its document's offset, else its number."""
    rows = pages.select("document_id", "page").join(listed.select("document_id", "page", "label"), ["document_id", "page"], "left").join(offsets.select("document_id", "page_offset"), "document_id", "left")
    moved = F.when(F.col("page") + F.col("page_offset") > 0, (F.col("page") + F.col("page_offset")).cast("string"))
    source = F.when(F.col("label").isNotNull(), "page_labels").when(moved.isNotNull(), "header_regression").otherwise("physical")
    return rows.select("document_id", "page", F.coalesce("label", moved, F.col("page").cast("string")).alias("label"), source.alias("source"))


def page_of(offsets: DataFrame, pages: DataFrame) -> DataFrame:
    """offsets (document_id, offset) with the page (document_id, page, char_from) that holds each: the last that begins at or before it."""
    marks = pages.select("document_id", F.col("char_from").alias("offset"), "page", F.lit(0).alias("_asked"))
    both = offsets.select("document_id", "offset", F.lit(None).cast(marks.schema["page"].dataType).alias("page"), F.lit(1).alias("_asked")).unionByName(marks)
    order = Window.partitionBy("document_id").orderBy("offset", "_asked", "page")
    return both.withColumn("page", F.last("page", ignorenulls=True).over(order)).where("_asked = 1").drop("_asked")


def _nested(headings: pa.Table, outside: pa.Table) -> pa.Table:
    """One run of a document's headings (part of nested_sets), with those of other runs that may hold one of its own or end it."""
    rows = sorted(headings.select(["place", "level", "title"]).to_pylist(), key=lambda r: [(v is not None, v) for v in (r["place"], r["level"], r["title"])])
    edges = [] if outside.num_rows == 0 else outside.to_pylist()
    before, total = (edges[0]["before"], edges[0]["total"]) if edges else (0, len(rows))
    open_, ends = [], [total] * len(rows)  # open_: (level, place, own number or None), levels rise
    for e in sorted((e for e in edges if e["last_i"] is not None), key=lambda e: e["last_i"]):
        while open_ and open_[-1][0] >= e["edge"]:
            open_.pop()
        open_.append((e["edge"], e["last_place"], None))
    above = []
    for k, r in enumerate(rows):
        if r["level"] is None:  # is below none, holds all behind it, and is above none
            above.append((0, None))
            continue
        while open_ and open_[-1][0] >= r["level"]:
            own = open_.pop()[2]
            if own is not None:
                ends[own] = before + k
        above.append((len(open_), open_[-1][1] if open_ else None))
        open_.append((r["level"], r["place"], k))
    later = [(e["edge"], e["next_i"]) for e in edges if e["next_i"] is not None]
    for level, _, own in open_:
        if own is not None:
            ends[own] = min((i for x, i in later if x <= level), default=total)
    lft = [2 * (before + k) + 1 - d for k, (d, _) in enumerate(above)]
    new = {"parent_place": [p for _, p in above], "lft": lft, "rgt": [x + 2 * (end - before - k - 1) + 1 for k, (x, end) in enumerate(zip(lft, ends, strict=True))]}
    names = headings.schema
    own = {c: pa.array([r[c] for r in rows], names.field(c).type) for c in ("place", "level", "title")}
    return pa.table({"document_id": headings["document_id"], **own, **{c: pa.array(v, pa.int64()) for c, v in new.items()}})


def nested_sets(headings: DataFrame) -> DataFrame:
    """headings (document_id, place, level, title) with lft, rgt and parent_place: each holds those below it until one of its level or a higher one.

    With i the place among a document's headings and d the number of its ancestors, lft is 2 i - 1 - d, and rgt follows from the
    headings in between. Headings are dealt out by ranges of some RUN and written, so that a long document lies in several runs; of all other runs
    a run needs only each level's last heading before it and its first one behind it.
    """
    ship(headings.sparkSession)
    rows = headings.select("document_id", "place", "level", "title")
    parts = max(1, -(-rows.count() // RUN))
    dealt_ = rows.repartitionByRange(parts, "document_id", "place", "level", "title")
    ranged = staged(dealt_.withColumn("part", F.spark_partition_id()), "headings")
    run = Window.partitionBy("document_id", "part").orderBy("place", "level", "title")
    placed = ranged.select("document_id", "part", "place", "level", F.row_number().over(run).cast("long").alias("k"))
    levels = placed.groupBy("document_id", "part", "level").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_k"), F.max(F.struct("k", "place")).alias("last"))  # a row for each level of a run
    document = Window.partitionBy("document_id")
    before = F.coalesce(F.sum("n").over(document.orderBy("part").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = levels.withColumns({"before": before, "total": F.sum("n").over(document)})
    last = F.struct((F.col("before") + F.col("last.k") - 1).alias("i"), F.col("last.place").alias("place"))
    marks = levels.where("level is not null").select("document_id", "part", "level", last.alias("last"), (F.col("before") + F.col("first_k") - 1).alias("first_i"))
    runs, known = levels.select("document_id", "part", "before", "total").distinct(), marks.select("document_id", "level").distinct()
    each = runs.alias("r").join(known.alias("l"), F.expr("r.document_id <=> l.document_id"), "left").select("r.*", "l.level")
    each = each.alias("e").join(marks.alias("m"), F.expr("e.document_id <=> m.document_id and e.part = m.part and e.level = m.level"), "left").select("e.*", "m.last", "m.first_i")
    of_level = Window.partitionBy("document_id", "level").orderBy("part")
    behind = Window.partitionBy("document_id", "level").orderBy(F.desc("part"))
    each = each.select("document_id", "part", "before", "total", "level", F.max("last").over(of_level.rowsBetween(Window.unboundedPreceding, -1)).alias("last"), F.min("first_i").over(behind.rowsBetween(Window.unboundedPreceding, -1)).alias("next_i"))
    edges = each.select(F.col("document_id").alias("d"), F.col("part").alias("p"), "before", "total", F.col("level").alias("edge"), F.col("last.i").alias("last_i"), F.col("last.place").alias("last_place"), "next_i")
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", parent_place long, lft long, rgt long"
    return ranged.groupBy("document_id", "part").cogroup(edges.groupBy("d", "p")).applyInArrow(_nested, schema).select("document_id", "place", "level", "title", "parent_place", "lft", "rgt")


def chapter_of(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """chunks with the chapter_id whose title is the last of their header_path; the last chapter of a title wins."""
    last = chapters.groupBy("document_id", F.trim("title").alias("_title")).agg(F.max_by("chapter_id", "lft").alias("chapter_id"))
    titles = F.filter(F.split("header_path", "/"), lambda t: t != "")
    return chunks.withColumn("_title", F.replace(F.when(F.size(titles) > 0, F.element_at(titles, -1)), F.lit("∕"), F.lit("/"))).join(last, ["document_id", "_title"], "left").drop("_title")


def text_pages(docs: DataFrame, key: str = "doc_id", size: int = 1800) -> DataFrame:
    """(document_id, page, text, char_from, char_to): a text's pages, at its form feeds if it has any, else of `size` characters."""
    text = F.coalesce("text", F.lit(""))
    count = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    cut = F.when(F.contains(text, F.lit("\f")), F.split(text, "\f")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * size + 1, F.lit(size))))
    long = lambda s: F.length(s).cast("long")
    none = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<text: string, char_from: bigint, char_to: bigint>>)").alias("pages"))
    placed = F.aggregate(cut, none, lambda s, x: F.struct((s["at"] + long(x)).alias("at"), F.concat(s["pages"], F.array(F.struct(x.alias("text"), s["at"].alias("char_from"), (s["at"] + long(x)).alias("char_to")))).alias("pages")))
    pages = docs.select(F.col(key).alias("document_id"), F.posexplode(placed["pages"]).alias("n", "p"))
    return pages.select("document_id", (F.col("n") + 1).alias("page"), "p.text", "p.char_to", "p.char_from")


def probe(pages: DataFrame, bitmap=None, lexicon=None, pictures=None) -> DataFrame:
    """pages with what their text tells: characters, ratios, table and formula, class, mode of recognition and cost."""
    zero = F.lit(0.0)
    rows = pages.withColumns({"chars": F.length(F.regexp_replace("text", r"^\s+|\s+$", "")), "cyrillic": T.cyrillic_ratio(F.col("text")), "mojibake": T.mojibake_ratio(F.col("text")), "has_table": T.looks_like_table(F.col("text")), "has_formula": T.looks_like_formula(F.col("text"))})
    bitmap, lexicon, pictures = bitmap if bitmap is not None else zero, lexicon if lexicon is not None else F.lit(None).cast("double"), pictures if pictures is not None else F.lit(0)
    rows = rows.withColumn("page_class", T.page_class(F.col("chars"), bitmap, F.col("mojibake"), F.col("cyrillic"), lexicon))
    return rows.withColumns({"ocr_mode": T.ocr_mode(F.col("page_class"), F.col("chars"), bitmap), "cost": T.cost_weight(T.is_scan(F.col("page_class")), F.col("has_table"), F.col("has_formula"), pictures)})


def document_classes(pages: DataFrame) -> DataFrame:
    """(document_id, dominant, scanned_share, total_cost) of probed pages; of equally frequent classes the one that comes first."""
    per = pages.groupBy("document_id", "page_class").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("first"), F.sum("cost").alias("cost"))
    return per.groupBy("document_id").agg(F.max_by("page_class", F.struct("n", -F.col("first"))).alias("dominant"), (F.sum(F.when(T.is_scan(F.col("page_class")), F.col("n")).otherwise(0)) / F.sum("n")).alias("scanned_share"), F.sum("cost").alias("total_cost"))


def document_quality(pages: DataFrame) -> DataFrame:
    """(document_id, score, grade): the tenth part from below of a document's page scores, the worst of fewer than ten pages."""
    lists = pages.where("score is not null").groupBy("document_id").agg(F.sort_array(F.collect_list("score")).alias("s"))
    at = F.when(F.size("s") >= 10, F.greatest(F.lit(0), F.floor(F.size("s") * 0.1) - 1)).otherwise(0).cast("int")
    return lists.select("document_id", F.get("s", at).alias("score")).withColumn("grade", T.quality_grade(F.col("score")))


def page_grades(pages: DataFrame) -> DataFrame:
    """(grade, pages): pages by the worst of their four scores that there are."""
    worst = F.least("parse_score", "layout_score", "table_score", "ocr_score")
    return pages.select(F.when(worst.isNull(), "UNKNOWN").otherwise(T.quality_grade(worst)).alias("grade")).groupBy("grade").agg(F.count(F.lit(1)).alias("pages"))


def page_windows(pages: DataFrame, size: int = 25, shift: int = 3) -> DataFrame:
    """(document_id, first, last): windows of pages (document_id, page, has_table); an end moves back by up to `shift` pages so that no table is cut."""
    ship(pages.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tables, last, out, first = set(pdf.loc[pdf["has_table"].fillna(False).astype(bool), "page"]), int(pdf["page"].max()), [], 1
        while first <= last:
            end = min(first + size - 1, last)
            moved = [e for e in range(end, max(first, end - shift - 1), -1) if not {e, e + 1} <= tables]
            end = moved[0] if moved and end < last else end
            out.append((pdf["document_id"].iloc[0], first, end))
            first = end + 1
        return pd.DataFrame(out, columns=["document_id", "first", "last"])

    kind = pages.schema["document_id"].dataType.simpleString()
    return pages.groupBy("document_id").applyInPandas(run, f"document_id {kind}, first int, last int")


def table_triplets(grid):
    """A grid (array of rows, the first one its header) as self-describing lines: row title, column, value."""
    header = F.get(grid, F.lit(0))
    rows = F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(1)))
    cell = lambda row: F.zip_with(header, row, lambda h, v: F.concat_ws(": ", h, v))
    return F.when(F.size(grid) > 1, F.array_join(F.transform(rows, lambda r: F.array_join(cell(r), "; ")), "\n")).otherwise("")


def neighbours(chunks: DataFrame, centres: DataFrame, reach: int) -> DataFrame:
    """Chunks within `reach` places of each centre (document_id, ordinal) of the same document: equality plus a band."""
    c = centres.select("document_id", F.col("ordinal").alias("centre"))
    near = c.withColumn("ordinal", F.explode(F.sequence(F.col("centre") - reach, F.col("centre") + reach)))
    return chunks.join(near, ["document_id", "ordinal"])


def subtree(chapters: DataFrame, roots: DataFrame) -> DataFrame:
    """Descendants of each root (document_id, lft, rgt) in nested sets, itself included."""
    r = roots.select(F.col("document_id").alias("d"), F.col("lft").alias("l"), F.col("rgt").alias("r"), F.col("chapter_id").alias("root_id"))
    return chapters.join(r, (F.col("document_id") == F.col("d")) & F.col("lft").between(F.col("l"), F.col("r"))).select("root_id", "chapter_id")


def reusable(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, source_id): documents whose content an earlier one has, with the earliest of them."""
    digest = docs.where(F.col(text).isNotNull()).select(key, F.sha2(text, 256).alias("digest"))
    first = digest.groupBy("digest").agg(F.min(key).alias("source_id"))
    return digest.join(first, "digest").where(F.col(key) != F.col("source_id")).select(key, "source_id")


def merge_page_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges (page_from, page_to) of each key merged where they overlap or touch."""
    before = Window.partitionBy(*keys).orderBy("page_from", "page_to").rowsBetween(Window.unboundedPreceding, -1)
    new = (F.coalesce(F.max("page_to").over(before) + 1, F.lit(-1)) < F.col("page_from")) | F.max("page_to").over(before).isNull()
    run = F.sum("new").over(Window.partitionBy(*keys).orderBy("page_from", "page_to").rowsBetween(Window.unboundedPreceding, 0))
    return ranges.withColumn("new", new.cast("int")).withColumn("run", run).groupBy(*keys, "run").agg(F.min("page_from").alias("page_from"), F.max("page_to").alias("page_to")).drop("run")
