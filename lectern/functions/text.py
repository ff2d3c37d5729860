"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a word is, and the blocks that count as Cyrillic.
TOKEN = r"[\p{L}\p{N}]+(?:['\-][\p{L}\p{N}]+)*"
#: Marks of glyphs that extraction could not map, and characters that only broken text has.
GLYPH, BROKEN = r"/glyph<[^>]{0,16}>|/g\d+", r"[\x{FFFD}\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}\x00-\x08\x0B\x0E-\x1F]"
QUOTES, STANDARDS = '"«»„“”', r"ДСТУ|ГОСТ|ТУ|ДБН|ISO|IEC|EN|STANAG|MIL[-\s]?STD|NATO|НАТО"
#: Mathematical signs.
MATHS = "∑∫√±×÷≈≤≥≠∞∂∇°⋅·αβγδεθλμνπρστφχψωΔΩΣΠ"
#: Words that any two sentences may share.
COMMON = "який яка яке які цей цього цієї той тому тобто його їхній може мають має бути було буде також щодо після перед через разом тільки лише дуже згідно відповідно наведені матеріали матеріалів".split()
CYRILLIC = r"[\x{0400}-\x{052F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}]"


def tokens(text: Column) -> Column:
    """Lower-cased words; apostrophes and hyphens stay inside a word."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def with_compound_parts(words: Column) -> Column:
    """Each hyphenated word is followed by its parts of three or more characters that are not digits."""
    parts = lambda w: F.filter(F.split(w, "-"), lambda p: (F.length(p) >= 3) & ~p.rlike(r"^\d+$"))
    return F.flatten(F.transform(words, lambda w: F.when(F.contains(w, F.lit("-")), F.array_distinct(F.concat(F.array(w), parts(w)))).otherwise(F.array(w))))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: inside of a lambda an expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def char_ngrams(text: Column, least: int = 3, most: int = 5) -> Column:
    """All character n-grams of a text between spaces, with repeats."""

    def of(padded: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1)))
        return F.when(F.length(padded) >= n, F.transform(places, lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return bound(F.concat(F.lit(" "), text, F.lit(" ")), lambda padded: F.concat(*[of(padded, n) for n in range(least, most + 1)]))


def word_trigrams(words: Column) -> Column:
    """What char_ngrams(words joined by spaces, 3, 3) gives, cut word by word: places in a long text are not counted from its start each time."""
    three = lambda p: F.when(F.length(p) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - 2, F.lit(1))), lambda j: F.substring(p, j, F.lit(3)))).otherwise(F.array().cast("array<string>"))

    def all_of(w: Column) -> Column:
        padded = lambda i: F.coalesce(F.concat(F.get(w, i), F.lit(" ")), F.lit(""))
        after = lambda i: F.substring(F.concat(padded(i), padded(i + 1)), 1, 2)
        own = F.transform(w, lambda x, i: F.concat(x, F.lit(" "), after(i + 1)))
        return F.flatten(F.transform(F.concat(F.array(F.concat(F.lit(" "), after(F.lit(0)))), own), three))

    return bound(words, lambda w: F.when(F.size(w) > 0, all_of(w)).otherwise(F.array().cast("array<string>")))


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def token_estimate(text: Column) -> Column:
    """Model tokens a text takes, by its words or its length, whichever says more; none for an empty text."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.when(F.length(text) > 0, F.greatest(F.floor(words * 2.35), F.floor(F.length(text) / 3.2)) + 1).otherwise(0).cast("long")


def share(text: Column, pattern: str, of: Column | None = None) -> Column:
    """Characters that match, as a share of the text's (or `of`); 0 for an empty one. Others are taken out a run at a time."""
    hits, all_ = F.length(F.regexp_replace(text, f"[^{pattern[1:]}+" if pattern.startswith("[") else pattern, "")), of if of is not None else F.length(text)
    return F.when(all_ > 0, hits / all_).otherwise(0.0)


def cyrillic_ratio(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.when(text.rlike(rf"(?=[^\x00-\x7F]){CYRILLIC}"), share(text, CYRILLIC, letters)).otherwise(0.0)  # most texts have none


def mojibake_ratio(text: Column) -> Column:
    """Share of characters that broken extraction leaves: U+FFFD, private use, control characters, and marks of unmapped glyphs."""
    marks = F.length(text) - F.length(F.regexp_replace(text, GLYPH, ""))
    signs = F.length(text) - F.length(F.regexp_replace(text, BROKEN, ""))
    return F.when(F.length(text) > 0, F.least(F.lit(1.0), (marks + signs) / F.length(text))).otherwise(0.0)


def lexical_anchor(query: Column) -> Column:
    """A query with a digit, a quotation or a name of a standard is matched by its words first."""
    return query.rlike(r"\d") | query.rlike(f"[{QUOTES}]") | F.upper(query).rlike(rf"(^|[^\p{{L}}\p{{N}}_])({STANDARDS})($|[^\p{{L}}\p{{N}}_])")


def page_class(chars: Column, bitmap: Column, mojibake: Column, cyrillic: Column, lexicon: Column) -> Column:
    """Ordered decision table for a page: its length first, then broken characters, unknown words, the share of bitmaps."""
    broken = (mojibake > 0.02) | F.coalesce((cyrillic > 0.3) & (lexicon < 0.45), F.lit(False))
    return F.when(chars < 40, F.when(bitmap >= 0.3, "SCANNED").otherwise("DIGITAL_CLEAN")).when(broken, "DIGITAL_BROKEN").when(bitmap >= 0.3, "MIXED").otherwise("DIGITAL_CLEAN")


def ocr_mode(kind: Column, chars: Column, bitmap: Column) -> Column:
    """How a page of a class is to be recognised."""
    return F.when(kind.isin("SCANNED", "DIGITAL_BROKEN"), "FULL_PAGE").when(chars < 40, "NONE").when((kind == "MIXED") & (bitmap >= 0.6), "LAYOUT_REGIONS").otherwise("DEFAULT")


def is_scan(kind: Column) -> Column:
    return kind.isin("SCANNED", "DIGITAL_BROKEN")


def needs_repair(parse: Column, layout: Column, table: Column, lexicon: Column, cyrillic: Column) -> Column:
    """A page with a low score, or whose Cyrillic words are unknown; missing measures say nothing."""
    no = F.lit(False)
    return F.coalesce(parse < 0.5, no) | F.coalesce(layout < 0.6, no) | F.coalesce(table < 0.5, no) | F.coalesce((lexicon < 0.45) & (F.coalesce(cyrillic, F.lit(0.0)) > 0.3), no)


def looks_like_table(text: Column) -> Column:
    """A mention of a table, or three lines with two gaps of columns, or with two tabs or pipes."""
    lines = F.split(text, "\n")
    gaps = F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit(r"\S {2,}(?=\S)")) >= 2))
    cells = F.size(F.filter(lines, lambda x: (F.regexp_count(x, F.lit("\t")) >= 2) | (F.regexp_count(x, F.lit(r"\|")) >= 2)))
    low = F.lower(text)
    return F.contains(low, F.lit("таблиц")) | F.contains(low, F.lit("табл.")) | (gaps >= 3) | (cells >= 3)


def looks_like_formula(text: Column) -> Column:
    low = F.lower(text)
    return F.contains(low, F.lit("формул")) | F.contains(low, F.lit("рівнянн")) | text.rlike(rf"(?=[^\x00-\x7F])[{MATHS}]")  # none of them is ASCII


def heading_only(text: Column) -> Column:
    """Short lines that no sentence ends; a blank text too."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.forall(lines, lambda x: (F.length(x) <= 80) & ~x.rlike(r"[.:;!?]$"))


def looks_like_question(text: Column) -> Column:
    """One line that ends in a question mark and is no refusal."""
    line = squeezed(text)
    return (F.length(line).between(1, 400)) & ~F.contains(F.lower(line), F.lit("недостатньо інформації")) & F.endswith(line, F.lit("?"))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cost_weight(scan: Column, table: Column, formula: Column, pictures: Column) -> Column:
    return 1 + 3 * scan.cast("int") + 2 * table.cast("int") + formula.cast("int") + 0.5 * F.least(pictures, F.lit(6))


def quality_grade(score: Column) -> Column:
    return F.when(score >= 0.9, "EXCELLENT").when(score >= 0.8, "GOOD").when(score >= 0.5, "FAIR").otherwise("POOR")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def header_path(titles: Column) -> Column:
    """Titles as one path; slashes inside of them become U+2215, an empty path is two slashes."""
    clean = F.transform(F.filter(titles, lambda t: F.trim(t) != ""), lambda t: F.replace(F.trim(t), F.lit("/"), F.lit("∕")))
    return F.when(F.size(clean) > 0, F.concat(F.lit("//"), F.array_join(clean, "//"), F.lit("//"))).otherwise("//")


def _path_titles(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda t: t != "")


def embed_text(note: Column, path: Column, text: Column) -> Column:
    """What is embedded: the note, the titles of the path, the text, each on a line of its own if not blank."""
    parts = F.array(note, F.array_join(_path_titles(path), " › "), text)
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & p.rlike(r"\S")), "\n")


def rerank_text(path: Column, text: Column) -> Column:
    """The last title and the text."""
    titles = _path_titles(path)
    return F.trim(F.concat(F.when(F.size(titles) > 0, F.element_at(titles, -1)).otherwise(""), F.lit("\n"), text), F.lit(" \n"))


def citation_label(label_from: Column, label_to: Column, page_from: Column, page_to: Column) -> Column:
    """The printed pages, else the physical ones; empty without any."""
    number = lambda p: F.when(p != 0, p.cast("string"))
    a, b = (F.coalesce(F.when(x != "", x), number(p)) for x, p in ((label_from, page_from), (label_to, page_to)))
    return F.when(a.isNull(), "").when(b.isNotNull() & (a != b), F.concat(F.lit("с. "), a, F.lit("–"), b)).otherwise(F.concat(F.lit("с. "), a))


def sanitize_display(text: Column) -> Column:
    """A text without running headers, blanks before line ends and more than one blank line."""
    clean = F.regexp_replace(text, r"(?s)<(header|footer|page_number)\b[^>]*>.*?</\1>|<page_separator\b[^>]*/>", "")
    clean = F.regexp_replace(F.regexp_replace(clean, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(clean, r"^\s+|\s+$", "")


def last_place(text: Column, mark: str) -> Column:
    """Place, from 0, of the last mark in a text; -1 without one."""
    back = F.instr(F.reverse(text), mark[::-1])
    return F.when(back > 0, F.length(text) - len(mark) - (back - 1)).otherwise(-1)


def quote(text: Column, limit: int = 320) -> Column:
    """The beginning of a text on one line, cut behind a sentence of its second half, else at a space."""
    line = squeezed(text)
    cut = F.substring(line, 1, limit)
    out = F.when(F.length(line) <= limit, line)
    for mark in (". ", "! ", "? ", "; "):
        at = last_place(cut, mark)
        out = out.when(at > limit // 2, F.substring(cut, F.lit(1), at + 1))
    space = last_place(cut, " ")
    return out.when(space > limit // 2, F.concat(F.rtrim(F.substring(cut, F.lit(1), space)), F.lit("…"))).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def trim_to_tokens(text: Column, limit: int) -> Column:
    """A text cut at a space so that it takes about `limit` tokens."""
    most = int(limit * 3.2)
    cut = F.substring(text, 1, most)
    space = last_place(cut, " ")
    short = F.when(space > most // 2, F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(token_estimate(text) <= limit, text).otherwise(F.concat(F.rtrim(short), F.lit("…")))


def chars_per_token(text: Column, sample: int = 20_000, fertility: float = 3.62) -> Column:
    """Characters that a token stands for, by the words of the first `sample` characters (the feature's own bound), from 1.2 to 4."""
    part = F.substring(text, 1, sample)
    words = F.size(F.filter(F.split(part, r"\s+"), lambda w: w != ""))
    return F.when(words > 0, F.least(F.lit(4.0), F.greatest(F.lit(1.2), F.length(part) / words / fertility))).otherwise(7.0 / fertility)


def content_words(text: Column) -> Column:
    """Distinct words of three or more letters, without those that any two sentences may share."""
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}"), F.lit(0)), F.array(*map(F.lit, COMMON)))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)))


def codes(text: Column) -> Column:
    """Designations: words of letters and digits together, as they are written."""
    return F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_-])(?=[\p{L}\p{N}_-]*\p{L})(?=[\p{L}\p{N}_-]*\p{N})[\p{L}\p{N}_-]{2,}(?![\p{L}\p{N}_-])"), F.lit(0))


def roman(n: Column) -> Column:
    """A number above 0 as lower-case Roman numerals."""
    def digit(place: int, one: str, five: str, ten: str) -> Column:
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.element_at(F.array(*map(F.lit, forms)), (F.floor(n / place) % 10 + 1).cast("int"))

    written = F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), digit(100, "c", "d", "m"), digit(10, "x", "l", "c"), digit(1, "i", "v", "x"))
    return F.when(n > 0, written).otherwise("")


def from_roman(text: Column) -> Column:
    """The number that Roman numerals of either case say; null for anything else."""
    low = F.lower(F.trim(text))
    plain = low
    for pair, spelled in (("iv", "iiii"), ("ix", "viiii"), ("xl", "xxxx"), ("xc", "lxxxx"), ("cd", "cccc"), ("cm", "dcccc")):
        plain = F.replace(plain, F.lit(pair), F.lit(spelled))
    total = sum((F.length(plain) - F.length(F.replace(plain, F.lit(c), F.lit("")))) * v for c, v in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100), ("d", 500), ("m", 1000)))
    return F.when((low != "") & low.rlike("^m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"), total)


def alpha_label(n: Column) -> Column:
    """a to z, then aa to zz, and so on."""
    return F.when(n > 0, F.repeat(F.char((F.lit(97) + (n - 1) % 26).cast("long")), (F.floor((n - 1) / 26) + 1).cast("int"))).otherwise("")


def page_label(style: Column, prefix: Column, n: Column) -> Column:
    """A printed label: its prefix and its number in style D, r, R, a or A; without style the prefix alone."""
    body = F.when(style.isNull() | (style == ""), "").when(style == "r", roman(n)).when(style == "R", F.upper(roman(n))).when(style == "a", alpha_label(n)).when(style == "A", F.upper(alpha_label(n))).otherwise(n.cast("string"))
    return F.concat(F.coalesce(prefix, F.lit("")), body)


def l2_normalised(vector: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def truncated(vector: Column, dims: int) -> Column:
    """The first dims components, normalised anew."""
    return l2_normalised(F.slice(vector, 1, dims))


def simhash(terms: Column, shingle: int = 3) -> Column:
    """64 bits that vote over the hashes of runs of `shingle` terms; 0 without terms."""
    zero = F.lit(0).cast("long")

    def runs(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(w) - shingle + 1, F.lit(1)))
        return F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(shingle)), " ")))

    def voted(hashes: Column) -> Column:
        out = zero
        for bit in range(64):
            votes = F.aggregate(hashes, F.lit(0), lambda s, h: s + F.shiftrightunsigned(h, bit).bitwiseAND(F.lit(1).cast("long")).cast("int"))
            out = out.bitwiseOR(F.when(votes * 2 > F.size(hashes), F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("long")).otherwise(zero))
        return out

    return bound(terms, lambda w: F.when(F.size(w) > 0, bound(runs(w), voted)).otherwise(zero))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rect(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """A box of page coordinates (origin at the lower left) in shares of the page from its upper left, clipped to the page."""
    share = lambda x, of: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / of))
    x0, x1, y0, y1 = share(F.least(left, right), width), share(F.greatest(left, right), width), share(height - F.greatest(top, bottom), height), share(height - F.least(top, bottom), height)
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))
