"""Removal of lines that repeat an earlier line up to a few edits, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import bounded, discard, staged

#: Into how many parts a line is cut before deletions are tried.
PARTS = 3
#: Edits that two lines may be apart: one for each so many characters of the shorter line, one at least and this many at most.
CHARS_PER_EDIT, MAX_EDITS = 20, 5
#: Widest segment of a line that is looked up, and lines with a shared segment (one long each) that are broadcast at most.
WIDEST, BROADCAST_KEYS = 64, 2_000_000
#: Lines of a segment beyond which they are compared as they are joined.
CROWD = 50
#: Characters of two lines that are compared before whole lines are.
BEGINNING = 64
#: Frequent letters, whose counts are compared before whole lines are; in other scripts they tell nothing and nothing is lost.
LETTERS = " etaoinshrоаиент"


def _row() -> Column:
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))


def lines_of(docs: DataFrame) -> DataFrame:
    """One row per line: doc_id (with the text's hash, so rows that repeat a doc_id are told apart), line_no (from 0), line.

    Null text has no lines, empty text one empty line.
    """
    return docs.select(_row().alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _digest(*cols: Column) -> list[Column]:
    return [F.xxhash64(F.lit(11), *cols), F.xxhash64(F.lit(97), *cols)]


def _part_keys(lines: DataFrame, hashed: bool = False) -> DataFrame:
    """Per line and part, the key (a, b) under which lines at edit distance at most 1 meet: what stands before and after the part.

    The cuts follow a reference length m, the line's own or one less, so that a line and the one
    with a character more use the same cuts; the longer one's part is then a character longer. Each
    stretch between cuts is taken and hashed once; keys are hashes of those hashes. Returns doc_id,
    line_no, m, less, part (its hash if hashed), a, b.
    """
    place, n = ["doc_id", "line_no"], F.length("line")
    cuts = {f"c{less}{k}": ((F.col("n") - less) * k / PARTS).cast("int") for less in (0, 1) for k in range(PARTS + 1)}
    cut = lines.select(*place, "line", n.alias("n")).select(*place, "line", "n", *[c.alias(x) for x, c in cuts.items()])

    def stretch(less: int, k: int, first: int, more: int) -> Column:
        at, end = F.col(f"c{less}{k}"), F.col(f"c{less}{k + 1}")
        return F.substring("line", at + (1 + first), end - at + more)

    # b: a stretch before the part, z: one behind it, p: the part itself; without a character to spare the three are one
    spans = {f"b0{k}": stretch(0, k, 0, 0) for k in range(PARTS)}
    spans |= {f"b1{k}": stretch(1, k, 0, 0) for k in range(PARTS - 1)} | {f"z1{k}": stretch(1, k, 1, 0) for k in range(1, PARTS)} | {f"p1{k}": stretch(1, k, 0, 1) for k in range(PARTS)}
    cut = cut.select(*place, "n", *[c.alias(x) for x, c in spans.items()])
    parts = {f"{x}p": F.xxhash64(x) if hashed else F.col(x) for x in spans if x[:2] in ("b0", "p1")}
    hashes = {f"{x}{h}": d for x in spans if x[0] != "p" for h, d in zip("ab", _digest(F.col(x)), strict=True)}
    cut = cut.select(*place, "n", *[c.alias(x) for x, c in (parts | hashes).items()])
    keys = []
    for less in (0, 1):
        m, behind, own = F.col("n") - less, "z1" if less else "b0", "p1" if less else "b0"
        for k in range(PARTS):
            around = [f"b{less}{j}" for j in range(k)] + [f"{behind}{j}" for j in range(k + 1, PARTS)]
            a, b = (F.xxhash64(m, F.lit(k), *[F.col(f"{x}{h}") for x in around]) for h in "ab")
            keys.append(F.struct(m.alias("m"), F.lit(less).alias("less"), F.col(f"{own}{k}p").alias("part"), a.alias("a"), b.alias("b")))
    return cut.select(*place, F.explode(F.array(*keys)).alias("p")).select(*place, "p.*")


def _one_edit(long: DataFrame) -> DataFrame:
    """near_lines for one edit at most, among all lines of long.

    Deletion neighbourhoods: two lines are one edit apart exactly if one is the other less a
    character, or both lose a character at the same place and agree. All such variants are emitted
    as hashed keys and joined by key, the earliest line of each key wins, and its edit distance is
    verified. Only the one part of a line in which another line with equal surroundings may differ
    is varied; a pair with at most one edit differs in one part only, so no pair is lost.
    """
    place = F.struct("doc_id", "line_no")
    # half of the key is enough to leave lines out; what meets by it alone is told apart below
    shared = _part_keys(long, hashed=True).groupBy("a").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select(F.col("a").alias("ka"))
    shared = staged(shared, "line-parts")
    near = _part_keys(long).join(bounded(shared), F.col("a") == F.col("ka"), "left_semi")
    near = near.groupBy("a", "b", "m", "less", "part").agg(F.min(place).alias("place"))  # equal lines once, at their earliest place
    near = staged(near, "line-near")
    discard(shared)
    # less = 0: the part itself (gap -1), and the part less its g-th character as a substitution at g;
    # less = 1: the part is a character longer than the cuts say, so each variant is a line without that character
    n = F.length("part")
    gaps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    cut = F.concat(F.expr("substring(part, 1, gap - 1)"), F.expr("substring(part, gap + 1)"))
    cuts = near.withColumn("gap", F.explode(gaps)).withColumn("cut", cut)
    swapped = cuts.where("less = 0").select("a", "b", F.lit("swap").alias("side"), F.concat(F.lit("s"), F.col("gap").cast("string")).alias("kind"), "cut", "place")
    shorter = cuts.where("less = 1").select("a", "b", F.lit("longer").alias("side"), F.lit("d").alias("kind"), "cut", "place")
    same = near.where("less = 0").select("a", "b", F.lit("whole").alias("side"), F.lit("d").alias("kind"), F.col("part").alias("cut"), "place")
    variants = swapped.unionByName(shorter).unionByName(same).select("a", "b", "side", *[d.alias(x) for d, x in zip(_digest(F.col("kind"), F.col("cut")), ("va", "vb"), strict=True)], "place")
    key = ["a", "b", "va", "vb"]
    # a whole part meets the earliest of the parts a character longer, those meet the whole part, and equal gaps each other
    firsts = {side: F.min(F.when(F.col("side") == side, F.col("place"))).alias(side) for side in ("swap", "longer", "whole")}
    won = variants.groupBy(*key).agg(*firsts.values(), F.max("place").alias("last"))
    won = won.where("swap <> last or (longer is not null and whole is not null)").drop("last")
    other = F.expr("case side when 'swap' then swap when 'longer' then whole else longer end")
    hits = variants.join(won, key).withColumn("other", other).where("place > other").select("a", "b", "place", "other", (F.col("side") == "longer").cast("int").alias("less"), (F.col("side") == "whole").cast("int").alias("other_less")).distinct()
    hits = staged(hits, "line-hits")
    mine = near.select("a", "b", "place", "less", F.col("part").alias("mine"))
    theirs = near.select("a", "b", F.col("place").alias("other"), F.col("less").alias("other_less"), F.col("part").alias("theirs"))
    hits = hits.join(mine, ["a", "b", "place", "less"]).join(theirs, ["a", "b", "other", "other_less"]).where(F.levenshtein("mine", "theirs", 1).between(0, 1))
    out = staged(hits.select(F.col("place").alias("hit")).distinct(), "line-one")
    discard(near)
    return out


def bound_of(n: Column, max_edits: int) -> Column:
    """Edits that the shorter line of a pair, of n characters, allows."""
    return F.least(F.lit(max_edits), F.greatest(F.lit(1), F.floor(n / CHARS_PER_EDIT).cast("int")))


def _classes(max_edits: int) -> list[tuple[int, int | None, int, int]]:
    """(least length, first length beyond or None, edits, width of a segment) of the shorter line of a pair, from two edits on."""
    out = [(CHARS_PER_EDIT * k, CHARS_PER_EDIT * (k + 1), k, CHARS_PER_EDIT * k // (k + 1)) for k in range(2, max_edits)]
    lo, top = CHARS_PER_EDIT * max_edits, max(WIDEST * (max_edits + 1), CHARS_PER_EDIT * max_edits)
    while lo < top:
        out.append((lo, min(top, lo * 3 // 2), max_edits, lo // (max_edits + 1)))
        lo = out[-1][1]
    return [*out, (top, None, max_edits, top // (max_edits + 1))]


def _segment_keys(lines: DataFrame, max_edits: int) -> DataFrame:
    """h (the hash of a line), key, whole: the hashed segments under which lines (h, line) with several edits meet.

    Of a line that allows k edits, k // 2 + 1 segments from its start and the others of k + 1 from its end are
    disjoint. A pair within k edits has either at most k // 2 of them at the start or fewer than the others are many
    at the end. On that side some segment of the one line has no edit and as many edits before it as
    segments (the first point where edits fall behind segments), so the other line holds it moved
    by at most its number. `whole` marks segments in place; the others are taken at the places they may have moved to.

    Only hashes and the two ends are exploded: a line's text is not copied for each of its keys.
    """
    classes, n = [(lo, hi, F.struct(F.lit(c).alias("c"), F.lit(k // 2).alias("front"), F.lit(k - 1 - k // 2).alias("back"), F.lit(w).alias("w")), k) for c, (lo, hi, k, w) in enumerate(_classes(max_edits))], F.col("n")
    # the class of a line's own length, and the one below if a line of that class may be the shorter one of a pair
    own, below = F.lit(None), F.lit(None)
    for lo, hi, kind, k in reversed(classes):
        own = F.when((n >= lo) & (F.lit(True) if hi is None else n < hi), kind).otherwise(own)
        below = below if hi is None else F.when((n >= hi) & (n < hi + k), kind).otherwise(below)
    rows = lines.withColumn("n", F.length("line")).where(n >= classes[0][0]).withColumn("of", F.explode(F.array(own, below))).where("of is not null")
    size = (F.col("back") + 1) * F.col("w") + F.col("back")
    rows = rows.select("h", "line", "of.*").select("h", "c", "front", "back", "w", F.substring("line", F.lit(1), (F.col("front") + 1) * F.col("w") + F.col("front")).alias("head"), F.substring("line", -size, size).alias("tail"))
    places = [(side, j, moved) for side, most in ((0, max_edits // 2), (1, (max_edits - 1) // 2)) for j in range(most + 1) for moved in range(-j, j + 1)]
    # one small expression for each exploded place, which compiles better than a row of all keys
    rows = rows.withColumn("p", F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.lit(j).alias("j"), F.lit(moved).alias("moved")) for side, j, moved in places])))
    side, j, moved, w, back = F.col("p.side"), F.col("p.j"), F.col("p.moved"), F.col("w"), F.col("back")
    rows = rows.where(j <= F.when(side == 0, F.col("front")).otherwise(back))
    at = F.when(side == 0, 1 + w * j + moved).otherwise(w * (back - j) + back + 1 - moved)
    key = F.xxhash64(F.substring(F.when(side == 0, F.col("head")).otherwise(F.col("tail")), at, w)).bitwiseXOR((F.shiftleft("c", 8) + 2 * j + side).cast("long"))
    return rows.select("h", key.alias("key"), (moved == 0).alias("whole"))


def _counts(line: Column) -> list[Column]:
    """How often each of LETTERS occurs in a line, four to a long."""
    n = [F.least((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(x), F.lit("")))) / len(x.encode()), F.lit(65535)).cast("long") for x in LETTERS]
    return [F.shiftleft(n[k], 48).bitwiseOR(F.shiftleft(n[k + 1], 32)).bitwiseOR(F.shiftleft(n[k + 2], 16)).bitwiseOR(n[k + 3]) for k in range(0, len(n), 4)]


def _few_edits(long: DataFrame, max_edits: int) -> DataFrame:
    """near_lines among lines that allow two edits or more.

    Each comparison is a job of its own: as one plan, adaptive execution would plan all of them anew after each stage.
    Segments that several distinct lines have, then the lines that have such a segment, then their texts, each line at its
    earliest place. They are first compared with the earliest line of each of their segments; only those without a
    hit are compared with all earlier lines of their segments.
    """
    keys = _segment_keys(long.select(F.xxhash64("line").alias("h"), "line"), max_edits)
    # keys are made and shuffled once: those that meet are told where they arrive
    of = Window.partitionBy("key")
    keys = keys.withColumns({"least": F.min("h").over(of), "most": F.max("h").over(of), "entire": F.max("whole").over(of)})
    met = staged(keys.where("entire and least <> most").select("h", "key", "whole").distinct(), "line-met")
    mine = met.select(F.col("h").alias("mh")).distinct()
    mine = F.broadcast(mine) if mine.count() <= BROADCAST_KEYS else mine
    place, n = F.struct("doc_id", "line_no"), F.length("line")
    near = long.withColumn("h", F.xxhash64("line")).join(mine, F.col("h") == F.col("mh"), "left_semi").groupBy("h", "line").agg(F.min(place).alias("place"))
    # lines are compared by their letters first, which are counted once; whole texts are joined only to what is left
    letters = [c.alias(f"c{k}") for k, c in enumerate(_counts(F.col("line")))]
    near = staged(near.select("h", "line", "place", n.alias("n"), *letters), "line-near")
    brief = near.select("h", F.struct("place", "n", *[f"c{k}" for k in range(len(letters))], "h").alias("own"))
    posts = staged(met.join(brief, "h").select("own", "key", "whole"), "line-posts")
    discard(met)
    firsts = posts.groupBy("key").agg(F.min("own").alias("any"), F.min(F.when(F.col("whole"), F.col("own"))).alias("entire"))

    def allowed(x: Column, y: Column) -> Column:
        return bound_of(F.least(x, y), max_edits)

    def likely(a: Column, b: Column) -> Column:
        """Whether two lines may be near: an edit changes two of the letters' counts by one at most."""
        count = lambda x, k: F.shiftrightunsigned(x[f"c{k // 4}"], 16 * (k % 4)).bitwiseAND(F.lit(65535).cast("long"))
        apart = [F.abs(count(a, k) - count(b, k)) for k in range(len(LETTERS))]
        least = allowed(a["n"], b["n"])
        return (a["place"] > b["place"]) & (F.abs(a["n"] - b["n"]) <= least) & (sum(apart[1:], apart[0]) <= 2 * least)

    def close() -> Column:
        # lines k edits apart begin at most 2 k edits apart, so most that are not near are told by their beginnings
        begins = F.levenshtein(F.substring("ml", 1, BEGINNING), F.substring("tl", 1, BEGINNING), 2 * max_edits) >= 0
        return begins & (F.call_function("levenshtein", F.col("ml"), F.col("tl"), allowed(F.length("ml"), F.length("tl"))) >= 0)

    def verified(pairs: DataFrame) -> DataFrame:
        """Places of the lines of pairs (own, other) that are near the other one."""
        a, b = F.col("own"), F.col("other")
        pairs = staged(pairs.select(a["h"].alias("h"), b["h"].alias("oh")).distinct(), "line-pairs")
        mine = near.select("h", F.col("place").alias("mp"), F.col("line").alias("ml"))
        theirs = near.select(F.col("h").alias("oh"), F.col("place").alias("tp"), F.col("line").alias("tl"))
        out = staged(pairs.join(mine, "h").join(theirs, "oh").where("mp > tp").where(close()).select(F.col("mp").alias("hit")).distinct(), "line-verified")
        discard(pairs)
        return out

    first = posts.join(firsts, "key").select("own", F.when(F.col("whole"), F.col("any")).otherwise(F.col("entire")).alias("other")).where(likely(F.col("own"), F.col("other")))
    found = verified(first)
    crowded = staged(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("key"), "line-crowds")
    among = bounded(crowded)
    unmet = lambda rows: rows.join(found, F.col("own.place") == F.col("hit"), "left_anti")
    others = lambda rows: rows.select("key", F.col("own").alias("other"), F.col("whole").alias("entire"))
    sparse = posts.join(among, "key", "left_anti")
    few = unmet(sparse).join(others(sparse), "key").where("whole or entire").where(likely(F.col("own"), F.col("other")))
    # In a crowd only lines with a likely partner go on, told by semi-joins, which emit a line once. Then the join itself
    # compares the texts, so that what it emits doesn't grow with the square of the crowd either.
    # What lies in crowded segments is taken out once, for all steps.
    crowd = staged(posts.join(among, "key", "left_semi"), "line-crowd")
    meets = (F.col("key") == F.col("okey")) & (F.col("whole") | F.col("entire")) & likely(F.col("own"), F.col("other"))
    held = others(crowd).withColumnRenamed("key", "okey")
    asking = staged(unmet(crowd).join(held, meets, "left_semi"), "line-asking")
    asked = staged(held.join(asking, meets, "left_semi"), "line-asked")
    # a pair is compared at the least of the crowded segments under which it meets, not at each
    at = F.col("own.h").alias("th"), F.col("own.place").alias("tp")
    keys = crowd.groupBy(*at).agg(F.collect_set("key").alias("any"), F.collect_set(F.when(F.col("whole"), F.col("key"))).alias("whole"))
    text = near.select(F.col("h").alias("th"), F.col("place").alias("tp"), F.col("line").alias("text")).join(keys, ["th", "tp"])
    text = staged(text.select("th", "tp", "text", F.struct("any", "whole").alias("keys")), "line-texts")
    mine = asking.join(text, (F.col("own.h") == F.col("th")) & (F.col("own.place") == F.col("tp"))).select("key", "own", "whole", F.col("text").alias("ml"), F.col("keys").alias("mk"))
    theirs = asked.join(text, (F.col("other.h") == F.col("th")) & (F.col("other.place") == F.col("tp"))).select("okey", "other", "entire", F.col("text").alias("tl"), F.col("keys").alias("tk"))
    least = F.least(*[F.array_min(F.array_intersect(F.col("mk")[x], F.col("tk")[y])) for x, y in (("whole", "any"), ("any", "whole"))])
    many = mine.join(theirs, meets & (least == F.col("key")) & close())
    few, many = verified(few), staged(many.select(F.col("own.place").alias("hit")).distinct(), "line-many")
    return found.unionByName(few).unionByName(many).distinct()


def near_lines(lines: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = 16) -> DataFrame:
    """hit (doc_id, line_no): the earliest places of distinct lines that have another, earlier line within the edits allowed.

    A pair may be one edit apart for each CHARS_PER_EDIT characters of its shorter line, one at
    least and max_edits at most; with max_edits 0 there are no hits. Lines shorter than min_chars
    are left out. A line counts as a repeat of any earlier line, whether or not that one is itself removed.
    """
    if max_edits < 0:
        raise ValueError("max_edits is 0 or more")
    n = F.length("line")
    long = lines.where(n >= min_chars).select("doc_id", "line_no", "line")
    if not max_edits:
        return long.where("false").select(F.struct("doc_id", "line_no").alias("hit"))
    if max_edits == 1:
        return _one_edit(long)
    # a line that allows one edit only meets lines that are at most a character longer
    short = staged(long.where(n <= 2 * CHARS_PER_EDIT), "line-short")
    return _one_edit(short).unionByName(_few_edits(long, max_edits)).distinct()


def dedup_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = 16) -> DataFrame:
    """docs with every line removed that repeats an earlier one, exactly or as near_lines tells.

    docs needs doc_id and text; all its columns are returned as they are but text (and n_chars, if
    there), plus n_lines and n_removed, which replace columns of those names. Lines are in the order of doc_id, hash of the text and line
    number; rows without doc_id come before all others. Rows that repeat a doc_id with another text are documents of their own;
    rows that repeat both lose the same lines and are not compared with each other.
    Empty lines stay. Null text stays null. A document all of whose lines go keeps its row, with empty text.
    """
    text, given = docs.drop("n_lines", "n_removed").withColumn("text", F.col("text").cast("string")), docs.columns
    lines = lines_of(text)
    place, (a, b) = F.struct("doc_id", "line_no"), _digest(F.col("line"))
    keyed = lines.where("line <> ''").select("doc_id", "line_no", a.alias("da"), b.alias("db"))
    twice = staged(keyed.groupBy("da", "db").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("da", "db"), "lines-twice")
    again = staged(keyed.join(bounded(twice), ["da", "db"]), "lines-again")
    first = again.groupBy("da", "db").agg(F.min(place).alias("first"))
    repeats = again.join(bounded(first), ["da", "db"]).where(~F.col("first").eqNullSafe(place)).select("doc_id", "line_no")
    near = near_lines(lines, max_edits, min_chars).select("hit.*")  # later places of such a line are among the repeats
    gone = repeats.unionByName(near).groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("__gone"))
    gone = staged(gone.select(F.col("doc_id").alias("__doc"), "__gone"), "lines-gone")
    parts = F.split("text", "\n", -1)
    kept = F.filter(parts, lambda line, i: ~F.array_contains(F.col("__gone"), i))
    # what goes grows with the corpus, so this is a merge join at every size
    out = text.join(gone.hint("merge"), _row().eqNullSafe(F.col("__doc")), "left")
    new = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = out.withColumns({"n_lines": F.coalesce(F.size(parts), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"), "text": new})
    given = [c for c in given if c.lower() not in ("n_lines", "n_removed")]
    if "n_chars" in given:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*given, "n_lines", "n_removed")
