"""Operators against brute force on small fixtures, and their edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import chat, common, decontaminate, embedding_dedup, langid, line_dedup, ngram_join, packing, quality, substring_dedup, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, copies string").repartition(parts)


def edited(words, k, vocabulary, rng):
    words = list(words)
    for _ in range(k):
        i, r = rng.randrange(len(words)), rng.random()
        if r < 0.5:
            words[i] = rng.choice(vocabulary)
        elif r < 0.75 and len(words) > 1:
            words.pop(i)
        else:
            words.insert(i, rng.choice(vocabulary))
    return words


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    texts = ["Hello, it's a test!! 12", None, "", "Ünïcode ñandú “quotes” İ", "<|endoftext|> x", "word " * 90, "same", "same"]
    rows = packing.pack_documents(docs(spark, texts), PATH, length=32).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        part = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(part) == r["length"] and r["start"] == len(ids.get(r["doc_id"], [])) and r["ids_crc32"] == zlib.crc32(r["ids"])
        ids.setdefault(r["doc_id"], []).extend(part)
    assert ids == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 32
    assert packing.pack_documents(docs(spark, ["a"]).limit(0), PATH).count() == 0


def test_best_fit_is_best_fit_decreasing():
    import bisect
    from collections import Counter

    rng = random.Random(1)
    for n, length in [(1, 7), (40, 7), (60, 16), (3000, 512)]:
        lengths = [rng.randint(1, length) for _ in range(n)]
        plan = packing.best_fit_plan(Counter(lengths), length)
        free, bins = [], 0
        for x in sorted(lengths, reverse=True):
            k = bisect.bisect_left(free, x)
            left = free.pop(k) if k < len(free) else length
            bins += left == length
            bisect.insort(free, left - x) if left - x else None
        assert len({b + i for _, _, m, b, _ in plan for i in range(m)}) == bins


@pytest.mark.parametrize("min_chars", [16, 1])
def test_line_dedup_against_brute_force(spark, min_chars):
    rng = random.Random(3)

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        a, b = sorted((a, b), key=len)
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return (a[k + 1 :] == b[k + 1 :]) if len(a) == len(b) else a[k:] == b[k + 1 :]

    base = ["".join(rng.choice("ab") for _ in range(rng.randint(16, 22) if min_chars > 1 else rng.randint(1, 12))) for _ in range(15)]
    texts = ["\n".join("".join(edited(rng.choice(base), rng.randint(0, 2), "ab", rng)) for _ in range(3)) for _ in range(60)] + [None, "", "\n\n", "short\nshort"]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts), min_chars=min_chars).collect()}
    seen = []
    for i, t in enumerate(texts):
        kept = []
        for line in t.split("\n") if t is not None else []:
            if not line or not any(line == s or min(len(line), len(s)) >= min_chars and near(line, s) for s in seen):
                kept.append(line)
            seen.append(line)
        assert got[i] == (None if t is None else "\n".join(kept))


@pytest.mark.parametrize("broadcast", [True, False])
def test_line_dedup_of_several_edits_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "CROWD", 3)
    if not broadcast:  # the plan beyond the sizes that are broadcast
        monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", -1)
        monkeypatch.setattr(line_dedup, "CROWD", 1000)
        monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    rng = random.Random(8)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    base = ["".join(rng.choice("abc") for _ in range(n)) for n in (38, 40, 44, 61, 80, 99, 101, 119, 152, 226, 400)]
    texts = ["".join(edited(rng.choice(base), rng.randint(0, 7), "abc", rng)) for _ in range(180)]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    want, edits = {}, set()
    for i, t in enumerate(texts):
        near = [d for s in texts[:i] if abs(len(s) - len(t)) <= 5 and (d := distance(s, t)) <= min(5, max(1, min(len(s), len(t)) // 20))]
        want[i] = int(bool(near))
        edits |= {min(near)} if near else set()
    assert got == want and edits >= {1, 2, 3, 4, 5}


def test_line_dedup_takes_crowded_lines_out_once(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CROWD", 3)
    rng, letters, write, plans = random.Random(6), "abcdefghijklmnopqrstuvwxyz", line_dedup.staged, {}

    def seen(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(line_dedup, "staged", seen)
    shared = "".join(rng.choice(letters) for _ in range(60))
    texts = [shared + "".join(rng.choice(letters) for _ in range(60)) for _ in range(12)]
    texts += [texts[3][5:], "#####" + texts[4], texts[5][:-5], texts[6][6:]]  # five edits at one end, and six
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert {i for i, n in got.items() if n} == {12, 13, 14}
    # lines of crowded segments are joined with their keys in one step, whatever later steps read
    steps = ("line-crowd", "line-asking", "line-asked", "line-texts")
    joined = [name for name in steps for plan in plans.get(name, []) if re.search(r"Join (Inner|LeftSemi), \(key#\d+L? = key#\d+L?\)", plan)]
    assert joined == ["line-crowd"]


def test_line_dedup_makes_segment_keys_once(spark, monkeypatch):
    made, keys, letters, rng = spark.sparkContext.accumulator(0), line_dedup._segment_keys, "abcdefghijklmnopqrstuvwxyz", random.Random(4)
    counted = F.udf(lambda h: made.add(1) or h, "long")
    monkeypatch.setattr(line_dedup, "_segment_keys", lambda *a: keys(*a).withColumn("h", counted("h")))
    texts = ["".join(rng.choice(letters) for _ in range(90)) for _ in range(10)]
    texts += [texts[2][:40] + "##" + texts[2][40:]]
    assert [r["n_removed"] for r in line_dedup.dedup_lines(docs(spark, texts)).orderBy("doc_id").collect()] == [0] * 10 + [1]
    assert made.value == keys(docs(spark, texts).select(F.xxhash64("text").alias("h"), F.col("text").alias("line")), line_dedup.MAX_EDITS).count()


def test_line_dedup_finds_lines_with_one_clean_segment(spark):
    rng, letters, texts = random.Random(4), "abcdefghijklmnopqrstuvwxyz", []
    for n in (100, 101, 120, 149, 151, 224, 300, 500):
        for clean in range(6):
            base = [rng.choice(letters) for _ in range(n)]
            other = list(base)
            for segment in reversed(range(6)):  # from the end, so that earlier places stay
                if segment != clean:
                    at = min(n - 1, segment * n // 6 + rng.randrange(n // 6))
                    kind = rng.choice(["in", "out", "swap"]) if n > 100 else rng.choice(["in", "swap"])
                    other[at : at + (kind != "in")] = [] if kind == "out" else ["#"]
            texts += ["".join(base), "".join(other)]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    short = {i for i in range(1, len(texts), 2) if min(len(texts[i]), len(texts[i - 1])) < 100}
    assert {i for i, n in got.items() if n} >= set(range(1, len(texts), 2)) - short and not any(got[i] for i in range(0, len(texts), 2))


def test_line_dedup_of_repeated_ids_and_clashing_columns(spark):
    first = "an entirely unique first line here"
    rows = [(1, "this line is a long common one", 7), (5, "this line is a long common one\nx", 7), (5, first + "\ny", 7), (None, "one line of its own without id\nz", 7), (None, "this line is a long common one\nu", 7), (5, first + "\ny", 7)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_removed int"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert sorted(((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in got.collect())) == sorted([(1, "", 1), (5, "x", 1), (5, first + "\ny", 0), (5, first + "\ny", 0), (0, "one line of its own without id\nz", 0), (0, "this line is a long common one\nu", 0)])


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 1024), (5, 80, 3)])
def test_ngram_components_against_brute_force(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    rng, vocabulary, texts = random.Random(5), [f"w{i}" for i in range(300)], ["", None, " \n", "A a A", "a a a"]
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 12, 40, 200]))]
        texts += [" ".join(edited(words, rng.randint(0, max(1, len(words) // 50)), vocabulary, rng)) for _ in range(rng.randint(1, 6))]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    union = ngram_join.Union(len(texts))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            union.join(i, j)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs(spark, texts), n, percent).collect()}
    assert got == {i: (len(sets[i]), union.find(i)) for i in range(len(texts))}


def test_ngram_components_of_a_long_chain_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(6100)]
    chain = [" ".join(words[2 * i : 2 * i + 60]) for i in range(3000)]  # only neighbours link, each shares 93 %
    rows = [(i, t, 1) for i, t in enumerate(chain)] + [(5000, "a b c", 2), (5001, "d e f", 2), (5000, "d e f", 3), (None, "d e f", 4), (None, None, 5)]
    given = spark.createDataFrame(rows, "doc_id long, text string, component_id int").repartition(3)
    got = [(r["doc_id"], r["component_id"]) for r in ngram_join.ngram_components(given, 5, 90).collect()]
    assert sorted(x for x in got if x[0] is not None) == sorted([(i, 0) for i in range(3000)] + [(5000, 5000)] * 2 + [(5001, 5000)])
    assert [c for d, c in got if d is None] == [None, None]


def test_chat_keeps_maximal_conversations(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", None), (3, 1, "assistant", None), (3, 0, "user", "hi"), (4, 0, None, "x"), (None, 0, "user", "lost")]
    got = chat.render_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id").collect()
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(2, 2), (4, 1)]
    assert got[0]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>"


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    item = words[100:130]
    two, four = list(item), list(item)
    for k in (3, 9, 16, 22):
        two[k] = "other"
    for k in range(0, 30, 4):
        four[k] = "other"
    texts = [" ".join(words), "pre " + " ".join(two).upper() + ", post", "pre " + " ".join(four), " ".join(words[:90]), None, ""]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (None, "x " * 20)], "item_id long, text string")
    got = decontaminate.benchmark_overlaps(docs(spark, texts), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(0, 7), (1, 7)}
    kept = decontaminate.drop_contaminated(docs(spark, texts), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 5]
    # every pair of substitutions is ignored by one mask
    for wrong in itertools.combinations(range(13), 2):
        assert any(not set(wrong) & set(m.tolist()) for m in decontaminate.masks(13, 2))


def test_decontamination_of_repetitive_texts_and_odd_rows(spark):
    begin = time.perf_counter()
    index = decontaminate.Index([(7, decontaminate.tokens("na " * 600))])
    rows = index.matches([decontaminate.tokens("na " * 20_000), decontaminate.tokens("x " + "na " * 12), decontaminate.tokens("x " * 3 + "na " * 13)])
    assert rows.tolist() == [[0, 0, 0, 0, 13], [1, 0, 0, 0, 12], [2, 0, 3, 0, 13]] and time.perf_counter() - begin < 1
    items = spark.createDataFrame([(1, "one two three four five", 9), (1, "one two three four five", 9), (1, "six seven eight", 9), (None, "a b", 9), (2, None, 9)], "item_id long, text string, matched int")
    given = spark.createDataFrame([(1, "x one two three four five y", 0), (1, "six seven eight", 0), (None, "six seven eight", 0), (3, None, 0), (4, "one two three four", 0)], "doc_id long, text string, width int")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["doc_word"], r["matched"], r["width"]) for r in decontaminate.benchmark_overlaps(given, items).collect())
    assert got == [(0, 1, 0, 3, 3), (1, 1, 0, 3, 3), (1, 1, 1, 5, 5)]
    assert decontaminate.benchmark_overlaps(given.limit(0), items).count() == decontaminate.benchmark_overlaps(given, items.limit(0)).count() == 0


def test_decontamination_against_brute_force(spark):
    rng, vocabulary = random.Random(9), [f"w{k}" for k in range(60)]
    items = {i: [rng.choice(vocabulary) for _ in range(n)] for i, n in enumerate([1, 2, 3, 5, 7, 8, 8, 10, 12, 12, 13, 13, 17, 25])}
    texts = []
    for k in range(120):
        piece = list(items[k % len(items)])
        for _ in range(min(4, k // len(items))):  # each item is held verbatim at first
            piece[rng.randrange(len(piece))] = rng.choice(vocabulary)
        texts.append([rng.choice(vocabulary) for _ in range(rng.randint(0, 9))] + piece + [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))])
    want = {}
    for (d, t), (i, item) in itertools.product(enumerate(texts), items.items()):
        width = min(13, len(item))
        same = [sum(x == y for x, y in zip(t[p : p + width], item[q : q + width], strict=True)) for p in range(len(t) - width + 1) for q in range(len(item) - width + 1)]
        if same and max(same) >= width - (2 if width == 13 else 1 if width >= 8 else 0):
            want[d, i] = max(same)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontaminate.benchmark_overlaps(docs(spark, [" ".join(t) for t in texts]), bench).collect()}
    assert got == want and {i for _, i in want} == set(items)


def test_substring_dedup_against_brute_force(spark):
    cover, period = substring_dedup.COVER, substring_dedup.PERIOD
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    rng, vocabulary = random.Random(9), [f"w{i}" for i in range(200)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([49, 50, 51, 90]))] for _ in range(8)]
    texts = [" ".join(w for _ in range(rng.randint(0, 4)) for w in [*(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 40]))), *rng.choice(passages)]) for _ in range(60)]
    texts += [texts[3], None, "", "a b", "x " * 120, "x " * 60]
    words, first = [(t or "").split() for t in texts], {}
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeated_passages(docs(spark, texts)).collect()}
    for i, w in enumerate(words):
        gone = {k + x for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for x in range(50)}
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert got[i] == (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())


@pytest.mark.parametrize("local", [0, 1 << 14])
def test_vector_components_against_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 64)
    monkeypatch.setattr(embedding_dedup, "LOCAL", local)
    rng = np.random.default_rng(2)
    x = [(c + rng.standard_normal(64) * rng.choice([0, 0.1, 0.3, 0.4])).astype(np.float32) for c in rng.standard_normal((12, 64)) for _ in range(rng.choice([1, 2, 12]))]
    x += [x[0], x[0]]
    labels = [rng.choice([0, 1, None]) for _ in x]
    rows = [(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, labels, strict=True))] + [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [1.0, 2.0], 1), (904, [2.0, 4.0], 1)]
    unit = np.array(x, float) / np.linalg.norm(np.array(x, float), axis=1, keepdims=True)
    union, links = ngram_join.Union(len(x)), [0] * len(x)
    for i, j in itertools.combinations(range(len(x)), 2):
        if labels[i] is not None and labels[i] == labels[j] and unit[i] @ unit[j] >= 0.93:
            union.join(i, j)
            links[i] += 1
            links[j] += 1
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert {i: got[i] for i in range(len(x))} == {i: (links[i], union.find(i), union.find(i) == i) for i in range(len(x))}
    assert [got[k] for k in range(900, 905)] == [(0, 900, True), (0, 901, True), (0, 902, True), (1, 903, True), (1, 903, False)]


@pytest.mark.parametrize("local", [0, 100])
def test_vectors_of_a_large_label_are_not_copied(spark, monkeypatch, local):
    """A label of many parts and blocks: every class is shuffled once, and counts are those of all pairs."""
    for name, value in (("CHUNK", 8), ("LOCAL", local)):
        monkeypatch.setattr(embedding_dedup, name, value)
    written = []

    def told(df, name, *folders):
        df = common.staged(df, name, *folders)
        written.append((name, df.count(), "vector" in df.columns))
        return df

    monkeypatch.setattr(embedding_dedup, "staged", told)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.standard_normal((40, 16)), 10, 0) + 0.12 * rng.standard_normal((400, 16))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.vector_components(spark.createDataFrame([(i, v.tolist(), i // 390) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    near &= (np.arange(400) // 390)[:, None] == (np.arange(400) // 390)[None, :]
    root = embedding_dedup.joined(np.arange(400), *np.nonzero(near))
    assert got == {i: (int(near[i].sum()) - 1, int(root[i])) for i in range(400)}
    assert [w for w in written if w[2]] == [("vector-classes", 400, True), ("vector-parts", 400, True)]
    assert len([n for n, *_ in written if n == "vector-links"]) > 3


def test_a_block_is_compared_in_tiles(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 7)
    x = np.random.default_rng(6).standard_normal((60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at, copies = np.random.default_rng(7).permutation(60) * 3, np.arange(60) % 3 + 1
    g = embedding_dedup.Group(at, copies, x)
    links, mate = g.compare(at, copies, x, 0.8)
    ok = (x @ x.T >= 0.8) & (at[None, :] < at[:, None])
    assert links.tolist() == (ok * copies).sum(1).tolist() and g.links.tolist() == ((ok * copies[:, None]).sum(0))[np.argsort(at)].tolist()
    assert all(ok[k, at.tolist().index(m)] for k, m in enumerate(mate.tolist()) if links[k])


def test_vector_components_of_odd_rows(spark):
    e, tiny, big = [1.0, 0.0], [1e-46, 1e-46], [1e300, 2e300]
    rows = [(1, e, "x", 1), (1, [0.0, 1.0], "x", 1), (2, [5.0, 0.1], "x", 1), (3, [0.0, 2.0], "y", 1), (None, e, "x", 1), (4, tiny, "t", 1), (5, tiny, "t", 1), (6, [3e-46, 3e-46], "t", 1), (7, big, "t", 1), (8, big, "t", 1), (9, e, None, 1), (10, e, None, 1)]
    got = embedding_dedup.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, n_links int")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, 0, False), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 4, 4, True), (5, 4, 4, False), (6, 4, 4, False), (7, 4, 4, False), (8, 4, 4, False), (9, 0, 9, True), (10, 0, 10, True)]
    assert embedding_dedup.vector_components(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_held_out_accuracy(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lang = {r["doc_id"]: r["lang"] for r in d.collect()}
    got = [r for r in langid.language_id(d).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) >= 0.97 * len(got)
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    seen = [r for r in toxicity.toxicity(d, labels).collect() if r["held_out"] and r["doc_id"] in toxic]
    assert sum(r["predicted"] and not toxic[r["doc_id"]] for r in seen) <= 2
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    judged = [r for r in quality.quality_scores(d).collect() if r["doc_id"] in good]
    assert sum(int(r["keep"]) == good[r["doc_id"]] for r in judged) >= 0.97 * len(judged)


def test_languages_beyond_64_and_whole_texts(spark):
    rng = random.Random(4)
    vocabularies = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)] for k in range(67)}
    rows = [(10 * k + x, " ".join(rng.choice(words) for _ in range(30)), lang) for k, (lang, words) in enumerate(vocabularies.items()) for x in range(2)]
    # what marks this language stands beyond the first 20,000 characters
    rows.append((5000, "12345 " * 4000 + "zyxwvu " * 50, "late"))
    filters = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).cache())
    assert filters.languages == sorted([*vocabularies, "late"])
    for _, text, lang in [*rows[:-1], (0, "zyxwvu zyxwvu", "late")]:
        assert filters.languages[int(np.argmax(filters.shares(text)))] == lang


def brute_nearest(index, examples, words):
    """Cosines with every example over dictionaries, best first; ties by the index's order."""
    def unit(counts):
        v = {t: (1 + math.log(n)) * index.idf[index.names[t]] for t, n in counts.items() if t in index.names}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    q, place = unit(words), {d: k for k, d in enumerate(index.ids)}
    scored = [(round(sum(x * v.get(t, 0) for t, x in q.items()), 12), -place[d]) for d, v in ((d, unit(w)) for d, w, _ in examples)]
    return [(s, -k) for s, k in sorted(scored, reverse=True) if s > 0]


def test_block_max_search_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    rng, vocabulary = random.Random(4), [f"w{i}" for i in range(60)]
    examples = [(i, dict(collections.Counter(rng.choices(vocabulary[: rng.choice([5, 60])], k=rng.randint(0, 30)))), int(rng.random() < 0.2)) for i in range(500)]
    index = toxicity.Index(examples)
    for _, words, _ in examples[:80]:
        got, want = index.nearest(index.vector(words)), brute_nearest(index, examples, words)[:15]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=1e-10)


def test_toxicity_against_brute_force(spark, monkeypatch):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, labels).collect()}
    texts, toxic = {r["doc_id"]: r["text"] for r in d.collect()}, {r["doc_id"]: r["toxic"] for r in labels.collect()}
    learned = sorted(i for i in toxic if i in texts and zlib.crc32(str(i).encode()) % 3 != 1)
    examples = [(i, dict(toxicity.word_counts(texts[i])), toxic[i]) for i in learned]
    monkeypatch.setattr(toxicity.Index, "nearest", lambda self, words, k=15: brute_nearest(self, [e for e in examples if e[0] in set(self.ids)], words)[:k])
    monkeypatch.setattr(toxicity.Index, "vector", lambda self, words, real=toxicity.Index.vector: words if hasattr(self, "entries") else real(self, words))
    model = toxicity.Model(examples)
    for i, text in texts.items():
        score, _ = model.score(text)
        assert got[i]["score"] == pytest.approx(score, abs=1e-9) and got[i]["predicted"] == int(score >= 0.7) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_toxicity_catches_held_out_documents(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.toxicity(d, labels).collect()
    seen = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert sum(r["predicted"] for r in seen if toxic[r["doc_id"]]) >= 0.9 * sum(toxic[r["doc_id"]] for r in seen)
    assert sum(r["predicted"] for r in seen if not toxic[r["doc_id"]]) <= 0.015 * len(seen)
    assert sum(bool(r["evidence"]) for r in rows) >= 0.98 * len(rows)


def test_odd_rows(spark):
    d = spark.createDataFrame([(None, None, None), (1, "", "en"), (2, "a b", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for run in (quality.quality_scores, langid.language_id, lambda x: toxicity.toxicity(x, labels), ngram_join.ngram_components, substring_dedup.remove_repeated_passages, line_dedup.dedup_lines):
        assert run(d).count() == 3
        assert run(d.limit(0)).count() == 0
