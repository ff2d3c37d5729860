import itertools
import random

import corpus_pipeline

from lectern.llm import decontaminate


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == corpus_pipeline.COLUMNS
        docs = corpus_pipeline.staged(out, "test")
    assert 0 < docs.count() < before and decontaminate.benchmark_overlaps(docs, bench).count() == 0
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b):
    n = min(len(a), len(b))
    allowed = min(5, max(1, n // 20))
    return n >= 16 and abs(len(a) - len(b)) <= allowed and distance(a, b) <= allowed


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def leaks(text, item):
    a, b = ([w.strip(".,;:!?\"'()[]{}*#&%$|") for w in t.lower().split()] for t in (text, item))
    return any(sum(x == y for x, y in zip(a[i : i + 13], b[j : j + 13], strict=True)) >= 11 for i in range(len(a) - 12) for j in range(len(b) - 12))


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("aeioubdfglmnprst") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    item, shared = line(30), line(12)
    texts = ["\n".join([line(20), line(15)]) for _ in range(20)]
    texts += [texts[0], texts[1] + " " + line(1), texts[2].replace("a", "e", 1), shared + "\n" + line(30), line(25) + "\n" + shared]
    texts += [line(20) + " " + " ".join(item.split()[5:25]) + " " + line(5), line(10) + "\n" + item.replace(item.split()[9], "other")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    good = {r["doc_id"] for r in corpus_pipeline.keep_good(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    seen, kept = [], {}
    for i in sorted(good):
        lines = texts[i].split("\n")
        left = [x for k, x in enumerate(lines) if not x or not any(x == s or near(x, s) for s in seen + lines[:k])]
        seen += lines
        if len(left) == len(lines) or any(x.strip() for x in left):
            kept[i] = "\n".join(left)
    sets, group = {i: shingles(t) for i, t in kept.items()}, {i: i for i in kept}
    for _ in kept:
        for a, b in itertools.combinations(sorted(kept), 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group[a] = group[b] = min(group[a], group[b])
    want = {i for i in kept if group[i] == i and not leaks(kept[i], item)}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == want and 15 <= len(want) < len(texts)
