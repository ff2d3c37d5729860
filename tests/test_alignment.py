"""Alignments against a plain table with traceback."""

import random
from collections import Counter

import pytest

from lectern.functions import alignment as A
from lectern.operators import evaluation as E
from lectern.plans import documents as D


def plain(a, b):
    """The whole table, read back from its end: pair, then lose, then add."""
    table = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j - 1] + (a[i - 1] != b[j - 1]), table[i - 1][j] + 1, table[i][j - 1] + 1)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and table[i][j] == table[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            pair = (a[i], b[j])
        elif i and table[i][j] == table[i - 1][j] + 1:
            i, pair = i - 1, (a[i - 1], "")
        else:
            j, pair = j - 1, ("", b[j - 1])
        out += [pair] if pair[0] != pair[1] else []
    return out[::-1], table[-1][-1]


def test_differences_equal_a_plain_table():
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abcд'😀") for _ in range(n))
    pairs = [(word(rnd.randint(0, 30)), word(rnd.randint(0, 30))) for _ in range(200)]
    for _ in range(100):
        x = word(rnd.randint(0, 60))
        pairs.append((x, "".join(c for c in x if rnd.random() > 0.1) + word(rnd.randint(0, 2))))
    pairs += [("", ""), ("", "abc"), ("abc", ""), ("same", "same"), ("a" * 300, "b"), ("b", "a" * 300)]
    assert A.differences(pairs) == [plain(a, b)[0] for a, b in pairs]
    assert A.differences([]) == []


def test_large_tables_are_cut_at_no_loss(monkeypatch):
    rnd = random.Random(4)
    pairs = [("".join(rnd.choice("abcd") for _ in range(rnd.randint(50, 120))), "".join(rnd.choice("abcd") for _ in range(rnd.randint(50, 120)))) for _ in range(20)]
    monkeypatch.setattr(A, "CELLS", 2000)
    assert [len(d) for d in A.differences(pairs)] == [plain(a, b)[1] for a, b in pairs]


@pytest.mark.parametrize(("a", "b", "kind"), [("і", "i", "і/i"), ("i", "і", "і/i"), ("ї", "i", "ї/i"), ("'", "", A.APOSTROPHE), ("", "’", A.APOSTROPHE), ("", "x", A.ADDED_OR_LOST), ("о", "o", "гомогліфи"), ("q", "w", A.OTHER)])
def test_classes(a, b, kind):
    assert A.confusion_class(a, b) == kind


def test_an_inserted_letter_shifts_nothing(spark):
    pairs = spark.createDataFrame([("e", "слово п'ять", "сслово пять"), ("e", None, None), ("f", "їжак", "iжак"), ("f", None, "x")], "engine string, reference string, hypothesis string")
    got = {(r["engine"], r["class"], r["expected"], r["found"]): r["n"] for r in E.confusions(pairs, "engine").collect()}
    assert got == {("e", A.ADDED_OR_LOST, "", "с"): 1, ("e", A.APOSTROPHE, "'", ""): 1, ("f", "ї/i", "ї", "i"): 1, ("f", A.ADDED_OR_LOST, "", "x"): 1}
    classes = {(r["engine"], r["class"]): r["n"] for r in E.confusion_classes(E.confusions(pairs, "engine"), "engine").collect()}
    assert classes["f", A.ADDED_OR_LOST] == 1 and E.confusions(pairs.limit(0), "engine").count() == 0


def test_confusions_of_all_conversations_equal_a_plain_count(spark):
    d = "/root/testdata/sf0.001"
    want = Counter()
    for r in D.misread(spark, d).collect():
        want.update((r["role"], A.confusion_class(x, y), x, y) for x, y in plain(E.ocr_text(r["reference"]), E.ocr_text(r["hypothesis"]))[0])
    assert {tuple(r)[:4]: r["n"] for r in D.confusions(spark, d).collect()} == dict(want)
    assert len({k[1] for k in want}) >= 3
