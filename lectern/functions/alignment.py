"""Character alignments of many pairs of texts at once, and the classes of what is confused."""

from __future__ import annotations

import numpy as np

#: Classes of characters that recognition confuses, as unordered pairs.
CONFUSIONS = {
    "і/i": "іi ІI іl Іl і1 І1",
    "и/й": "ий ИЙ",
    "ї/i": "їi їï їі ЇI ЇІ",
    "є/e": "єe єс ЄE єε",
    "ґ/г": "ґг ҐГ",
    "гомогліфи": "аa АA еe ЕE оo ОO сc СC рp РP хx ХX уy УY кk КK МM ТT ВB НH",
}
#: The characters that count as apostrophes, and the names of the classes that are no pairs.
APOSTROPHES = "'’ʼ´′`‘"
APOSTROPHE, ADDED_OR_LOST, OTHER = "апостроф", "вставка/вилучення", "інші"

#: Half of the first band; cells of a batch's tables at most; a value that no distance reaches.
BAND, CELLS, FAR = 8, 1 << 25, 1 << 28

_CLASS: dict[frozenset, str] = {}
for _name, _pairs in CONFUSIONS.items():
    for _pair in _pairs.split():
        _CLASS.setdefault(frozenset(_pair), _name)


def confusion_class(a: str, b: str) -> str:
    """The class of a difference: b stands for a, and an empty side was added or lost."""
    if (a and a in APOSTROPHES) or (b and b in APOSTROPHES):
        return APOSTROPHE
    return ADDED_OR_LOST if not a or not b else _CLASS.get(frozenset((a, b)), OTHER)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of a to all beginnings of b."""
    places = np.arange(len(b) + 1)
    row = places
    for i, c in enumerate(a, 1):
        step = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (b != c))])
        row = np.minimum.accumulate(step - places) + places
    return row


def _halves(a: str, b: str) -> list[tuple[str, str]]:
    """The pair cut where an alignment of least distance passes a's middle, until the pieces' tables are small."""
    if len(a) < 2 or (len(a) + 1) * (2 * max(len(a), len(b)) + 1) <= CELLS:
        return [(a, b)]
    half, x, y = len(a) // 2, _points(a), _points(b)
    cut = int(np.argmin(_last_row(x[:half], y) + _last_row(x[half:][::-1], y[::-1])[::-1]))
    return [*_halves(a[:half], b[:cut]), *_halves(a[half:], b[cut:])]


def _banded(pairs: list[tuple[str, str]], w: int) -> list[list[tuple[str, str]] | None]:
    """Differences of each pair, or None where the distance is over w: tables of all pairs together, w cells to both sides of the diagonal."""
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    a = np.full((len(pairs), n.max() + 1), -1)
    b = np.full((len(pairs), n.max() + 2 * w + 2), -2)
    for k, (x, y) in enumerate(pairs):
        a[k, : len(x)] = _points(x)
        b[k, w : w + len(y)] = _points(y)[: b.shape[1] - w]
    k = np.arange(2 * w + 1)
    row = np.where(k >= w, k - w, FAR) + np.zeros((len(pairs), 1), np.int64)
    ways = np.zeros((n.max() + 1, len(pairs), 2 * w + 1), np.uint8)
    at_end = np.where(n == 0, np.where(np.abs(m - n) <= w, m, FAR), FAR)
    for i in range(1, n.max() + 1):
        # the cell k of row i is column i + k - w; b is shifted by w
        same = b[:, i - 1 : i + 2 * w] == a[:, i - 1, None]
        diagonal = row + ~same
        down = np.column_stack([row[:, 1:], np.full(len(pairs), FAR)]) + 1
        best = np.where(i + k - w >= 0, np.minimum(diagonal, down), FAR)
        row = np.minimum.accumulate(best - k, axis=1) + k
        ways[i] = np.where(row == diagonal, 0, np.where(row == down, 1, 2))
        ends = np.flatnonzero((n == i) & (np.abs(m - n) <= w))
        at_end[ends] = row[ends, (m - n)[ends] + w]
    out: list = [[] if d <= w else None for d in at_end]
    at = np.flatnonzero(at_end <= w)
    i, j = n[at].copy(), m[at].copy()
    while len(at):
        way = np.where(i == 0, 2, ways[i, at, j - i + w])
        for p, x, y, v in zip(at.tolist(), i.tolist(), j.tolist(), way.tolist(), strict=True):
            left, right = pairs[p][0][x - 1] if v < 2 else "", pairs[p][1][y - 1] if v != 1 else ""
            if left != right:
                out[p].append((left, right))
        i, j = i - (way < 2), j - (way != 1)
        stay = (i > 0) | (j > 0)
        at, i, j = at[stay], i[stay], j[stay]
    return [None if d is None else d[::-1] for d in out]


def differences(pairs: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """For each pair the characters that differ in an alignment of least edit distance, in order; an empty side was added or lost.

    Of alignments with the same distance, read from the end, one that pairs characters is preferred, then one that loses. Bands double until they hold the
    distance, so a pair costs its length times its distance. Pairs whose tables would be large are cut first, at no loss of distance.
    """
    pieces = [(k, piece) for k, pair in enumerate(pairs) for piece in _halves(*pair)]
    done: list[list[tuple[str, str]] | None] = [[] if x == y else None for _, (x, y) in pieces]
    w = BAND
    while open_ := [k for k, d in enumerate(done) if d is None]:
        open_.sort(key=lambda k: len(pieces[k][1][0]))
        while open_:
            longest = len(pieces[open_[-1]][1][0]) + 1
            some, open_ = open_[-max(1, CELLS // (longest * (2 * w + 1))) :], open_[: -max(1, CELLS // (longest * (2 * w + 1)))]
            for k, found in zip(some, _banded([pieces[k][1] for k in some], w), strict=True):
                done[k] = found
        w *= 2
    out: list[list[tuple[str, str]]] = [[] for _ in pairs]
    for (k, _), d in zip(pieces, done, strict=True):
        out[k] += d
    return out
