"""Local alignment of word sequences (Smith-Waterman), inside a diagonal band or over the whole table."""

from __future__ import annotations

import numpy as np

MATCH, MISMATCH, GAP = 2, -1, -1


def align(a: list, b: list, low: int, high: int) -> tuple[int, int, int, int, int, int]:
    """score, matches, a_begin, a_end, b_begin, b_end of the best local alignment of a and b with low <= j - i <= high.

    Ends are one past the last word. Ties go to the first end in a, then in b; without a match all are 0.
    """
    width = high - low + 1
    best = (0, 0, 0, 0, 0, 0)
    # a cell: score, matches, where its alignment began in a and b
    empty = (0, 0, -1, -1)
    above = [empty] * (width + 1)
    for i, x in enumerate(a):
        row = [empty] * (width + 1)
        for k in range(max(0, -i - low), min(width, len(b) - i - low)):
            j = i + low + k
            s, m, p, q = above[k]
            if x == b[j]:
                cell = (s + MATCH, m + 1, *((p, q) if s else (i, j)))
            else:
                cell = (s + MISMATCH, m, p, q)
            up = above[k + 1]
            if up[0] + GAP > cell[0]:
                cell = (up[0] + GAP, *up[1:])
            if k and row[k - 1][0] + GAP > cell[0]:
                cell = (row[k - 1][0] + GAP, *row[k - 1][1:])
            if cell[0] > 0:
                row[k] = cell
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], i + 1, cell[3], j + 1)
        above = row
    return best


def align_whole(a: np.ndarray, b: np.ndarray, need: int) -> tuple[int, int, int, int] | None:
    """score, matches, b_begin, b_end of the best local alignment of a and b with ``need`` matches, without a band.

    Every end counts with its best alignment, where a step in both goes before one in a, and that before one in b. Of
    the ends with ``need`` matches the highest score wins, then most matches, then the first in b. None: there is none.
    One row of the table is in memory at a time.
    """
    places, best, found = np.arange(len(b)), (0, 0), None
    # of each place in b, behind a first one for none: score, matches and begin of its alignment
    score, m, begin = (np.zeros(len(b) + 1, np.int64) for _ in range(3))
    for i, x in enumerate(a):
        same = b == x
        s = score[:-1] + np.where(same, MATCH, MISMATCH)
        k, p = m[:-1] + same, np.where(score[:-1] > 0, begin[:-1], places)
        up = score[1:] + GAP
        from_up = up > s
        s, k, p = np.where(from_up, up, s), np.where(from_up, m[1:], k), np.where(from_up, begin[1:], p)
        none = s <= 0
        s[none] = k[none] = 0
        # steps in b: the last cell that no earlier one beats at its cost by distance
        far = s - GAP * places
        top = np.maximum.accumulate(far)
        origin = np.maximum.accumulate(np.where(far == top, places, 0))
        score[1:], m[1:], begin[1:] = top + GAP * places, k[origin], p[origin]
        if i + 1 >= need:
            rank = np.where(m[1:] >= need, score[1:] * (len(a) + 1) + m[1:], 0)
            j = int(rank.argmax()) if len(rank) else 0
            if len(rank) and rank[j] > 0 and (int(rank[j]), -j) > best:
                best, found = (int(rank[j]), -j), (int(score[j + 1]), int(m[j + 1]), int(begin[j + 1]), j + 1)
    return found
