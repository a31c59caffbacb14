"""Edit distance on strings, with adjacent transpositions.

``distance`` is the unrestricted Damerau-Levenshtein distance, a true metric
(the restricted variant violates the triangle inequality).
"""

from __future__ import annotations


def distance(a: str, b: str, most: int | None = None) -> int:
    """The distance of two strings; above ``most`` any larger number."""
    if a == b:
        return 0
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    n, m = len(a), len(b)
    if not n or not m:
        return n + m
    big = n + m
    table = [[big] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        table[i + 1][1] = i
    for j in range(m + 1):
        table[1][j + 1] = j
    last_row: dict[str, int] = {}
    for i in range(1, n + 1):
        last_column = 0
        x = a[i - 1]
        for j in range(1, m + 1):
            y = b[j - 1]
            k, at = last_row.get(y, 0), last_column
            if x == y:
                cost = 0
                last_column = j
            else:
                cost = 1
            table[i + 1][j + 1] = min(
                table[i][j] + cost, table[i + 1][j] + 1, table[i][j + 1] + 1, table[k][at] + (i - k - 1) + 1 + (j - at - 1)
            )
        last_row[x] = i
    return table[n + 1][m + 1]


def deletions(word: str) -> set[str]:
    """The word and all words one deletion shorter: two words within one edit
    share one of these."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}
