"""Longest common subsequences, bit-parallel (a row of the table is one integer), in bounded memory."""

from __future__ import annotations

from collections.abc import Sequence

#: Bits of stored rows at most; longer tables are halved first.
MOST_BITS = 1 << 28


def _rows(a: Sequence, b: Sequence, keep: bool) -> list[int]:
    """After each item of a, an integer whose zero bits, up to a place of b, count the LCS; all of them or the last."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        if m := where.get(x, 0):
            u = row & m
            row = ((row + u) | (row - u)) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _prefix_lengths(row: int, n: int) -> list[int]:
    out, k = [0], 0
    for j in range(n):
        k += not row >> j & 1
        out.append(k)
    return out


def common(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Pairs of places in a longest common subsequence of a and b, ascending."""
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    ends = [(len(a) - k, len(b) - k) for k in range(high, 0, -1)]
    inner = _inner(a[low : len(a) - high], b[low : len(b) - high])
    return [*((k, k) for k in range(low)), *((i + low, j + low) for i, j in inner), *ends]


def _inner(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > MOST_BITS:
        half = len(a) // 2
        left = _prefix_lengths(_rows(a[:half], b, False)[0], len(b))
        right = _prefix_lengths(_rows(a[half:][::-1], b[::-1], False)[0], len(b))
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        return [*common(a[:half], b[:cut]), *((i + half, j + cut) for i, j in common(a[half:], b[cut:]))]
    rows, out, j = _rows(a, b, True), [], len(b) - 1
    full = (1 << len(b)) - 1
    for i in range(len(a) - 1, -1, -1):
        before = rows[i - 1] if i else full
        while j >= 0:
            if rows[i] >> j & 1:  # no step at this place of b
                j -= 1
            elif not before >> j & 1:  # the step is there without a[i] too
                break
            else:
                out.append((i, j))
                j -= 1
                break
        if j < 0:
            break
    return out[::-1]
