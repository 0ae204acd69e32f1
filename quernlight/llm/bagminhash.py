"""BagMinHash signatures of multisets, for many documents at a time.

A weight is cut into the dyadic intervals [0,1), [1,2), [2,4), [4,8), ... that it reaches into. Each element and interval
has a Poisson process of its own, seeded by both, whose points carry a place within the interval and a component of the
signature; points beyond the weight are left out, so that equal parts of weights give equal points. A component's value
is the time of its first point. Two documents agree in a component with the probability of their weighted Jaccard
similarity, sum of minima over sum of maxima. Points come in order of time, and each document's are drawn only up to a
time by which its components are full, as a rule m * (log m + 4) of them whatever its length.
"""

from __future__ import annotations

import numpy as np

#: Times run to (log m + EXTRA) / weight at first; of texts e^-EXTRA need more.
EXTRA = 2.0
#: Bytes of text that are hashed in one go, about.
SEGMENT = 1 << 19
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _GOLD), ("down", _INVERSE)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data: UTF-8 of texts of words with one blank between them; bounds: where texts begin, and the end.

    The hash of each word, and the number of its text.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(data) > 2 * SEGMENT:  # parts that end at a blank, so that memory doesn't follow the longest text
        parts, a = [], 0
        while a < len(data):
            blanks = np.flatnonzero(data[a + SEGMENT :] == 32) if len(data) - a <= 3 * SEGMENT else np.flatnonzero(data[a + SEGMENT : a + 2 * SEGMENT] == 32)
            b = a + SEGMENT + int(blanks[0]) if len(blanks) else len(data)
            inside = bounds[(bounds > a) & (bounds < b)]
            h, owner = word_hashes_of(data[a:b], np.concatenate([[0], inside - a, [b - a]]))
            first = int(np.searchsorted(bounds, a, "right")) - 1
            parts.append((h, owner + first))
            a = b + 1  # the blank belongs to no word
        return tuple(np.concatenate(x) for x in zip(*parts))
    return word_hashes_of(data, bounds)


def word_hashes_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)])
    blank = data == 32
    opens = ~blank
    opens[1:] &= blank[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    opens[first] = True
    closes = ~blank
    closes[:-1] &= blank[1:]
    closes[bounds[1:][bounds[:-1] < bounds[1:]] - 1] = True
    opens, closes = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return mix((sums[closes] - sums[opens]) * down[opens]), np.searchsorted(bounds, opens, "right") - 1


def shingles(words: np.ndarray, owner: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and number of each distinct run of k words, ordered by text and hash."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _GOLD + words[j : j + n]
    inside = owner[:n] == owner[k - 1 :]
    h, text = mix(h[inside]), owner[:n][inside]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return h[at], text[at], np.diff(np.append(at, len(h)))


def signatures(h: np.ndarray, text: np.ndarray, weight: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """First times, n_texts x m, as floats; infinite for texts without elements."""
    times = np.full(n_texts * m, np.inf)
    if not len(h):
        return times.reshape(n_texts, m)
    # a process for each interval that a weight reaches into
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    rep = np.repeat(np.arange(len(h)), levels)
    level = np.arange(len(rep)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    size = np.where(level > 0, low, 1)
    seed = mix(h[rep] + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    owner, limit = text[rep], (weight[rep] - low) / size
    total = np.bincount(text, weight, n_texts)
    until = (np.log(m) + EXTRA) / np.maximum(total, 1)
    step = 1.0 / (m * size)
    at = np.zeros(len(seed))
    done = np.zeros(len(seed), np.int64)  # points drawn so far
    live = np.arange(len(seed))
    while True:
        parked = []
        # those that are alive have drawn equally many points, or are few
        alive = (seed[live], owner[live], step[live], limit[live], at[live], done[live], live)
        while len(alive[6]):
            s, o, d, w, t, n, k = alive
            n = n + 1
            z = mix(s + n.astype(np.uint64) * _GOLD)
            t = t - np.log(((z >> np.uint64(32)) + 0.5) / 4294967296.0) * d
            now = t <= until[o]
            late = ~now
            parked.append(k[late])
            s, o, d, w, t, n, k, z = (x[now] for x in (s, o, d, w, t, n, k, z))
            slot, when = o * m + ((z & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64), t
            if (part := w < 1).any():
                place = (mix(z[part] ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(11)) / 9007199254740992.0
                inside = ~part
                inside[part] = place < w[part]
                slot, when = slot[inside], when[inside]
            np.minimum.at(times, slot, when)
            at[k], done[k] = t, n
            alive = (s, o, d, w, t, n, k)
        open_ = np.isinf(times.reshape(n_texts, m)).any(1) & (total > 0)
        if not open_.any():
            return times.reshape(n_texts, m)
        # texts that aren't full get more time; a parked process draws its late point again
        until[open_] *= 1.5
        live = np.concatenate(parked)
        live = live[open_[owner[live]]]


def bands(times: np.ndarray, rows: int) -> np.ndarray:
    """A hash of each band of `rows` components, different for each band."""
    n, m = times.shape
    bits = times.view(np.uint64).reshape(n, m // rows, rows)
    out = np.broadcast_to(mix(np.arange(1, m // rows + 1, dtype=np.uint64) * _GOLD), (n, m // rows)).copy()
    for j in range(rows):
        out = mix(out * _GOLD + bits[:, :, j])
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets as (ordered hashes, numbers)."""
    (ha, na), (hb, nb) = a, b
    at = np.searchsorted(hb, ha)
    same = (at < len(hb)) & (hb[np.minimum(at, len(hb) - 1)] == ha) if len(hb) else np.zeros(len(ha), bool)
    low = int(np.minimum(na[same], nb[at[same]]).sum())
    high = int(na.sum() + nb.sum()) - low
    return low / high if high else 1.0


def similarities(h: np.ndarray, text: np.ndarray, weight: np.ndarray, n_texts: int, columns: int = 4096) -> np.ndarray:
    """Weighted Jaccard similarities of all pairs of n_texts texts, exactly.

    The sum of minima is a sum over thresholds of products of 0-1 matrices; only elements of two texts or more are
    multiplied, so the diagonal means nothing.
    """
    total = np.bincount(text, weight, n_texts)
    order = np.argsort(h, kind="stable")
    h, text, weight = h[order], text[order], weight[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(h) else new
    column, text, weight = column[shared], text[shared], weight[shared]
    low, last = np.zeros((n_texts, n_texts), np.float32), 0
    while len(column):
        level = int(weight.min())
        used, place = np.unique(column, return_inverse=True)
        for a in range(0, len(used), columns):
            part = (place >= a) & (place < a + columns)
            ones = np.zeros((n_texts, min(columns, len(used) - a)), np.float32)
            ones[text[part], place[part] - a] = 1
            low += np.float32(level - last) * (ones @ ones.T)
        last = level
        more = weight > level
        column, text, weight = column[more], text[more], weight[more]
    high = total[:, None] + total[None, :] - low
    return np.where(high > 0, low / np.maximum(high, 1), 1.0)
