"""Edit distance and character error rate.

Distances count code points. Short pairs use Spark's ``levenshtein``; long pairs go to an
Arrow UDF that keeps a whole column of the distance matrix in two integers (Myers 1999,
Hyyro 2003) and, for very long texts, only a band around the diagonal (Ukkonen 1985).
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Below this many matrix cells the built-in is faster than the trip to a Python worker.
BUILTIN_CELLS = 512 * 512
# From this length of the shorter text bounds and bands are tried first.
BAND_FROM = 512
SEGMENT = 128
# Rows on either side of the line from start to end that the upper bound looks at.
REACH = 64
COUNTER = (1 << 40) - 1
TOGETHER = 16


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _positions(text: str, shift: int = 0) -> dict[str, int]:
    """Bit set of positions for every character of ``text``."""
    codes = _codes(text)
    return {
        chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") << shift
        for c in np.unique(codes)
    }


def full_distances(patterns: list[str], text: str) -> list[int]:
    """Distances of several strings to one text, in one pass over the text.

    The patterns lie side by side in the bit sets with a guard bit after each, so the outputs
    of several models for one image share the interpreter's cost per character.
    """
    ones = starts = end = 0
    matches: dict[str, int] = {}
    spans = []
    for pattern in patterns:
        for ch, bits in _positions(pattern, end).items():
            matches[ch] = matches.get(ch, 0) | bits
        span = ((1 << len(pattern)) - 1) << end
        spans.append(span)
        ones |= span
        starts |= 1 << end
        end += len(pattern) + 1
    match = matches.get
    up, down = ones, 0
    for ch in text:
        x = match(ch, 0) | down
        diagonal = (((x & up) + up) ^ up) | x
        right = ((down | ((diagonal | up) ^ ones)) << 1) | starts
        up = (((diagonal & up) << 1) | ((diagonal | right) ^ ones)) & ones
        down = diagonal & right
    return [len(text) + (up & span).bit_count() - (down & span).bit_count() for span in spans]


def band_distances(patterns: list[str], text: str, bounds: list[int]) -> list[int | None]:
    """Distances of several strings to one text where they are within a bound, else None.

    Only the diagonals that a path within the bound can touch are kept, and the window slides
    with the text (Hyyro 2003). The windows lie side by side with room for one segment's slide.
    """
    ones = goals = up = end = 0
    lanes = []
    for pattern, bound in zip(patterns, bounds):
        gap = len(text) - len(pattern)
        reach = (bound - abs(gap)) // 2
        above, below = reach + max(gap, 0), reach + max(-gap, 0)
        width = above + below + 1
        window = (1 << width) - 1
        goal = end + above - gap
        lanes.append((_positions(pattern, above), (1 << (width + SEGMENT)) - 1, end, goal))
        ones |= window << end
        up |= ((window >> above) << above) << end
        goals |= 1 << goal
        end += width + SEGMENT + 1
    down = hits = seen = 0
    for start in range(0, len(text), SEGMENT):
        part = text[start : start + SEGMENT]
        local = dict.fromkeys(part, 0)
        for match, window, offset, _ in lanes:
            for ch in local.keys() & match.keys():
                local[ch] |= ((match[ch] >> start) & window) << offset
        for step, ch in enumerate(part):
            x = (local[ch] >> step) & ones
            diagonal = ((((x & up) + up) ^ up) | x | down) & ones
            right = down | ((diagonal | up) ^ ones)
            left = diagonal & up
            # One counter per window, far enough apart never to meet.
            hits += diagonal & goals
            diagonal >>= 1
            diagonal &= ones
            up = left | ((diagonal | right) ^ ones)
            down = diagonal & right
        seen += len(part)
        if all(seen - (hits >> goal & COUNTER) > bound for (_, _, _, goal), bound in zip(lanes, bounds)):
            return [None] * len(patterns)
    found = [
        max(len(p) - len(text), 0) + len(text) - (hits >> goal & COUNTER) for p, (_, _, _, goal) in zip(patterns, lanes)
    ]
    return [d if d <= bound else None for d, bound in zip(found, bounds)]


def path_bounds(patterns: list[str], text: str, reach: int = REACH) -> list[int]:
    """Cost of the best way to turn each string into the text among those near the line from start to end.

    Never below the distance, and often equal to it. The windows are those of ``band_distances``, but of one fixed height;
    after each segment they are put back on the line. Rows that come in cost one more than their neighbour, as any
    cell may, so every value is that of a real way.
    """
    height = 2 * reach + 1
    window, wide = (1 << height) - 1, (1 << (height + SEGMENT)) - 1
    room = height + SEGMENT + 1
    starts = [k * room for k in range(len(patterns))]
    ones = sum(window << s for s in starts)
    goals = sum(1 << (s + reach) for s in starts)
    bits = [1 << k for k in range(height + SEGMENT)]
    lows, values = [-reach] * len(patterns), [0] * len(patterns)
    up = sum(((window >> reach) << reach) << s for s in starts)
    down = 0
    for start in range(0, len(text), SEGMENT):
        part = text[start : start + SEGMENT]
        local = dict.fromkeys(part, 0)
        for pattern, low, offset in zip(patterns, lows, starts):
            found: dict[str, int] = {}
            for ch, bit in zip(pattern[max(low, 0) : max(low + height + SEGMENT, 0)], bits[max(-low, 0) :]):
                found[ch] = found.get(ch, 0) | bit
            for ch in local.keys() & found.keys():
                local[ch] |= found[ch] << offset
        hits = 0
        for step, ch in enumerate(part):
            x = (local[ch] >> step) & ones
            diagonal = ((((x & up) + up) ^ up) | x | down) & ones
            right = down | ((diagonal | up) ^ ones)
            left = diagonal & up
            hits += diagonal & goals
            diagonal >>= 1
            diagonal &= ones
            up = left | ((diagonal | right) ^ ones)
            down = diagonal & right
        seen = start + len(part)
        ups = downs = 0
        for k, (pattern, offset) in enumerate(zip(patterns, starts)):
            # The count of a window has the bits up to the next goal to itself.
            values[k] += len(part) - (hits >> (offset + reach) & ((1 << (SEGMENT - 1)) - 1))
            lows[k] += len(part)
            own_up, own_down = up >> offset & window, down >> offset & window
            line = seen * len(pattern) // len(text)
            slide = max(-reach, -len(part), min(reach, line - reach - lows[k]))
            if slide > 0:
                mask = (1 << slide) - 1
                values[k] += (own_up >> reach & mask).bit_count() - (own_down >> reach & mask).bit_count()
                own_up, own_down = own_up >> slide | mask << (height - slide), own_down >> slide
            elif slide < 0:
                mask = (1 << -slide) - 1
                values[k] -= (own_up >> (reach + slide) & mask).bit_count() - (own_down >> (reach + slide) & mask).bit_count()
                own_up, own_down = own_up << -slide & window, (own_down << -slide | mask) & window
            lows[k] += slide
            ups |= own_up << offset
            downs |= own_down << offset
        up, down = ups, downs
    return [v + abs(len(p) - low - reach) for v, p, low in zip(values, patterns, lows)]


def least_distance(pattern: np.ndarray, text: np.ndarray) -> int:
    """A bound from below, of code points: characters without a partner."""
    # Rare characters above the basic plane share their counts with others, which can only lower the bound.
    a, b = (np.bincount(x & 0xFFFF) for x in (pattern, text))
    size = max(a.size, b.size)
    surplus = np.pad(a, (0, size - a.size)) - np.pad(b, (0, size - b.size))
    return int(max(surplus[surplus > 0].sum(), -surplus[surplus < 0].sum()))


def _bounds(patterns: list[str], text: str) -> dict[str, tuple[int, int]]:
    """Bounds from below and above. The upper one is that of a single look at both, place by place or of all of the shorter
    text in order inside the longer one, if it meets the lower one, and else that of ``path_bounds``."""
    codes = _codes(text)
    found, apart = {}, []
    for p in patterns:
        own = _codes(p)
        low, high = least_distance(own, codes), max(len(p), len(text))
        if len(p) == len(text):
            high = int(np.count_nonzero(own != codes))
        elif low == abs(len(p) - len(text)):
            short, rest = min((p, text), key=len), iter(max((p, text), key=len))
            high = low if all(ch in rest for ch in short) else high
        found[p] = (low, high)
        if low < high and p and text:
            apart.append(p)
    for p, high in zip(apart, path_bounds(apart, text) if apart else ()):
        found[p] = (found[p][0], min(found[p][1], high))
    return found


def very_long_distances(patterns: list[str], text: str) -> list[int]:
    """Distances where both bounds meet, by a band as wide as the upper bound asks for the others; wide ones are done in full."""
    found: dict[str, int] = {}
    bounds = {}
    for p, (low, high) in _bounds(patterns, text).items():
        if low == high:
            found[p] = high
        else:
            bounds[p] = high
    narrow = [p for p in bounds if 3 * bounds[p] < 2 * min(len(p), len(text))]
    wide = [p for p in bounds if p not in narrow]
    found.update(zip(wide, full_distances(wide, text) if wide else ()))
    found.update(zip(narrow, band_distances(narrow, text, [bounds[p] for p in narrow]) if narrow else ()))
    return [found[p] for p in patterns]


def text_distances(texts: list[str], reference: str) -> list[int]:
    """Levenshtein distances with unit costs of several texts to one reference."""
    found = {text: 0 for text in texts if text == reference}
    others = list(dict.fromkeys(text for text in texts if text != reference))
    long = [text for text in others if min(len(text), len(reference)) >= BAND_FROM]
    short = [text for text in others if min(len(text), len(reference)) < BAND_FROM]
    found.update(zip(long, very_long_distances(long, reference)))
    found.update(zip(short, full_distances(short, reference) if short else ()))
    return [found[text] for text in texts]


@F.arrow_udf(T.IntegerType())
def long_distance(left: pa.Array, right: pa.Array) -> pa.Array:
    """Distance of long pairs. Neighbouring rows with the same right side are done together;
    the join by image leaves the outputs of all models for one image next to each other."""
    lefts, rights = left.to_pylist(), right.to_pylist()
    out: list[int | None] = [None] * len(lefts)
    todo = [i for i, pair in enumerate(zip(lefts, rights)) if None not in pair]
    for reference, rows in groupby(todo, key=rights.__getitem__):
        rows = list(rows)
        for some in (rows[i : i + TOGETHER] for i in range(0, len(rows), TOGETHER)):
            for i, found in zip(some, text_distances([lefts[i] for i in some], reference)):
                out[i] = found
    return pa.array(out, pa.int32())


def edit_distance(left: Column, right: Column, method: str = "auto") -> Column:
    """Code-point Levenshtein distance.

    ``method`` is ``auto`` (by size of the pair), ``builtin`` or ``arrow``. In ``auto`` the UDF
    gets null for the short pairs, so their text never leaves the JVM, and one plan serves both.
    """
    if method == "builtin":
        return F.levenshtein(left, right)
    if method == "arrow":
        return long_distance(left, right)
    if method != "auto":
        raise ValueError(f"unknown method {method!r}")
    small = F.length(left).cast("long") * F.length(right) <= BUILTIN_CELLS
    large = ~small & (left != right)
    return (
        F.when(left == right, F.lit(0))
        .when(small, F.levenshtein(left, right))
        .otherwise(long_distance(F.when(large, left), F.when(large, right)))
    )


def cer(distance: Column, inference_length: Column, reference_length: Column) -> Column:
    """Distance over reference length; an empty reference gives 0 or 1. May exceed 1."""
    return F.when(
        reference_length == 0, F.when(inference_length == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    ).otherwise(distance / reference_length)


def round6(value: Column) -> Column:
    """Six decimals, half to even."""
    return F.bround(value, 6)
