"""Skip-and-fold table, rolling hashes over UTF-8 bytes and skipping comparison.

Nothing here builds a canonical string: hashes stream over the bytes of the Arrow
buffer, comparisons over the text as it is written, and both step over what does
not count. A letter counts as its folded base letter and its accents, so either
spelling of an accented letter (one code point or several) is the same.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Two independent odd multipliers of the rolling polynomials.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
PAGE = 256
#: Most units one code point decomposes into.
MOST_UNITS = 4
#: Added to a unit before it is mixed; accents have a number space of their own.
_LETTER, _ACCENT = 0x51ED270B, 0x2545F49140000000


def fold_char(ch: str) -> tuple[str, str]:
    """What ``ch`` counts as: its folded letters or digits, and its accents; both empty if it is skipped.

    Letters, decimal digits and combining marks (accents) count; variation selectors do not.
    """
    letters, accents = "", ""
    for part in unicodedata.normalize("NFD", ch):
        kind = unicodedata.category(part)
        if kind[0] == "M":
            if not ("︀" <= part <= "️" or "\U000e0100" <= part <= "\U000e01ef"):
                accents += part
        elif kind[0] == "L" or kind == "Nd":
            letters += next((f for f in (part.casefold(), part.lower()) if len(f) == 1), part)
    return letters, accents


class FoldTable:
    """Code point -> its units, pages built on first use.

    ``first`` holds the only unit of a code point that counts as one letter, 0 if it is skipped; code points that
    count as anything else are marked in ``several`` and have up to ``MOST_UNITS`` units in ``units``.
    """

    def __init__(self) -> None:
        self.first = np.zeros(0x110000, np.uint32)
        self.several = np.zeros(0x110000, bool)
        self.built = np.zeros(0x110000 // PAGE, bool)
        self.units: dict[int, tuple[list[int], list[bool]]] = {}

    def build(self, points: np.ndarray) -> None:
        pages = np.unique(points >> 8)
        for page in pages[~self.built[pages]].tolist():
            for cp in range(page * PAGE, (page + 1) * PAGE):
                letters, accents = fold_char(chr(cp))
                if len(letters) == 1 and not accents:
                    self.first[cp] = ord(letters)
                elif letters or accents:
                    self.several[cp] = True
                    self.units[cp] = ([ord(c) for c in letters + accents], [False] * len(letters) + [True] * len(accents))
            self.built[page] = True

    def fold(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The units of all code points, which of them are accents, and the code point each belongs to."""
        self.build(points)
        odd = np.flatnonzero(self.several[points])
        if not len(odd):
            at = np.flatnonzero(self.first[points])
            return self.first[points[at]], np.zeros(len(at), bool), at
        known, which = np.unique(points[odd], return_inverse=True)
        values = np.zeros((len(known), MOST_UNITS), np.uint32)
        marks = np.zeros((len(known), MOST_UNITS), bool)
        sizes = np.zeros(len(known), np.int64)
        for i, cp in enumerate(known.tolist()):
            units, accents = self.units[cp]
            sizes[i] = len(units)
            values[i, : len(units)], marks[i, : len(units)] = units, accents
        count = (self.first[points] != 0).astype(np.int64)
        count[odd] = sizes[which]
        at = np.repeat(np.arange(len(points)), count)
        unit, accent = self.first[points[at]], np.zeros(len(at), bool)
        begins = np.cumsum(count) - count
        for k in range(MOST_UNITS):
            has = sizes[which] > k
            place = begins[odd[has]] + k
            unit[place], accent[place] = values[which[has], k], marks[which[has], k]
        return unit, accent, at


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string column, decoded from its UTF-8 buffer, and where each row begins (n + 1 offsets).

    Null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    size = 8 if wide else 4
    if not len(column) or data is None:
        return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, "<i8" if wide else "<i4", len(column) + 1, column.offset * size).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if not (raw & 0x80).any():
        return raw.astype(np.uint32), ends
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    padded = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.uint32)
    b = padded[lead]
    points = b.copy()
    tails = [padded[lead + i] & 0x3F for i in (1, 2, 3)]
    two, three, four = (b >= 0xC0) & (b < 0xE0), (b >= 0xE0) & (b < 0xF0), b >= 0xF0
    points[two] = ((b & 0x1F) << 6 | tails[0])[two]
    points[three] = ((b & 0x0F) << 12 | tails[0] << 6 | tails[1])[three]
    points[four] = ((b & 0x07) << 18 | tails[0] << 12 | tails[1] << 6 | tails[2])[four]
    return points, np.searchsorted(lead, ends)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of hashes do not cancel."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling_hashes(column: pa.Array, table: FoldTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two polynomial hashes (mod 2^64) of each row's counted characters, and how many letters and digits count.

    An accent is added at the place of its letter, so the order of several accents on one letter is no difference.
    """
    points, offsets = code_points(column)
    unit, accent, at = table.fold(points)
    bounds = np.searchsorted(at, offsets)
    size = np.diff(bounds)
    letters = np.concatenate([[0], np.cumsum(~accent)])
    counts = letters[bounds[1:]] - letters[bounds[:-1]]
    place = letters[1:] - np.repeat(letters[bounds[:-1]], size)  # from 1; 0 for an accent before any letter
    values = mix(unit.astype(np.uint64) + np.where(accent, np.uint64(_ACCENT), np.uint64(_LETTER)))
    longest = int(counts.max()) if len(counts) else 0
    out = []
    for base in BASES:
        powers = np.ones(longest + 1, np.uint64)
        if longest:
            powers[1:] = np.multiply.accumulate(np.full(longest, base, np.uint64))
        sums = np.zeros(len(unit) + 1, np.uint64)
        np.cumsum(values * powers[place], out=sums[1:])
        out.append(sums[bounds[1:]] - sums[bounds[:-1]])
    return out[0], out[1], counts


_folded_chars: dict[str, tuple[str, str]] = {}


def _counted(text: str) -> Iterator[str]:
    """The letters and digits that count, each followed by its accents in a fixed order."""
    known = _folded_chars
    held = ""
    for ch in text:
        out = known.get(ch)
        if out is None:
            out = known[ch] = fold_char(ch)
        letters, accents = out
        if letters:
            if held:
                yield from sorted(held)
            held = ""
            yield from letters
        held += accents
    yield from sorted(held)


def same_skipping(a: str | None, b: str | None) -> bool:
    """Do two texts agree in the characters that count? Two pointers, no canonical copies."""
    if a == b:
        return True
    left, right = _counted(a or ""), _counted(b or "")
    for x in left:
        if x != next(right, ""):
            return False
    return next(right, "") == ""
