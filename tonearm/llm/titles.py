"""What a track title says, apart from how it is written."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

#: Letters of other scripts that are drawn like Latin ones (fixed values).
LOOKALIKES = str.maketrans(
    "аеорсухікмтвнАЕОРСУХІКМТВНαοερτυνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxikmtbhaeopcyxikmtbhaoeptyvikabezhikmnoptyx",
)
#: Remarks on the edition, which leave the recording the same (fixed values).
EDITION = (
    r"(?:(?:19|20)\d\d\W*)?(?:digital(?:ly)?\W*)?remaster(?:ed)?(?:\W*version)?(?:\W*(?:19|20)\d\d)?(?:\W*version)?"
    r"|(?:album|single|original|lp|radio|explicit|clean|mono|stereo)\W*(?:version|edit|mix)"
    r"|explicit|clean|mono|stereo|bonus\W*track|(?:deluxe|special|expanded|anniversary)(?:\W*edition)?"
)
_BRACKETED = re.compile(rf"[(\[]\W*(?:{EDITION}|(?:feat|ft|featuring|with)\W[^)\]]*)\W*(?:[)\]]|$)")
_TRAILING = re.compile(rf"(?<=\w)\W+(?:{EDITION})\W*$")
_CREDIT = re.compile(r"[\s(\[,_.-]+(?:feat|ft|featuring)(?:\.|\W)\W*\w.*$")
_PART = re.compile(r"(?<![a-z])(?:pt|part|no|nr|vol|volume|chapter|op|act)\W*([ivx]+|\d+)\W*$")
_MAY_REMARK = re.compile("remaster|version|edit|mix|explicit|clean|mono|stereo|bonus|deluxe|special|expanded|anniversary")
_WORDS = re.compile(r"[^\W_]+")
_APOSTROPHES = str.maketrans("", "", "'’`")
_DIGITS = re.compile(r"\d+")
_ROMAN = {"i": 1, "v": 5, "x": 10}
_ELLIPSIS = re.compile(r"(?:…|\.\.\.+)\W*$")


#: Short ways of writing small words, and the words (fixed values).
SHORT_WORDS = (("&", " and "), ("+", " and "), ("n'", "and"), ("n’", "and"), ("o'", "of"), ("o’", "of"), ("th'", "the"), ("th’", "the"))


@lru_cache(maxsize=None)
def _short(written: str) -> re.Pattern[str]:
    return re.compile(re.escape(written) if len(written) == 1 else rf"(?<!\w){re.escape(written)}(?!\w)")


#: A version or part named at the end of a title: two titles that differ in it are different (fixed values).
_VERSION = re.compile(
    r" (?:live|(?:club |extended |radio )?remix|instrumental|acoustic|demo|unplugged|karaoke|cover"
    r"|(?:pt|part|no|nr|vol|volume|chapter|op|act) ?(?:[ivx]+|\d+)|\d+)$"
)


class Title(NamedTuple):
    """``letters``: folded letters and digits; ``words``: the same in words; ``numbers``: part and other
    numbers; ``cut``: does it end in an ellipsis?"""

    letters: str
    words: str
    numbers: str
    cut: bool


def _roman(text: str) -> int:
    values = [_ROMAN[c] for c in text]
    return sum(-v if any(w > v for w in values[i + 1 :]) else v for i, v in enumerate(values))


def plain(text: str) -> str:
    """Lower case without accents, compatibility forms and look-alike letters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(LOOKALIKES))
        text = "".join(c for c in text if not unicodedata.combining(c))
    return text.lower()


def read_title(text: str | None) -> Title:
    """Null and blank titles have no letters."""
    core = plain(text or "").replace("_", " ").strip()
    cut = ("." in core or "…" in core) and bool(_ELLIPSIS.search(core))
    if "(" in core or "[" in core:
        core = _BRACKETED.sub(" ", core)
    if _MAY_REMARK.search(core):
        core = _TRAILING.sub("", core)
    if "feat" in core or "ft" in core:
        core = _CREDIT.sub("", core)
    for written, meant in SHORT_WORDS:
        if written in core:
            core = _short(written).sub(meant, core)
    words = _WORDS.findall(core.translate(_APOSTROPHES))
    if "and" in words and len(words) > 1:  # "&" is left out as often as it is written
        words = [w for w in words if w != "and"] or words
    numbers = _DIGITS.findall(core)
    part = _PART.search(core)
    if part and not part.group(1).isdigit():
        numbers.append(str(_roman(part.group(1))))
    return Title("".join(words), " ".join(words), ",".join(n.lstrip("0") or "0" for n in numbers), cut)


def slips(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from ``a`` to ``b``; ``most + 1`` if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    low = 0
    top = min(len(a), len(b))
    while low < top and a[low] == b[low]:
        low += 1
    while top > low and a[len(a) - 1 - (min(len(a), len(b)) - top)] == b[len(b) - 1 - (min(len(a), len(b)) - top)]:
        top -= 1
    tail = min(len(a), len(b)) - top
    a, b = a[low : len(a) - tail], b[low : len(b) - tail]
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def most_slips(length: int) -> int:
    return 1 if length < 8 else 2 if length < 20 else 3


def same_title(a: Title, b: Title) -> bool:
    """The same title apart from slips, habits of writing and a cut end."""
    if not a.letters or not b.letters:
        return False
    if a.numbers == b.numbers:
        if a.letters == b.letters:
            return True
        allowed = most_slips(min(len(a.letters), len(b.letters)))
        if slips(a.letters, b.letters, allowed) <= allowed and _words_agree(a, b):
            return True
    return _cut_end(a, b) or _cut_end(b, a)


def _words_agree(a: Title, b: Title) -> bool:
    """Is every changed word a slip of the other, not another word?"""
    left, right = a.words.split(), b.words.split()
    if len(left) != len(right):
        return True
    return all(slips(x, y, 2) <= (1 if min(len(x), len(y)) < 5 else 2) for x, y in zip(left, right) if x != y)


def _cut_end(short: Title, long: Title) -> bool:
    """Is ``short`` the beginning of ``long``, cut inside a word or with an ellipsis?"""
    n = len(short.letters)
    if n < 6 or n >= len(long.letters) or n * 2 < len(long.letters):
        return False
    if not long.letters.startswith(short.letters):
        return False
    if short.numbers and short.numbers != long.numbers:
        return False
    version = _VERSION.search(long.words)
    if version and n <= len(long.words[: version.start()].replace(" ", "")):
        return False  # the cut is not inside the version: it is the title without one
    if short.cut:
        return True
    ends = 0
    for word in long.words.split():
        ends += len(word)
        if ends == n:
            return False
    return True
