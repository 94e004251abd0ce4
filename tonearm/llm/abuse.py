"""Scores for abusive, hateful or sexual language, disguised or not.

Method. The lexicon's words form a trie. Each unknown token of a text is read by a
Levenshtein automaton that walks the trie with it, so that a misspelled, masked,
stretched or number-written word costs one walk, not a comparison with every
term; homoglyphs, letter-by-letter spelling and broken lines are undone before.
Every word becomes a symbol for the classes it belongs to; rules over classes find
abuse with its target, and a window around each finding separates reporting or
denying it from using it. A text's score is that of its worst passage.

Two parts: rules from general knowledge of the languages (``llm.lexicon``), and
phrases a corpus uses, learned from a bounded sample of its rated documents
(``learn_phrases``). Whole texts are read, in time linear in their length.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.lexicon import CLASSES, RULES
from tonearm.llm.tokens import read_ranks
from tonearm.session import spread

#: Score from which a text counts as abusive.
THRESHOLD = 1.0
#: Words either side of a finding in which reporting or denying it lowers its score.
WINDOW = 10
#: Share of a masked word's letters that must be left for it to be abuse alone, and not only as part of a phrase.
SURE_LETTERS = 0.6
#: Rank up to which a word is too common to screen by.
COMMON = 300
#: Tokens remembered per worker; others are read again, with equal results.
CACHE_SIZE = 500_000
CATEGORIES = ("insult", "threat", "group", "sexual", "learned")
#: Public vocabularies whose whole words are ordinary words, never read as misspelled terms.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Rated documents phrases are learned from, at most; the sample is chosen by a hash of the document's id.
MAX_RATED = 20_000
#: Words of a learned phrase; so many of them must be of this rank or rarer, or the phrase says nothing by itself.
PHRASE_WORDS, CONTENT_WORDS, FREQUENT = (3, 4, 5), 2, 1000
#: Rated documents that must hold a phrase, and the share of them its raters call abusive: the lower bound of Wilson's
#: interval at so many standard deviations.
LEAST_DOCUMENTS, LEAST_SHARE, DEVIATIONS = 4, 0.5, 1.64

_LATIN = str.maketrans("аеорсухіїєкмтвнзԁգһјӏѕґ", "aeopcyxiiekmtbh3dqhjlsr")
_DIGIT_LETTERS = str.maketrans("0134578$@!", "oieastbsai")
_MASKS = "*#@$€%&"


# ---- undoing disguises of the writing ------------------------------------------------------------------------------

_BREAK_PAGE = re.compile(r"(?<=[^\W\d_])\s*\n\s*[–—-]\s*\d+\s*[–—-]\s*\n\s*(?=[^\W\d_])|(?<=[^\W\d_]) [–—] \d+ [–—] (?=[^\W\d_])")
_PAGE_MARK = re.compile(r"[–—-]\s*\d+\s*[–—-]")
_BREAK_LINE = re.compile(r"(?<=[^\W\d_])-\s*\n\s*(?=[^\W\d_])|(?<=[^\W\d_])- (?=[^\W\d_])")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_]([ .\-_*·]))(?:[^\W\d_]\1){1,}[^\W\d_](?![^\W_])")
_MOJIBAKE = re.compile("[ÃÂ][\u0080-¿Œ-™]")
_PASSAGE = re.compile(r"[.!?;…]+(?=[\s\"'”’)\]»–—]|$)|[\n\[\]()]+|\s[–-]\s|\s[–-]$|^[–-]\s")
_TOKEN = re.compile(r"[^\W_](?:[\w*#@$€%&!'’]*[\w*#@$€%&])?|[*#@$€%&]+\w[\w*#@$€%&]*|[:,\"“”„«»]")
_BOUNDS = frozenset(":\"“”„«»")
_LONE = frozenset("aAiIuUoOаАоОіІуУвВзЗяЯйЙєЄàÀyY")


def _repair(match: re.Match[str]) -> str:
    try:
        return match.group(0).encode("cp1252").decode("utf-8")
    except (UnicodeDecodeError, UnicodeEncodeError):
        return match.group(0)


def clean(text: str) -> str:
    """The text without invisible characters and mis-decoded letters."""
    if text.isascii():
        return text
    text = _INVISIBLE.sub("", text)
    return _MOJIBAKE.sub(_repair, text) if "Ã" in text or "Â" in text else text


def passages(text: str, joint: str = "") -> list[str]:
    """A cleaned text in passages, what a line or page break parts joined by ``joint``."""
    if may_be_broken(text):
        text = _BREAK_LINE.sub(joint, _BREAK_PAGE.sub(joint, text))
    return _PASSAGE.split(text)


def may_be_broken(text: str) -> bool:
    return "- " in text or "-\n" in text or _PAGE_MARK.search(text) is not None


def joined_letters(passage: str) -> str:
    """The passage with spelled-out words joined."""
    return _SPELLED.sub(lambda m: m.group(0).replace(m.group(1), ""), passage)


def tokens(passage: str) -> list[str]:
    return _TOKEN.findall(passage.replace("’", "'").replace("-", " "))


def fold_token(token: str) -> str:
    """Lower case, no accents, no apostrophes; a word of mixed scripts is read as Latin."""
    low = token.lower().replace("'", "")
    if low.isascii():
        return low
    low = low.replace("ß", "ss")
    if any("a" <= c <= "z" for c in low):
        low = low.translate(_LATIN)
    elif low.translate(_LATIN).isascii() and low.translate(_LATIN).isalpha():
        low = low + "|" + low.translate(_LATIN)  # either script could be meant
    if any("Ѐ" <= c <= "ӿ" for c in low):
        return low
    return "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))


# ---- Levenshtein automaton and trie --------------------------------------------------------------------------------


class Trie:
    def __init__(self, words: Iterable[str]) -> None:
        self.root: dict = {}
        for word in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = word

    def read(self, token: str, budget: int) -> list[str]:
        """The words within ``budget`` edits, nearest first; masks in the token stand for any letter.

        A state of the automaton is the row of distances to the token's prefixes,
        given the letters walked so far; branches whose row exceeds the budget end.
        """
        n = len(token)
        found: list[tuple[int, str]] = []
        stack = [(self.root, list(range(n + 1)), None, "")]
        while stack:
            node, row, before, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[n] <= budget:
                        found.append((row[n], child))
                    continue
                new = [row[0] + 1]
                low = new[0]
                for j in range(1, n + 1):
                    t = token[j - 1]
                    v = row[j - 1] if t == c or t in _MASKS else row[j - 1] + 1
                    if row[j] + 1 < v:
                        v = row[j] + 1
                    if new[-1] + 1 < v:
                        v = new[-1] + 1
                    if before is not None and j > 1 and t == last and token[j - 2] == c and before[j - 2] + 1 < v:
                        v = before[j - 2] + 1
                    new.append(v)
                    if v < low:
                        low = v
                if low <= budget:
                    stack.append((child, new, row, c))
        return [w for _, w in sorted(found)]


def _shortened(word: str, most: int) -> set[str]:
    """The word with up to ``most`` letters left out."""
    out, last = {word}, {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


class Reader:
    """Reads tokens as words of the lexicon, or as themselves.

    Two words within k edits of each other have a form in common with up to k letters
    left out of each; tokens without such a form are not given to the automaton.
    """

    def __init__(self, words: set[str], ordinary: dict[str, int]) -> None:
        self.words, self.ordinary = words, ordinary
        self.trie = Trie(sorted(w for w in words if len(w) > 2))
        long = [w for w in words if len(w) > 3]
        self.near = {1: frozenset().union(*(_shortened(w, 1) for w in long)), 2: frozenset().union(*(_shortened(w, 2) for w in long if len(w) > 6))}
        self.known: dict[str, tuple[str, ...]] = {}

    def read(self, token: str) -> tuple[str, ...]:
        """The lexicon words the token may be (several if letters are masked or slips equally near), or itself, folded."""
        out = self.known.get(token)
        if out is None:
            out = tuple(self._read(token))
            if len(self.known) < CACHE_SIZE:
                self.known[token] = out
        return out

    def is_ordinary(self, form: str) -> bool:
        known = self.ordinary
        return form in known or any(form.endswith(e) and form[: -len(e)] in known for e in ("s", "es", "d", "ed", "ing", "er", "ly", "n", "en", "e"))

    def walk(self, form: str, budget: int) -> list[str]:
        near = self.near[budget]
        return self.trie.read(form, budget) if any(s in near for s in _shortened(form, budget)) else []

    def _read(self, token: str) -> list[str]:
        folded = fold_token(token)
        for form in folded.split("|"):
            if form in self.words:
                return [form]
        form = folded.split("|")[-1] if "|" in folded else folded
        if self.is_ordinary(form):
            return [form]
        if any(c.isdigit() or c == "!" for c in form) and any(c.isalpha() for c in form):
            form = form.translate(_DIGIT_LETTERS) if not any(c in "*#" for c in form) else form
            if form in self.words:
                return [form]
        if any(c in _MASKS for c in form[1:]):
            if len(form) > 2 and (masked := self.trie.read(form, 0)):
                sure = sum(c not in _MASKS for c in form) >= SURE_LETTERS * len(form)
                return masked if sure else [w + "?" if w in _ALONE else w for w in masked]
        short = re.sub(r"([^\W\d_])\1{2,}", r"\1", form)
        if short != form:
            if short in self.words:
                return [short]
            double = re.sub(r"([^\W\d_])\1{2,}", r"\1\1", form)
            if double in self.words:
                return [double]
            form = short
        letters = sum(c.isalpha() for c in form)
        if letters < 4 or letters != len(form) or self.is_ordinary(form):
            return [form]
        near = self.walk(form, 1)
        if not near and letters >= 9:
            near = self.walk(form, 2)
        if token[:1].isupper() and not token.isupper():  # a name, or a noun
            near = [w for w in near if w in _NOUNS]
        return [w for w in near if len(w) > 3 and (w[0] == form[0] or len(w) > 5 and w[1:3] == form[1:3])] or [form]


@lru_cache(maxsize=4)
def ordinary_words(vocabularies: tuple[str, ...]) -> dict[str, int]:
    """Whole words of the vocabularies and their rank in the first that has them: rarer words have higher ranks."""
    out: dict[str, int] = {}
    for path in vocabularies:
        for token, rank in read_ranks(path).items():
            word = token.decode("utf-8", "ignore")
            if word[:1] == " " and word[1:].isalpha():
                for form in fold_token(word[1:]).split("|"):
                    out.setdefault(form, rank)
    return out


# ---- rules ---------------------------------------------------------------------------------------------------------

_CLASSES = {name: frozenset(words.replace("'", "").split()) for name, words in CLASSES.items()}
#: Words that are abuse alone, and nouns for a person, which may be capitalised.
_ALONE = frozenset().union(*(_CLASSES[c] for c in ("STRONG", "SLUR", "STARK", "FORT", "ЛАЙКА")))
_NOUNS = _ALONE.union(*(_CLASSES[c] for c in ("INSULT", "SCHIMPF", "INJURE", "ЗВІР")))
#: Symbols of words that no class has, of names, and of punctuation that ends a clause.
_OTHER, _NAME, _BOUND = "o", "n", "|"


def _items(rule: str) -> list[tuple[frozenset[str], str, bool]]:
    """(words, quantifier, is NAME in it) of every item; gaps and anchors have no words."""
    out = []
    for part in rule.split():
        if part in ("_", "__", "^", "$"):
            out.append((frozenset(), part, False))
            continue
        quantifier = part[-1] if part[-1] in "?*+" else ""
        names = part.rstrip("?*+").split("|")
        words = frozenset().union(*(_CLASSES.get(n, frozenset([n])) for n in names if n not in ("NAME", "$")))
        out.append((words, quantifier + ("$" if "$" in names else ""), "NAME" in names))
    return out


class Rule(NamedTuple):
    category: str
    weight: float
    needs: int  # bits of the items it cannot do without, as far as they are rare enough to screen by
    pattern: re.Pattern[str]
    pattern_of_several: re.Pattern[str]


class Judge:
    """Scores a text: the worst passage, by category."""

    def __init__(
        self, vocabularies: tuple[str, ...] = VOCABULARIES, phrases: Iterable[tuple[str, ...]] = (), rules: Iterable[tuple[str, float, str]] = tuple(RULES)
    ) -> None:
        read = [(c, w, _items(r)) for c, w, r in rules]
        self.phrases = frozenset(phrases)
        lexicon = frozenset().union(*_CLASSES.values(), *(words for _, _, items in read for words, _, _ in items))
        ordinary = ordinary_words(vocabularies)
        learned = frozenset(w for p in self.phrases for w in p if len(w) > 3)
        self.reader = Reader(set(lexicon | learned), {w: r for w, r in ordinary.items() if w not in lexicon})
        self.rank = lambda word: ordinary.get(word, 10**6)
        self.symbols = self._symbols(read, lexicon)
        self.numbers: dict[tuple[frozenset[str], bool], int] = {}
        self.bits: dict[str, int] = {}
        self.begins: dict[str, list[int]] = {}
        self.rules = [self._rule(i, *r) for i, r in enumerate(read)]
        self.needs = [rule.needs for rule in self.rules]
        for phrase in sorted(self.phrases):  # phrases are screened for like rules
            self.needs.append(self._need(len(self.needs), {frozenset([w]): self.rank(w) for w in phrase}, True))
        self.report, self.said, self.deny = _CLASSES["REPORT"], _CLASSES["SAID"], _CLASSES["NOT"]
        #: For every token between blanks the bits and rules its words bring; plain ones bring nothing and are kept apart.
        self.known: dict[str, tuple[int, frozenset[int]] | None] = {}
        self.plain: set[str] = set()

    @staticmethod
    def _symbols(rules: list, lexicon: frozenset[str]) -> dict[str, str]:
        """One symbol for all words that the same items of the rules take; unsure words (``w?``) are taken by no rule alone."""
        alone = {items[0][0] for _, _, items in rules if len(items) == 1}
        takers: dict[str, list[int]] = {w: [] for w in (*lexicon, *(w + "?" for w in _ALONE))}
        for i, words in enumerate(dict.fromkeys(words for _, _, items in rules for words, _, _ in items)):
            for w in words:
                takers[w].append(i)
                if w in _ALONE and words not in alone:
                    takers[w + "?"].append(i)
        numbers: dict[tuple[int, ...], str] = {}
        return {w: numbers.setdefault(tuple(t), chr(0x4E00 + len(numbers))) for w, t in takers.items()}

    def _rule(self, number: int, category: str, weight: float, items: list[tuple[frozenset[str], str, bool]]) -> Rule:
        """Compiles a rule and notes the words it cannot do without; it is looked for where the rarest of them stand."""
        rarity = {words: min(self.rank(w) for w in words) for words, q, name in items if words and q in ("", "+") and not name}
        needs = self._need(number, rarity, len(items) == 1)
        return Rule(category, weight, needs, self._pattern(items, False), self._pattern(items, True))

    def _need(self, number: int, rarity: dict[frozenset[str], int], sure: bool) -> int:
        """Bits of the sets of words a rule needs, the common ones left out; it begins with the rarest set."""
        trigger = max(rarity, key=lambda words: (rarity[words], min(words)))
        needs = 0
        for words, rank in rarity.items():
            if words is trigger or rank >= COMMON:
                bit = self.numbers.setdefault((words, sure), len(self.numbers))
                needs |= 1 << bit
                for w in words if sure else words | {w + "?" for w in words & _ALONE}:
                    self.bits[w] = self.bits.get(w, 0) | 1 << bit
                    if words is trigger:
                        self.begins.setdefault(w, []).append(number)
        return needs

    def _pattern(self, items: list[tuple[frozenset[str], str, bool]], several: bool) -> re.Pattern[str]:
        """A rule over symbols; ``several``: words are written as ``(symbols of all readings)``."""
        anything = r"\([^)|]*\)" if several else r"[^|]"
        gaps = {"_": rf"(?:{anything}){{0,3}}?", "__": rf"(?:{anything}){{0,6}}?", "^": r"(?:^|(?<=\|))", "$": r"(?=\||$)"}
        out = []
        for words, quantifier, name in items:
            if not words and not name:
                out.append(gaps[quantifier])
                continue
            unsure = () if len(items) == 1 else (w + "?" for w in words & _ALONE)
            chars = "".join(sorted({self.symbols[w] for w in (*words, *unsure)})) + (_NAME if name else "")
            piece = rf"\([^)|]*[{chars}][^)|]*\)" if several else f"[{chars}]"
            if "$" in quantifier:
                piece = rf"(?:{piece}|(?=\||$))"
            out.append({"?": rf"(?:{piece})?", "*": rf"(?:{piece}){{0,3}}", "+": rf"(?:{piece}){{1,3}}"}.get(quantifier[:1], piece))
        return re.compile("".join(out))

    def _symbol(self, token: str, word: str) -> str:
        symbol = self.symbols.get(word)
        if symbol is None:
            named = token[:1].isupper() and not self.reader.is_ordinary(word) and word.isalpha()
            symbol = _NAME if named else _OTHER
        return symbol

    def _brought(self, words: Iterable[str]) -> tuple[int, frozenset[int]]:
        """The bits words bring and the rules (and phrases, numbered after them) that begin with them."""
        bits, rules = 0, []
        for w in words:
            bits |= self.bits.get(w, 0)
            rules += self.begins.get(w, ())
        return bits, frozenset(rules)

    def _raw(self, raw: str) -> tuple[int, frozenset[int]]:
        """What a token between blanks brings; rule -1 stands for a disguise, which has to be undone first."""
        core = raw.strip(".,;:!?…\"'“”„«»()[]’")
        if len(core) == 1 and core.isalpha() and core not in _LONE:
            return 0, frozenset([-1])  # a letter of a spelled-out word
        if raw[-1] == "-" or "Ã" in raw or "Â" in raw or _INVISIBLE.search(raw):
            return 0, frozenset([-1])
        return self._brought(w for t in tokens(joined_letters(raw)) if t not in _BOUNDS and t != "," for w in self.reader.read(t))

    def is_plain(self, text: str) -> bool:
        """A cheap screen: no rule finds all the words it needs among the text's tokens, however written."""
        known, plain = self.known, self.plain
        bits, rules = 0, []
        for raw in set(text.split()) - plain:
            brought = known.get(raw)
            if brought is None:
                brought = self._raw(raw)
                if len(known) + len(plain) < CACHE_SIZE:
                    if brought[0] or brought[1]:
                        known[raw] = brought
                    else:
                        plain.add(raw)
            bits |= brought[0]
            if brought[1]:
                rules.append(brought[1])
        if not rules:
            return True
        needs = self.needs
        return not any(i < 0 or needs[i] & bits == needs[i] for own in rules for i in own)

    def words(self, passage: str) -> list[str]:
        """The words of a passage as they are read, the first reading of each."""
        return [self.reader.read(t)[0] for t in tokens(passage) if t not in _BOUNDS and t != ","]

    def passage(self, passage: str) -> dict[str, float]:
        """Scores of the worst reading; a rule takes of each word whichever reading it asks for."""
        found = [t for t in tokens(passage) if t != ","]
        readings = [(t,) if t in _BOUNDS else self.reader.read(t) for t in found]
        bits, candidates = self._brought(w for r in readings for w in r)
        candidates = [i for i in candidates if self.needs[i] & bits == self.needs[i]]
        scores: dict[str, float] = {}
        if any(i >= len(self.rules) for i in candidates):
            words = [r[0] for t, r in zip(found, readings) if t not in _BOUNDS]
            grams = (tuple(words[i : i + n]) for n in PHRASE_WORDS for i in range(len(words) - n + 1))
            if any(g in self.phrases for g in grams):
                scores["learned"] = 1.0
        rules = [self.rules[i] for i in candidates if i < len(self.rules)]
        if not rules:
            return scores
        several = any(len(r) > 1 for r in readings)
        spots = [_BOUND if t in _BOUNDS else "".join(self._symbol(t, w) for w in r) for t, r in zip(found, readings)]
        if several:
            spots = [s if s == _BOUND else f"({s})" for s in spots]
        joined, ends = "".join(spots), list(accumulate(len(s) for s in spots))
        for rule in rules:
            for match in (rule.pattern_of_several if several else rule.pattern).finditer(joined):
                if match.end() > match.start():
                    first, last = bisect_right(ends, match.start()), bisect_left(ends, match.end())
                    value = rule.weight * self.context(readings, first, last, rule.category)
                    scores[rule.category] = max(scores.get(rule.category, 0.0), value)
        return scores

    def context(self, readings: list[tuple[str, ...]], first: int, last: int, category: str) -> float:
        """1 where language is used; less where the words around it report it, or deny it of a group."""
        inside = [w for r in readings[first : last + 1] for w in r]
        before = [w for r in readings[max(0, first - WINDOW) : first] for w in r]
        after = [w for r in readings[last + 1 : last + 1 + WINDOW] for w in r]
        if category == "group" and not self.deny.isdisjoint([w for r in readings[max(0, first - 2) : first] for w in r]):
            return 0.3
        if self.report.issuperset(inside):
            return 1.0
        return 0.5 if not (self.report.isdisjoint(before + after) and self.said.isdisjoint(before)) else 1.0

    def passages(self, text: str) -> Iterator[str]:
        """The passages of a text in which abuse may begin, in each way broken lines can be read."""
        text = clean(text)
        broken = may_be_broken(text)
        if not broken and self.is_plain(text):
            return
        for joint in ("", " ") if broken and (_BREAK_PAGE.search(text) or _BREAK_LINE.search(text)) else ("",):
            for passage in passages(text, joint):
                if passage and not self.is_plain(passage):
                    yield joined_letters(passage)

    def score(self, text: str | None) -> list[float]:
        """One score per category, in the order of ``CATEGORIES``."""
        total = dict.fromkeys(CATEGORIES, 0.0)
        for passage in self.passages(text) if text else ():
            for category, s in self.passage(passage).items():
                total[category] = max(total[category], s)
        return [total[c] for c in CATEGORIES]


_judges: dict[tuple, Judge] = {}


def _judge(vocabularies: tuple[str, ...], phrases: tuple[tuple[str, ...], ...]) -> Judge:
    """One judge per worker process, vocabularies and phrases."""
    key = vocabularies, phrases
    if key not in _judges:
        _judges.clear()
        _judges[key] = Judge(vocabularies, phrases)
    return _judges[key]


def _score_batches(
    vocabularies: tuple[str, ...], phrases: tuple[tuple[str, ...], ...]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(vocabularies, phrases)
        for batch in batches:
            scores = np.array([judge.score(t) for t in batch.column("__text").to_pylist()]).reshape(-1, len(CATEGORIES))
            kept = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(scores.max(1, initial=0.0)), *(pa.array(s) for s in scores.T)],
                names=[*kept, "score", *CATEGORIES],
            )

    return run


def abuse_scores(
    df: DataFrame, keep: list[str], text: str, phrases: Iterable[tuple[str, ...]] = (), vocabularies: tuple[str, ...] = VOCABULARIES
) -> DataFrame:
    """The columns ``keep`` of ``df``, ``score`` (the worst category) and a score per category.

    Null, empty and blank texts score 0. Every row gives one row, repetitions
    included; an empty table gives none. Columns not named are not read.
    ``phrases`` are those of ``learn_phrases``; without them the category
    ``learned`` is 0.
    """
    slim = df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*fields, "score double", *(f"{c} double" for c in CATEGORIES)])
    return spread(slim).mapInArrow(_score_batches(tuple(vocabularies), tuple(sorted(phrases))), schema)


# ---- phrases a corpus uses -----------------------------------------------------------------------------------------


def _phrases_of(vocabularies: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every phrase, with words enough that are not frequent, of the rated texts the rules find nothing in, once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(vocabularies, ())
        for batch in batches:
            found: dict[str, list[float]] = {}
            for text, rating in zip(batch.column("text").to_pylist(), batch.column("rating").to_pylist()):
                if not text or rating >= 0.5 and max(judge.score(text)) >= THRESHOLD:
                    continue
                own: set[str] = set()
                for passage in passages(clean(text)):
                    words = judge.words(joined_letters(passage))
                    upto = [0, *accumulate(judge.rank(w) >= FREQUENT for w in words)]
                    own.update(
                        " ".join(words[i : i + n])
                        for n in PHRASE_WORDS
                        for i in range(len(words) - n + 1)
                        if upto[i + n] - upto[i] >= CONTENT_WORDS
                    )
                for phrase in own:
                    entry = found.setdefault(phrase, [0.0, 0.0])
                    entry[0] += 1
                    entry[1] += rating
            columns = list(found), [e[0] for e in found.values()], [e[1] for e in found.values()]
            types = pa.string(), pa.float64(), pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["phrase", "documents", "abusive"])

    return run


def learn_phrases(
    documents: DataFrame, ratings: DataFrame, ident: str, text: str, rating: str,
    most_rated: int = MAX_RATED, vocabularies: tuple[str, ...] = VOCABULARIES,
) -> list[tuple[str, ...]]:
    """Phrases of three to five words that raters of this corpus call abusive, where the rules alone find nothing.

    ``ratings`` has rows ``(ident, rating)`` with a rating of 0 or 1, several per
    document; their mean counts. At most ``most_rated`` rated documents are used, a
    sample by a hash of the id. A phrase is kept if at least ``LEAST_DOCUMENTS`` of
    them hold it and their mean rating is surely (see ``DEVIATIONS``) ``LEAST_SHARE`` or more,
    and if it has ``CONTENT_WORDS`` words that are not frequent. Null ids and
    ratings are ignored; without ratings nothing is learned.
    """
    votes = ratings.select(F.col(ident).alias("id"), F.col(rating).cast("double").alias("r")).filter("id is not null and r is not null")
    votes = votes.groupBy("id").agg(F.avg("r").alias("rating")).orderBy(F.xxhash64("id"), "id").limit(most_rated)
    # at most most_rated rows of two numbers
    rated = documents.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(votes), "id")
    phrases = spread(rated.select("text", "rating")).mapInArrow(_phrases_of(tuple(vocabularies)), "phrase string, documents double, abusive double")
    counts = phrases.groupBy("phrase").agg(F.sum("documents").alias("documents"), F.sum("abusive").alias("abusive"))
    n, p, z2 = F.col("documents"), F.col("abusive") / F.col("documents"), DEVIATIONS**2
    surely = (p + z2 / (2 * n) - DEVIATIONS * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    kept = counts.filter((n >= LEAST_DOCUMENTS) & (surely >= LEAST_SHARE))
    # phrases of most_rated documents, each in several of them: bounded as the sample is
    found = {tuple(r["phrase"].split(" ")) for r in kept.select("phrase").collect()}
    # a phrase with a shorter one inside says nothing more
    return sorted(p for p in found if not any(p[i : i + n] in found for n in range(1, len(p)) for i in range(len(p) - n + 1)))


def abuse_rates(scored: DataFrame, source: str, threshold: float = THRESHOLD) -> DataFrame:
    """``(source, documents, abusive, rate)`` of scored texts; a null source is a source of its own."""
    return (
        scored.groupBy(source)
        .agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= threshold).alias("abusive"))
        .withColumn("rate", F.col("abusive") / F.col("documents"))
    )
