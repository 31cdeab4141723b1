"""Sentence units of documents in many languages and scripts."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameloom.session import cut, ship_package

#: A token whose occurrences are a smaller share of all tokens of the corpus counts as never seen. There are at most
#: 1 / KEY_SHARE more frequent ones whatever the size of the corpus, and their counts are exact.
KEY_SHARE = 2.5e-7

#: Bound of the training sample: about so many documents, and at most so many labelled candidates of each.
TRAINING_DOCUMENTS, TRAINING_CANDIDATES = 4000, 40

#: What an occurrence after an unsure mark counts against a token's beginning sentences, next to one within a sentence.
UNSURE_WEIGHT = 0.1

#: Occurrences from which two words tell more about a start than the first of them.
COMMON_PAIR = 8

#: Code points that are looked at in one go; longer documents are parted at blank lines only, where units end anyway.
CHUNK = 1 << 18

#: Distinct tokens and contexts that a task holds before it hands on or forgets what it has of them.
HELD_TOKENS = 300_000

# Marks that end sentences, by kind (others with the property Sentence_Terminal are strong marks too), and
# quotes and brackets that open and close.
_DOTS = ".．"
_ELLIPSES = "…"
_STRONG = "!?‼⁇⁈⁉。！？｡।॥؟۔።፧፨།༎"
_MARKS = _DOTS + _ELLIPSES + _STRONG
_BRACKETS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕"}
_QUOTES = {"“": "”", "‘": "’", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "„": "“", "‚": "‘", "»": "«"}
_PAIRS = {**_BRACKETS, **_QUOTES}
_CLOSERS = set(_PAIRS.values()) | {'"', "”"}
_GO_ON = ",;:)]}，、；：）」』”»،؛、፣፤፥"
_BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "

_BOUND = r"\s.,;:!?…\"“”„‚‘«»‹›()\[\]{}（）［］【】〔〕「」『』《》〈〉。、，；：！？｡．।॥؟،؛۔።፣፤፥፧፨།༎¿¡*•\p{Sentence_Terminal}"
_TOKEN = regex.compile(f"[^{_BOUND}]+")
_LAST = regex.compile(rf"(?:[^{_BOUND}]+\.)*[^{_BOUND}]+$")
_BOUND_ONE = regex.compile(f"[{_BOUND}]")
_TERMINAL = regex.compile(r"\p{Sentence_Terminal}")
_CODE = regex.compile(r"[^\W\d_]{1,8}-\d+(?![A-Za-z0-9_])|(?:[A-Za-z0-9_]+[-./\\:])*[A-Za-z0-9_]+")
_IDEOGRAM = regex.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿𠀀-𯿿々〆ー]")
_JOINED = regex.compile(r"[^\W\d_]{3,}\.([^\W\d_][^.]*)$")
_ORDINARY = regex.compile(r"[^\W\d_]{4,}$")
_BLANK_LINE = regex.compile(r"\n[ \t]*\n")
_DIGITS = regex.compile("[0-9]+")

_SPACE, _BREAK, _WORD, _MARK, _DOT, _STRONG_BIT, _ELLIPSIS, _PAIR, _CLOSER, _IDEO, _ALPHA, _UPPER, _LOWER, _DIGIT, _THAI, _HOLDS, _OPENS, _CODED, _JOINT, _FRENCH = (1 << i for i in range(20))

_CLASSES = ("upper", "lower", "code", "number", "uncased", "open", "other")
FEATURES = (
    "bias", "start", "start_seen", *(f"right_{c}" for c in _CLASSES), "left_letter", "left_number",
    "left_dotted", "left_ordinary", "left_short", "left_uncased", "left_code", "left_ends", "left_bare", "left_never", "left_closes", "mark_ellipsis",
    "mark_strong", "after_quote", "after_bracket", "bracket_alone", "no_gap", "start_x_dot", "start_x_never", "start_x_quote",
)
_F = {name: i for i, name in enumerate(FEATURES)}

#: Mean of the Gaussian prior of the weights: what decides where a corpus has no reliable boundary at all.
PRIOR = {"bias": 1.0, "right_upper": 1.0, "start": 0.5, "right_lower": -3.0, "mark_strong": 2.0, "left_never": 1.0}

_COLUMNS = ("total", "started", "unsure", "ended", "went_on", "dotted")


def _bits(c: str) -> int:
    """The properties of a character."""
    strong = c in _STRONG or (c not in _DOTS and c not in _ELLIPSES and _TERMINAL.match(c) is not None)
    tests = (
        c.isspace(), c in _BREAKS, not _BOUND_ONE.match(c), c in _MARKS or strong, c in _DOTS, strong, c in _ELLIPSES,
        c in _PAIRS or c in _CLOSERS, c in _CLOSERS, _IDEOGRAM.match(c) is not None, c.isalpha(), c.isupper() or c.istitle(), c.islower(),
        c.isdecimal(), "฀" <= c <= "๿", c in _GO_ON and c not in _PAIRS, c in _PAIRS or c in '"¿¡', c.isascii() and (c.isalnum() or c == "_"),
        c in "-./\\:", c in "«‹",
    )
    return sum(1 << i for i, t in enumerate(tests) if t)


def _scramble(x: int) -> int:
    """64 well mixed bits of a number."""
    x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return x ^ x >> 31


_BASE = 0x5851F42D4C957F2D
_MASK = 0xFFFFFFFFFFFFFFFF


class _Characters:
    """Properties and hash values of characters, looked up once per character of a process."""

    def __init__(self):
        self.known = np.zeros(0x110000, bool)
        self.bits = np.zeros(0x110000, np.uint32)
        self.value = np.zeros(0x110000, np.uint64)

    def learn(self, codes: np.ndarray) -> None:
        present = np.flatnonzero(np.bincount(codes))
        for code in present[~self.known[present]].tolist():
            self.known[code] = True
            self.bits[code] = _bits(chr(code))
            self.value[code] = _scramble(code)


_CHARACTERS = _Characters()
_POWERS: list[int] = [1]


def _hash(text: str) -> int:
    """The hash of a key; that of a span of a text (see ``_Spans``) is the same if the characters are."""
    while len(_POWERS) <= len(text):
        _POWERS.append(_POWERS[-1] * _BASE & _MASK)
    return sum(_scramble(ord(c)) * p for c, p in zip(text, _POWERS, strict=False)) & _MASK


class _Spans:
    """Hashes of any spans of a sequence of characters, by sums of its prefixes."""

    _inverse = pow(_BASE, -1, 1 << 64)

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        up, down = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
        up[0] = down[0] = 1
        up[1:], down[1:] = _BASE, self._inverse
        with np.errstate(over="ignore"):
            np.cumprod(up, out=up)
            np.cumprod(down, out=down)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CHARACTERS.value[codes] * up[:n])])
        self.down = down

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[begin]) * self.down[begin]


def _composed(key: str) -> str:
    return key if key.isascii() else unicodedata.normalize("NFC", key)


def composed(text: str) -> tuple[str, np.ndarray]:
    """A text in the composed form (NFC), and for each of its characters the place in the given text."""
    out, places, at = [], [], 0
    for m in regex.finditer(r"[\s\S][\p{M}ᅠ-ᇿ]+", text):
        out.append(text[at : m.start()])
        places.append(np.arange(at, m.start()))
        short = unicodedata.normalize("NFC", m[0])
        out.append(short)
        places.append(m.start() + np.minimum(np.arange(len(short)), len(m[0]) - 1))
        at = m.end()
    out.append(text[at:])
    places.append(np.arange(at, len(text)))
    return "".join(out), np.concatenate(places)


def right_token(text: str, at: int = 0) -> tuple[str, str]:
    """(class, key) of what begins at a place: the key is a word, two ideograms, or a class with what follows it."""
    prefix = ""
    while at < len(text) and (text[at] in _PAIRS or text[at] in '"¿¡'):
        prefix = text[at]
        at += 1
        while at < len(text) and prefix in "«‹" and text[at].isspace():
            at += 1
    if at >= len(text):
        return "other", prefix
    m = _CODE.match(text, at)
    if m and any(c.isdigit() for c in m[0]):
        follow = _TOKEN.search(text, m.end(), m.end() + 24)
        rest = follow[0][:2] if follow and _IDEOGRAM.match(follow[0]) else follow[0].lower() if follow else ""
        kind = "code" if any(c.isalpha() for c in m[0]) else "number"
        return ("open" if prefix else kind), f"{prefix}<{kind}>{rest}"
    m = _TOKEN.match(text, at)
    if not m:
        return "other", prefix + text[at]
    word = m[0][:2] if _IDEOGRAM.match(m[0]) else m[0]
    if len(word) == 1 and _IDEOGRAM.match(word):  # a line may break between two ideograms
        rest = text[m.end() : m.end() + 4].lstrip()
        word += rest[0] if rest and _IDEOGRAM.match(rest[0]) else ""
    first = word[0]
    kind = "open" if prefix else "upper" if first.isupper() or first.istitle() else "lower" if first.islower() else "uncased" if first.isalpha() else "other"
    return kind, prefix + word


def left_token(text: str) -> tuple[str, str]:
    """(last token of a text, key): with its inner dots; a short one goes with the one before it."""
    m = _LAST.search(text)
    token = m[0] if m else text[-1:]
    begin = m.start() if m else 0
    joined = _JOINED.search(token) if "." in token else None
    if joined and joined[1][0].isupper() and token[joined.start() : joined.start(1) - 1].islower():
        token = joined[1]  # what went before ended without a blank
    if _IDEOGRAM.match(token[-1:]):
        return token, token[-2:]
    key = _DIGITS.sub("0", token)
    if m and len(token) <= 2 and not token.isdigit() and begin >= 2 and text[begin - 1].isspace() and text[begin - 2] == ".":
        before = _LAST.search(text, 0, begin - 2)
        if before and len(before[0]) <= 2 and not before[0].isdigit():
            key = before[0] + "." + key
    return token, key


class _Memo:
    """What is known of the tokens at candidates, by the hash of their context; forgotten when it grows too large."""

    def __init__(self, describe):
        self.describe, self.rows, self.slots = describe, [], {}

    def of(self, hashes: np.ndarray, text: str, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One row of numbers for each context."""
        if len(self.slots) > HELD_TOKENS:
            self.rows, self.slots = [], {}
        some, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.empty(len(some), np.int64)
        slots = self.slots
        for i, (h, j) in enumerate(zip(some.tolist(), first.tolist(), strict=True)):
            slot = slots.get(h)
            if slot is None:
                slot = slots[h] = len(self.rows)
                self.rows.append(self.describe(text[begin[j] : end[j]]))
            at[i] = slot
        width = len(self.describe(""))
        table = np.array([self.rows[i] for i in at.tolist()], np.uint64).reshape(len(at), width)
        return table[back]


def _describe_right(context: str) -> tuple[int, int, int]:
    kind, key = right_token(context)
    return _CLASSES.index(kind), _hash(key), int(kind == "code" or kind == "number")


def _describe_left(context: str) -> tuple[int, ...]:
    token, key = left_token(context)
    last = token[-1:]
    ordinary = bool(_ORDINARY.match(token)) and token.islower()
    return (
        _hash(key), len(token) == 1 and last.isalpha(), last.isdigit(), "." in token, ordinary, len(token) <= 3 and token.isalpha(),
        last.isalpha() and not last.islower() and not last.isupper(), last.isdigit() and any(x.isalpha() for x in token),
    )


_RIGHT, _LEFT = _Memo(_describe_right), _Memo(_describe_left)


def _enclosures(at: list[int], text: str, block: list[int]) -> list[tuple[int, int]]:
    """Outermost matched quotes and brackets of each block: the places of the opening and the closing character."""
    pairs: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    wanted: dict[str, int] = {}  # how often a closing character is awaited by the stack
    current = -1
    for i, b in zip(at, block, strict=True):
        if b != current:
            current = b
            if stack:
                stack, wanted = [], {}
        c = text[i]
        closes = wanted.get(c, 0) > 0 or (c == "”" and wanted.get("“", 0) > 0)
        if closes:
            while stack:
                want, start = stack.pop()
                wanted[want] -= 1
                if want == c or (c == "”" and want == "“"):
                    pairs.append((start, i))
                    break
            continue
        opening = '"' if c == '"' else _PAIRS.get(c)
        if c == "»" and not (i == 0 or text[i - 1].isspace() or text[i - 1] in _PAIRS):
            opening = None
        if opening:
            stack.append((opening, i))
            wanted[opening] = wanted.get(opening, 0) + 1
    pairs.sort()
    outer: list[tuple[int, int]] = []
    for a, b in pairs:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


class Scan:
    """Blocks, words and candidate boundaries of a stretch of text, all as arrays of places in it.

    ``first``, ``last``, ``listed``: the begin and end of every paragraph and list line, without outer blanks.
    ``end``, ``next``: of every candidate, the place after its marks and closers and the next one that isn't blank.
    Digits are one ``0`` for any number of them here; ``places`` leads back to the given text.
    """

    def __init__(self, text: str):
        given = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        digit = (given >= 48) & (given <= 57)
        kept = np.flatnonzero(~(digit & np.concatenate([[False], digit[:-1]]))) if len(given) else np.zeros(0, np.int64)
        codes = np.where(digit, np.uint32(48), given)[kept]
        self.places = np.append(kept, len(given))
        self.n = n = len(codes)
        self.codes = codes = np.append(codes, np.uint32(10))
        _CHARACTERS.learn(codes)
        self.text = codes.tobytes().decode("utf-32-le", "surrogatepass")
        self.f = f = _CHARACTERS.bits[codes]
        self.solid = np.append(np.flatnonzero((f & _SPACE) == 0), n)
        self._blocks()
        word = (f & _WORD) > 0
        self.word = word
        edge = np.diff(np.concatenate([[0], word.view(np.int8)]))
        self.w0, self.w1 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.spans = _Spans(codes)
        self._runs()
        self._candidates()

    def following(self, at: np.ndarray) -> np.ndarray:
        """The first place from one on that isn't blank."""
        return self.solid[np.minimum(np.searchsorted(self.solid, at), len(self.solid) - 1)]

    def within(self, at: np.ndarray) -> np.ndarray:
        """The block of a place, or -1 where it is in none or in a list line."""
        if not len(self.first):
            return np.full(len(at), -1)
        b = np.searchsorted(self.first, at, "right") - 1
        return np.where((b >= 0) & (at < self.last[b]) & ~self.listed[b], b, -1)

    def _blocks(self) -> None:
        codes, f, n = self.codes, self.f, self.n
        ends = np.flatnonzero(f & _BREAK)
        ends = ends[~((codes[ends] == 10) & (codes[ends - 1] == 13) & (ends > 0))]
        starts = np.concatenate([[0], ends[:-1] + 1])
        first = self.following(starts)
        full = first < ends
        starts, ends, first = starts[full], ends[full], first[full]
        line = np.flatnonzero(full)
        c, blank = codes[first], (f & _SPACE) > 0
        after = np.minimum(first + 1, n)
        listed = (((c == 45) | (c == 42)) & blank[after]) | (c == 0x2022)
        digits = np.flatnonzero((f[first] & _DIGIT) > 0)
        if len(digits):
            other = np.flatnonzero((f & _DIGIT) == 0)
            e = other[np.searchsorted(other, first[digits])]
            listed[digits] = (codes[e] == 46) & blank[np.minimum(e + 1, n)]
        begins = np.ones(len(line), bool)
        if len(line):
            begins[1:] = (np.diff(line) > 1) | listed[1:] | listed[:-1]
        heads = np.flatnonzero(begins)
        tails = np.append(heads[1:], len(line))[: len(heads)] - 1 if len(heads) else heads
        self.first, self.listed = first[heads], listed[heads]
        self.last = self.solid[np.searchsorted(self.solid, ends[tails]) - 1] + 1 if len(heads) else heads

    def _runs(self) -> None:
        """Where characters of several kinds end, and how many digits there are before each place."""
        f, word = self.f, self.word
        coded = (f & _CODED) > 0
        joint = (f & _JOINT) > 0
        joint[0] = joint[-1] = False
        dot = joint & (self.codes == 46)
        joint[1:-1] &= coded[:-2] & coded[2:]
        dot[1:-1] &= word[:-2] & word[2:]
        self.no_code = np.flatnonzero(~(coded | joint))
        self.no_word = np.flatnonzero(~word)
        self.no_run = np.concatenate([[-1], np.flatnonzero(~(word | dot))])
        self.no_open = np.flatnonzero((f & _OPENS) == 0)
        self.digits = self.many(_DIGIT)

    def many(self, bit: int) -> np.ndarray:
        """How many characters of a kind there are before each place."""
        out = np.zeros(self.n + 2, np.int32)
        np.cumsum((self.f & bit) > 0, out=out[1:])
        return out

    def _candidates(self) -> None:
        f, codes, n, text = self.f, self.codes, self.n, self.text
        marks = (f & _MARK) > 0
        edge = np.diff(np.concatenate([[0], marks.view(np.int8), [0]]))
        m0, m1 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        inside = self.within(m0) >= 0
        m0, m1 = m0[inside], m1[inside]

        pair = np.flatnonzero(f & _PAIR)
        inner = (codes[pair] == 0x2019) & ((f[np.maximum(pair - 1, 0)] & _ALPHA) > 0) & (pair > 0) & ((f[np.minimum(pair + 1, n)] & _ALPHA) > 0)
        pair = pair[~inner]  # without apostrophes
        block = self.within(pair)
        pair, block = pair[block >= 0], block[block >= 0]
        outer = np.array(_enclosures(pair.tolist(), text, block.tolist()), np.int64).reshape(-1, 2)
        self.a, self.b = a, b = outer[:, 0], outer[:, 1]

        free = ~self.enclosed(m0)
        m0, m1 = m0[free], m1[free]
        # A quotation or bracket whose last characters are marks may end a unit too.
        j = self.solid[np.searchsorted(self.solid, b) - 1] if len(b) else b
        ends = marks[j] & (j > a) if len(b) else np.zeros(0, bool)
        qa, qb, j = a[ends], b[ends], j[ends]
        plain = np.flatnonzero(~marks)
        q0 = plain[np.searchsorted(plain, j) - 1] + 1 if len(j) else j

        at = np.concatenate([m0, q0])
        stop = np.concatenate([m1, j + 1])
        trigger = np.concatenate([m0, qb])
        opening = np.concatenate([np.full(len(m0), -1), qa])
        bracket = np.array([c in _BRACKETS for c in map(text.__getitem__, qa.tolist())], bool)
        kind = np.concatenate([np.zeros(len(m0), np.int64), np.where(bracket, 2, 1)])
        end = np.concatenate([m1, qb + 1])
        order = np.argsort(trigger, kind="stable")
        at, stop, trigger, opening, kind, end = (x[order] for x in (at, stop, trigger, opening, kind, end))
        closers = (f & _CLOSER) > 0
        closers[a] = closers[b] = False
        rest = np.flatnonzero(~closers)
        end = rest[np.searchsorted(rest, end)]
        following = self.following(end)
        block = self.within(trigger)
        strong = self.many(_STRONG_BIT)
        mark = np.where(strong[stop] > strong[at], 2, np.where(((f[np.minimum(at, n)] & _ELLIPSIS) > 0) | (stop - at > 1), 1, 0))

        after = f[np.minimum(following, n)]
        wide_before = (f[np.maximum(at - 1, 0)] & _IDEO) > 0
        tight = following == end
        last = self.last[block] if len(block) else block
        ok = following < last
        # What shows that a word's dot doesn't end a sentence is counted, though it makes no candidate.
        single = (mark == 0) & (kind == 0) & ((f[np.minimum(at, n)] & _DOT) > 0) & (stop - at == 1)
        held = ok & single & ((after & _HOLDS) > 0)
        drop = (kind != 0) & tight & ((after & _ALPHA) > 0) & ((after & _IDEO) == 0) & ~wide_before
        ok &= ~drop & ((after & (_MARK | _HOLDS)) == 0)
        dotted = ok & tight & single
        wide = wide_before | ((after & _IDEO) > 0)
        open_ = (after & _OPENS) > 0
        maybe = ((after & _UPPER) > 0) & ((f[np.maximum(at - 1, 0)] & _LOWER) > 0)
        ok &= ~dotted | wide | open_ | maybe
        for k in np.flatnonzero(ok & dotted & ~wide & ~open_).tolist():
            i = int(at[k])
            ok[k] = self._parts(i, int(following[k]))
        self.held = at[held], block[held]
        at, stop, opening, kind, end, following, block, mark, tight = (x[ok] for x in (at, stop, opening, kind, end, following, block, mark, tight))
        before = np.concatenate([[-1], following[:-1]])[: len(following)]
        self.alone = (kind == 2) & ((opening == self.first[block]) | (opening == before)) if len(block) else np.zeros(0, bool)
        self.at, self.kind, self.mark, self.end, self.next, self.block, self.tight = at, kind, mark, end, following, block, tight

    def enclosed(self, at: np.ndarray) -> np.ndarray:
        """Whether a place is inside a quotation or bracket."""
        if not len(self.a):
            return np.zeros(len(at), bool)
        k = np.searchsorted(self.a, at, "right") - 1
        return (k >= 0) & (at < self.b[k]) & (at >= self.a[k])

    def _parts(self, i: int, following: int) -> bool:
        """Whether a dot inside a run of characters parts two sentences: not in a number, name or abbreviation."""
        text = self.text
        begin = max(0, i - 60)
        k = i
        while k > begin and self.word[k - 1]:
            k -= 1
        word = text[k:i]
        tail = _TOKEN.match(text, following)[0]
        return (
            len(word) > 1 and word.isalpha() and word[1:].islower() and tail[0].isupper() and (len(tail) == 1 or not tail.isupper())
            and (k == 0 or text[k - 1] not in "./\\_")
        )

    def right(self, at: np.ndarray, block: np.ndarray) -> np.ndarray:
        """(class, key, is a code or number) of what begins at each place."""
        n, f = self.n, self.f
        limit = self.last[block]
        q = at.copy()
        led = np.flatnonzero((f[at] & _OPENS) > 0)
        for _ in range(2):
            p = self.no_open[np.searchsorted(self.no_open, q[led])]
            french = (p > q[led]) & ((f[np.maximum(p - 1, 0)] & _FRENCH) > 0)
            q[led] = np.where(french, self.following(p), p)
        q = np.minimum(q, limit - 1)
        code_end = self.no_code[np.searchsorted(self.no_code, q)]
        word_end = self.no_word[np.searchsorted(self.no_word, q)]
        end = np.maximum(np.maximum(code_end, word_end), q + 1)
        has_digit = self.digits[end] > self.digits[q]
        lone = ((f[q] & _IDEO) > 0) & (word_end == q + 1)
        far = np.flatnonzero(has_digit | lone)
        if len(far) and len(self.w0):
            e = end[far]
            k = np.minimum(np.searchsorted(self.w0, e), len(self.w0) - 1)
            end[far] = np.where(self.w0[k] >= e, np.minimum(self.w1[k], e + 24), e)
        end = np.maximum(np.minimum(end, limit), at)
        return _RIGHT.of(self.spans.of(at, end) ^ np.uint64(7), self.text, at, end)

    def left(self, at: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The description of what ends before each place."""
        codes, word, no_run = self.codes, self.word, self.no_run
        least = self.first[block]
        found = word[np.maximum(at - 1, 0)] & (at > least)
        start_of = lambda p, floor: np.maximum(no_run[np.searchsorted(no_run, p) - 1] + 1, floor)
        begin = np.where(found, start_of(at, np.maximum(least, at - 60)), np.maximum(at - 1, least))
        two = np.maximum(begin - 2, 0)
        again = found & (at - begin <= 2) & (begin - 3 >= least) & (codes[two] == 46) & ((self.f[np.maximum(begin - 1, 0)] & _SPACE) > 0) & word[np.maximum(begin - 3, 0)]
        begin = np.where(again, start_of(two, np.maximum(least, begin - 40)), begin)
        return _LEFT.of(self.spans.of(begin, at), self.text, begin, at)

    def pair(self, at: np.ndarray) -> np.ndarray:
        """The key of a word and the one after it with only blanks between; 0 where there is none."""
        if len(self.w0) < 2:
            return np.zeros(len(at), np.uint64)
        k = np.minimum(np.searchsorted(self.w0, at), len(self.w0) - 2)
        follows = (self.w0[k] == at) & (self.following(self.w1[k]) == self.w0[k + 1])
        with np.errstate(over="ignore"):
            both = self.spans.of(self.w0[k], self.w1[k]) * np.uint64(_scramble(1)) + self.spans.of(self.w0[k + 1], self.w1[k + 1])
        return np.where(follows, both | np.uint64(1), np.uint64(0))


def _chunks(texts: list[str | None]) -> Iterator[tuple[str, np.ndarray, np.ndarray, list[np.ndarray | None]]]:
    """Texts joined by blank lines, in stretches of about CHUNK code points: (text, first place, document, places)."""
    pieces: list[str] = []
    firsts: list[int] = []
    owners: list[int] = []
    shifts: list = []
    size = 0
    for d, text in enumerate(texts):
        if not text or text.isspace():
            continue
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > 2 * CHUNK:
                m = _BLANK_LINE.search(text, at + CHUNK)
                stop = m.start() if m else stop
            piece = text[at:stop]
            places = None
            if not piece.isascii() and not unicodedata.is_normalized("NFC", piece):
                piece, places = composed(piece)
                places = np.append(places + at, stop)
            pieces.append(piece)
            firsts.append(size)
            owners.append(d)
            shifts.append(at if places is None else places)
            size += len(piece) + 2
            at = stop
            if size > CHUNK:
                yield "\n\n".join(pieces), np.array(firsts), np.array(owners), shifts
                pieces, firsts, owners, shifts, size = [], [], [], [], 0
    if pieces:
        yield "\n\n".join(pieces), np.array(firsts), np.array(owners), shifts


def _counted(scan: Scan) -> list[tuple[int, np.ndarray]]:
    """(column, keys): what a stretch of text adds to the counts of the corpus, one key for each occurrence."""
    f, spans = scan.f, scan.spans
    w0, w1 = scan.w0, scan.w1
    block = scan.within(w0)
    w0, w1, block = w0[block >= 0], w1[block >= 0], block[block >= 0]
    digits, wide = scan.digits, scan.many(_IDEO)
    numbered = digits[w1] > digits[w0]
    ideo = wide[w1] > wide[w0]
    starts_wide = (f[w0] & _IDEO) > 0
    plain = ~numbered & ~starts_wide
    out = [(0, spans.of(w0[plain], w1[plain]))]
    # Two ideograms side by side are a token.
    long = w1[ideo] - w0[ideo] - 1
    k = np.repeat(w0[ideo] - np.cumsum(long) + long, long) + np.arange(long.sum())
    one = w0[ideo & (w1 - w0 == 1)]
    out += [(0, spans.of(k, k + 2)), (0, spans.of(one, one + 1))]
    codes = w0[numbered & ~starts_wide]
    opened = np.flatnonzero(((f[:-1] & _OPENS) > 0) & scan.word[1:])
    opened_block = scan.within(opened)
    opened, opened_block = opened[opened_block >= 0], opened_block[opened_block >= 0]
    placed = np.concatenate([codes, opened])
    if len(placed):
        out.append((0, scan.right(placed, np.concatenate([block[numbered & ~starts_wide], opened_block]))[:, 1]))
    upper = (f[w0] & _UPPER) > 0
    pair = scan.pair(w0[upper])
    out.append((0, pair[pair > 0]))

    paragraphs = np.flatnonzero(~scan.listed)
    if len(paragraphs):
        heads = scan.first[paragraphs]
        out.append((1, scan.right(heads, paragraphs)[:, 1]))
        up = (f[heads] & _UPPER) > 0
        pair = scan.pair(heads[up])
        out.append((1, pair[pair > 0]))
        plain_at = np.concatenate([[-1], np.flatnonzero((f & _MARK) == 0)])
        tails = plain_at[np.searchsorted(plain_at, scan.last[paragraphs]) - 1] + 1
        ended = (tails > heads) & (scan.last[paragraphs] - tails == 1) & ((f[tails] & _DOT) > 0)
        out.append((3, scan.left(tails[ended], paragraphs[ended])[:, 0]))
    if len(scan.at):
        right, left = scan.right(scan.next, scan.block), scan.left(scan.at, scan.block)
        kind = right[:, 0].astype(np.int64)
        lower = kind == 1
        sure = _sure(scan, kind, left)
        pair = np.where(kind == 0, scan.pair(scan.next), np.uint64(0))
        for column, chosen in ((1, sure), (2, ~sure & ~lower)):
            out += [(column, right[chosen, 1]), (column, pair[chosen & (pair > 0)])]
        out.append((4, left[lower & (scan.kind == 0), 0]))
        out.append((5, left[(scan.mark == 0) & (scan.kind == 0), 0]))
    at, block = scan.held
    if len(at):
        keys = scan.left(at, block)[:, 0]
        out += [(4, keys), (5, keys)]
    return out


def _sure(scan: Scan, kind: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Boundaries whose right side may be counted as a start without a model."""
    dot = (scan.mark == 0) & ~scan.tight & ((kind == 0) | (kind == 5)) & (left[:, 4] > 0)
    return (scan.kind == 0) & (kind != 1) & ((scan.mark == 2) | dot)


def corpus_counts(batches: Iterator[list[str | None]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts by _COLUMNS) of a part of the corpus, as often as HELD_TOKENS of them have come together."""
    keys, counts = np.zeros(0, np.uint64), np.zeros((0, len(_COLUMNS)), np.int64)
    for texts in batches:
        for text, *_ in _chunks(texts):
            parts = _counted(Scan(text))
            found = np.concatenate([keys, *(k for _, k in parts)])
            keys, back = np.unique(found, return_inverse=True)
            new = np.zeros((len(keys), len(_COLUMNS)), np.int64)
            new[back[: len(counts)]] = counts
            at = len(counts)
            for column, k in parts:
                new[:, column] += np.bincount(back[at : at + len(k)], minlength=len(keys))
                at += len(k)
            counts = new
            if len(keys) > HELD_TOKENS:
                yield keys, counts
                keys, counts = np.zeros(0, np.uint64), np.zeros((0, len(_COLUMNS)), np.int64)
    yield keys, counts


class Counts:
    """The counts of the frequent tokens of a corpus, by the sorted hashes of their keys."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        #: Dots that end a block for each one within a block that no small letter or comma follows.
        self.ending = float(counts[:, 3].sum() / max(1.0, counts[:, 5].sum() - counts[:, 4].sum())) if len(keys) else 0.0

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((len(keys), len(_COLUMNS)))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys)[:, None], self.counts[at], 0.0)


def features(scan: Scan, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
    """(the values of FEATURES for every candidate, its reliable label: 1, 0, or -1 where only a model can tell)."""
    n = len(scan.at)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x, np.zeros(0, np.int64)
    right, left = scan.right(scan.next, scan.block), scan.left(scan.at, scan.block)
    kind = right[:, 0].astype(np.int64)
    pair = np.where(kind == 0, scan.pair(scan.next), np.uint64(0))
    of_pair = counts.of(pair)
    use = (pair > 0) & (of_pair[:, 0] >= COMMON_PAIR)
    of_word = counts.of(right[:, 1])
    within_of = lambda r: np.maximum(r[:, 0] - r[:, 1] - r[:, 2], 0.0) + UNSURE_WEIGHT * r[:, 2]
    # A pair's few occurrences are joined by so many like those of its first word.
    share = COMMON_PAIR / np.maximum(of_word[:, 0], 1.0)
    total = np.where(use, of_pair[:, 0], of_word[:, 0])
    started = np.where(use, of_pair[:, 1] + share * of_word[:, 1], of_word[:, 1])
    within = np.where(use, within_of(of_pair) + share * within_of(of_word), within_of(of_word))
    start = np.clip(np.log((started + 0.3) / (within + 1.0)), -4.5, 3.0)
    seen = np.maximum(total, started)
    c = counts.of(left[:, 0])
    bare, ended, went_on, dots = c[:, 0], c[:, 3], c[:, 4], c[:, 5]
    dot = (scan.mark == 0) & (scan.kind == 0)
    flag = left[:, 1:].astype(bool)
    letter, number, inner, ordinary, short, uncased, code = flag.T
    goes_on = np.clip(np.log((ended + 0.5) / (went_on + 0.5)), -5, 5)
    without = np.where(number, 0.0, np.clip(np.log((np.maximum(bare - dots, 0) + 0.5) / (dots + 0.5)), -5, 5))
    # An abbreviation that a further word must follow ends hardly any block, though what follows its dots may be a start.
    never = np.where(dot & ~number, np.clip(np.log((ended + 0.5) / (np.maximum(dots - went_on, 0) * counts.ending + 0.5)), -4, 2), 0.0)
    # One whose dots do end blocks as often as others' says nothing against a boundary by being one.
    closes = dot & (ended >= 10) & (never > -0.7) & (without < 0)
    values = {
        "bias": 1.0, "start": start, "start_seen": np.minimum(np.log1p(seen), 6.0) / 6.0, "left_letter": dot & letter, "left_number": dot & number,
        "left_dotted": dot & inner, "left_ordinary": ordinary, "left_short": dot & short, "left_uncased": uncased, "left_code": code,
        "left_ends": np.where(dot, goes_on, 0), "left_bare": np.where(dot & ~closes, without, 0), "left_never": never, "left_closes": closes, "mark_ellipsis": scan.mark == 1,
        "mark_strong": scan.mark == 2, "after_quote": scan.kind == 1, "after_bracket": scan.kind == 2, "bracket_alone": scan.alone, "no_gap": scan.tight,
        "start_x_dot": np.where(dot, start, 0), "start_x_never": start * never, "start_x_quote": np.where(scan.kind == 1, start, 0),
    }
    for name, value in values.items():
        x[:, _F[name]] = value
    for i, name in enumerate(_CLASSES):
        x[:, _F[f"right_{name}"]] = kind == i

    lower = kind == 1
    sure = _sure(scan, kind, left) & ((scan.mark == 2) | (without > 0))
    label = np.full(n, -1)
    label[(seen >= 20) & (kind != 3) & (start >= -1.0) & (~dot | (without > 0) | number)] = 1
    label[(seen >= 20) & (kind != 3) & (start >= 0.5) & (never > -1.2)] = 1
    label[(seen >= 20) & (start <= -4.0)] = 0
    label[sure] = 1
    label[dot & (never <= np.where(ordinary, -3.0, -2.5)) & (without < 0)] = 0
    label[lower] = 0
    label[scan.alone] = np.where(lower[scan.alone], -1, 1)
    return x, label


def fit_maximum_entropy(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60, mean: np.ndarray | None = None) -> np.ndarray:
    """Weights of the maximum-entropy model (logistic regression with a Gaussian prior), by Newton's method."""
    mean = np.zeros(x.shape[1]) if mean is None else mean
    w = mean.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - mean)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def units(texts: list[str | None], counts: Counts, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end) of every unit of texts, in code points, end exclusive."""
    rows, starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for text, firsts, owners, shifts in _chunks(texts):
        scan = Scan(text)
        if not len(scan.first):
            continue
        chosen = features(scan, counts)[0] @ weights > 0
        stop, following = scan.end[chosen], scan.next[chosen]
        gaps = np.flatnonzero(((scan.f[:-1] & _THAI) > 0) & ((scan.f[1:] & _SPACE) > 0)) + 1
        if len(gaps):
            far = scan.following(gaps)
            block = scan.within(gaps)
            fine = (block >= 0) & ((scan.f[np.minimum(far, scan.n)] & _THAI) > 0) & ~scan.enclosed(gaps)
            fine[fine] &= far[fine] < scan.last[block[fine]]
            stop, following = np.concatenate([stop, gaps[fine]]), np.concatenate([following, far[fine]])
        begin, end = np.concatenate([scan.first, following]), np.concatenate([stop, scan.last])
        begin, end = np.unique(begin), np.unique(end)
        begin, end = scan.places[begin], scan.places[end]
        piece = np.searchsorted(firsts, begin, "right") - 1
        begin, end = begin - firsts[piece], end - firsts[piece]
        for p in np.unique(piece).tolist():
            shift = shifts[p]
            mine = piece == p if not isinstance(shift, int) or shift else None
            if mine is not None:
                begin[mine] = shift[begin[mine]] if not isinstance(shift, int) else begin[mine] + shift
                end[mine] = shift[end[mine]] if not isinstance(shift, int) else end[mine] + shift
        rows.append(owners[piece])
        starts.append(begin)
        ends.append(end)
    return np.concatenate(rows), np.concatenate(starts), np.concatenate(ends)


class SentenceModel:
    """Counts of the frequent tokens and maximum-entropy weights; both have a bounded size."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, weights: np.ndarray):
        self.keys, self.counts, self.weights = keys, counts, weights


def prior() -> np.ndarray:
    return np.array([PRIOR.get(name, 0.0) for name in FEATURES])


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[str | None]]:
    for batch in batches:
        yield batch.column(column).to_pylist()


def training_share(n_documents: int) -> int:
    """Under which of 2**63 hash values a document is drawn into the training sample, which is never under a document's share."""
    return min(1 << 63, max(1, (TRAINING_DOCUMENTS << 63) // max(1, n_documents))) - 1


def fit_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> SentenceModel:
    """Fit the boundary model: counts over all documents, weights on a bounded sample of reliable boundaries."""
    spark = documents.sparkSession
    ship_package(spark)
    texts = documents.select(F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("h")).where("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0

        def each() -> Iterator[list[str | None]]:
            nonlocal n
            for some in _texts(batches, 0):
                n += len(some)
                yield some

        names = ["key", *_COLUMNS]
        for keys, counts in corpus_counts(each()):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(counts[:, i]) for i in range(len(_COLUMNS)))], names=names)
        # The number of documents goes with the counts, under a key of its own.
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([n], pa.int64()), *[pa.array([0], pa.int64())] * (len(_COLUMNS) - 1)], names=names)

    counted = texts.select("text").mapInArrow(count, "key bigint, " + ", ".join(f"{c} bigint" for c in _COLUMNS))
    summed = cut(counted.groupBy("key").agg(*[F.sum(c).alias(c) for c in _COLUMNS]))
    sizes = summed.agg(F.sum(F.when(F.col("key") != 0, F.col("total"))).alias("tokens"), F.sum(F.when(F.col("key") == 0, F.col("total"))).alias("n")).first()
    least = math.ceil((sizes["tokens"] or 0) * KEY_SHARE)
    often = F.greatest("total", F.col("ended") + F.col("went_on"), F.col("started") + F.col("unsure"))
    kept = summed.where((F.col("key") != 0) & (often >= least)).toPandas()
    keys = kept["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, table = keys[order], kept[list(_COLUMNS)].to_numpy(np.float32)[order]
    shared = spark.sparkContext.broadcast((keys, table))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(*shared.value)
        for some in _texts(batches, 0):
            for part, firsts, *_ in _chunks(some):
                scan = Scan(part)
                x, y = features(scan, counts)
                sure = np.flatnonzero(y >= 0)
                piece = np.searchsorted(firsts, scan.places[scan.at[sure]], "right")
                sure = sure[np.arange(len(sure)) - np.searchsorted(piece, piece) < TRAINING_CANDIDATES]
                yield pa.RecordBatch.from_arrays([pa.array(x[sure].tolist(), pa.list_(pa.float64())), pa.array(y[sure], pa.int32())], names=["x", "y"])

    drawn = texts.where(F.col("h").bitwiseAND(F.lit((1 << 63) - 1)) <= F.lit(training_share(int(sizes["n"] or 0)))).dropDuplicates(["h"]).select("text")
    rows = drawn.mapInArrow(label, "x array<double>, y int").toPandas()
    x = np.array(rows.x.tolist(), float).reshape(-1, len(FEATURES))
    return SentenceModel(keys, table, fit_maximum_entropy(x, rows.y.to_numpy(float), mean=prior()))


def split_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", model: SentenceModel | None = None) -> DataFrame:
    """(key, start_char, end_char): the sentence units of every document, in code points, end exclusive.

    Method: candidate boundaries (marks of any script and what closes after them, outside quotes and brackets) are
    classified by a maximum-entropy model over neighbouring tokens, case, length, digits and script, trained on
    reliable boundaries of the same documents: strong marks, ordinary words before a dot and a capital, dots before a
    small letter, words that do or don't begin sentences elsewhere. What an abbreviation is comes from the counts: a
    token that is hardly found without its dot, or whose dot is followed by a small letter or a comma. Blank lines, list
    lines and blanks between Thai letters bound units by rule. Two passes over the texts, both over arrays of
    characters: one counts tokens over all documents, one classifies; the texts are never shuffled.

    Repeated documents come out repeatedly; null, empty and blank texts have no unit; a document without any mark is
    one unit per paragraph; an empty table gives an empty result; a corpus without a reliable boundary is split by the
    prior of the weights. Texts are taken in stretches that end at blank lines; a longer paragraph is held whole, with
    about a hundred bytes for each of its characters.
    """
    ship_package(documents.sparkSession)
    model = model or fit_sentences(documents, key, text)
    shared = documents.sparkSession.sparkContext.broadcast((model.keys, model.counts, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table, weights = shared.value
        counts = Counts(keys, table)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for begin in range(0, len(texts), 1000):
                rows, starts, ends = units(texts[begin : begin + 1000], counts, weights)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows + begin)), pa.array(starts), pa.array(ends)], names=[key, "start_char", "end_char"])

    chosen = documents.select(key, F.col(f"`{text}`").cast("string").alias(text))
    schema = T.StructType([chosen.schema[0], T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())])
    return chosen.mapInArrow(run, schema)
