"""Operator 9: personal data by base patterns and a semi-Markov conditional random field.

Base patterns find e-mail addresses, IP addresses, payment cards and phone numbers;
their matches always stay. The field reads the neighbourhoods of digits, @ and
bracketed "at": whole candidate segments of up to LONGEST tokens, and mail forms of
any length, are scored by features of the whole span and its surroundings, and a
Viterbi pass over segments chooses boundaries and types jointly. Neighbourhoods hold
every segment with a sign and are never cut: the pass takes BLOCK tokens at a time and
carries its state on. Its entities that touch no base span are added. It is trained
here, by conditional likelihood, on sentences made from a seed.

Defined cases: null texts count as empty; texts without digits and @ have no spans;
repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
LONGEST, SENTENCES, EPOCHS, SEED = 40, 400, 8, 9
#: Digits of a card, phone number or address at most (longer runs of numbers are none); scores of segments that a task keeps.
MOST_DIGITS, KNOWN = 20, 100_000
#: Tokens whose segments are held at once; any number gives the same result.
BLOCK = 256

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]+")

#: Byte of a digit -> its value, and the digit sum of its double.
_PLAIN, _DOUBLED = (bytes(f(c - 48) if 48 <= c <= 57 else 0 for c in range(256)) for f in (lambda d: d, lambda d: d * 2 - 9 * (d > 4)))

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = digits.encode()[::-1]
    return (sum(values[::2].translate(_PLAIN)) + sum(values[1::2].translate(_DOUBLED))) % 10 == 0


def _digits(s: str) -> str:
    return _NO_DIGITS.sub("", s)


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, leftmost and non-overlapping per kind, failing ones dropped; linear in the text."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        free = m.end() if m else at + 1
        if m:
            out.append(("email", start, free))
        at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_SIGN = re.compile(r"[0-9@]|[(\[]\s?(?:at|AT)\s?[)\]]")
#: The same by whole tokens.
_SIGNS = re.compile(r"[0-9]+|@|[(\[]\s?(?:at|AT)\s?[)\]]")
#: Words that announce personal data.
_CUES = {"mail": "email", "email": "email", "e-mail": "email", "contact": "email", "write": "email", "tel": "phone", "phone": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "card": "card", "visa": "card", "credit": "card", "pay": "card", "ip": "ip", "host": "ip", "server": "ip", "address": "ip"}
_OBFUSCATED = re.compile(r"^([A-Za-z0-9._%+-]+)\s?(?:@|[(\[]\s?(?:at|AT)\s?[)\]])\s?([A-Za-z0-9-]+)((?:\s?(?:\.|[(\[]\s?(?:dot|DOT)\s?[)\]])\s?[A-Za-z0-9-]+)+)$")
#: The same form anywhere in a text, from the start of its name to its last part; no blank of it is a line end.
_MAIL_FORM = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[^\S\n]?(?:@|[(\[][^\S\n]?(?:at|AT)[^\S\n]?[)\]])[^\S\n]?[A-Za-z0-9-]++(?:[^\S\n]?(?:\.|[(\[][^\S\n]?(?:dot|DOT)[^\S\n]?[)\]])[^\S\n]?[A-Za-z0-9-]++)++")
_GROUPS = re.compile(r"[0-9]+")

#: Names of the binary features of a segment.
FEATURES = [
    "any", "one_token", "at", "mail_form", "mail_spaced", "ends_in_letters", "dots1", "dots2", "dots3", "dots4",
    "d1_3", "d4_6", "d7", "d8_9", "d10", "d11_12", "d13", "d14_16", "d17_19", "d20", "plus", "double_zero", "luhn", "four_numbers", "ip_valid",
    "letters", "space", "hyphen", "parens", "other_sign", "edge_sign", "opens_inside", "closes_inside", "groups_334", "groups_4x", "groups_465", "groups_phone", "all_digits",
    "cue_email", "cue_phone", "cue_card", "cue_ip", "date_form", "digit_before", "digit_after", "dot_digit_beside", "blank_edge", "solid_16_luhn", "spaced_card",
]
_AT = {name: i for i, name in enumerate(FEATURES)}


_LETTER, _BLANK, _OTHER = re.compile(r"[^\W\d_]"), re.compile(r"\s"), re.compile(r"[^\w .()+@\[\]-]|_")
_ADDRESS, _DATE = re.compile(r"[0-9]{1,3}(?:\s?[.]\s?[0-9]{1,3}){3}"), re.compile(r"[0-9]{1,4}[-./][0-9]{1,2}[-./][0-9]{1,4}")
_DIGIT_BEFORE, _DIGIT_AFTER = re.compile(r"[0-9][\s.,-]?$"), re.compile(r"[\s.,-]?[0-9]")
#: Feature of a number of digits, from 20 on the last.
_BY_DIGITS = [None, *["d1_3"] * 3, *["d4_6"] * 3, "d7", "d8_9", "d8_9", "d10", "d11_12", "d11_12", "d13", *["d14_16"] * 3, *["d17_19"] * 3, "d20"]


def segment_features(text: str, start: int, end: int, cues: frozenset[str]) -> list[int]:
    """Indices of the features that hold for text[start:end]."""
    s = text[start:end]
    on = ["any"]
    before, after = text[start - 1 : start], text[end : end + 1]
    found = _GROUPS.findall(s)
    groups = [len(g) for g in found]
    n, many = sum(groups), len(groups)
    dots = s.count(".")
    letters = _LETTER.search(s) is not None
    blank = _BLANK.search(s) is not None
    if "@" in s or letters and "at" in s.lower():
        on.append("at")
        if _OBFUSCATED.match(s):
            on.append("mail_form")
            if "@" not in s or blank:
                on.append("mail_spaced")
    if letters:
        on.append("letters")
        if s[-1].isalpha():
            on.append("ends_in_letters")
    if dots:
        on.append(f"dots{min(4, dots)}")
    if n:
        on.append(_BY_DIGITS[min(n, 20)])
        if n == len(s):
            on.append("all_digits")
        if n >= 13 and luhn("".join(found)):
            on.append("luhn")
            if n == len(s) and n in (15, 16):
                on.append("solid_16_luhn")
            elif not letters:
                on.append("spaced_card")
    if s[0] == "+":
        on.append("plus")
    if s[:2] == "00":
        on.append("double_zero")
    if many == 4:
        if not letters and n + 3 <= len(s):
            on.append("four_numbers")
            if _ADDRESS.fullmatch(s) and all(int(g) <= 255 for g in found):
                on.append("ip_valid")
        if groups == [4, 4, 4, 4]:
            on.append("groups_4x")
    elif many == 3:
        if groups == [3, 3, 4] and not letters:
            on.append("groups_334")
        if groups == [4, 6, 5]:
            on.append("groups_465")
        if _DATE.fullmatch(s):
            on.append("date_form")
    if many >= 3 and not letters and 10 <= n <= 15 and max(groups) <= 4 and dots < 3:
        on.append("groups_phone")
    if blank:
        on.append("space")
    if "-" in s:
        on.append("hyphen")
    if "(" in s and ")" in s:
        on.append("parens")
    if _OTHER.search(s):
        on.append("other_sign")
    if not s[-1].isalnum() or not (s[0].isalnum() or s[0] in "+("):
        on.append("edge_sign")
    if before and (before.isalnum() or before in "@_"):
        on.append("opens_inside")
    if after and (after.isalnum() or after in "@_"):
        on.append("closes_inside")
    if _DIGIT_BEFORE.search(text[max(0, start - 2) : start]):
        on.append("digit_before")
    if _DIGIT_AFTER.match(text[end : end + 2]):
        on.append("digit_after")
    if s[0].isspace() or s[-1].isspace():
        on.append("blank_edge")
    if cues:
        on += [f"cue_{c}" for c in cues]
    return [_AT[name] for name in on]


def _token_start(text: str, end: int, least: int = 0) -> int:
    """Start of the token that ends at a token bound."""

    def sort(c: str) -> int:
        return 1 if c.isascii() and c.isalpha() else 2 if "0" <= c <= "9" else 3 if c.isspace() else 0

    at = end - 1
    kind = sort(text[at])
    while kind and at > least and sort(text[at - 1]) == kind:
        at -= 1
    return at


def _words_before(text: str, at: int, least: int = 0, known: list[str] | None = None) -> list[str]:
    """The last two words before a token bound; known are those before least."""
    out: list[str] = []
    while at > least and len(out) < 2:
        start = _token_start(text, at, least)
        if text[start].isalpha():
            out.insert(0, text[start:at].lower())
        at = start
    return [*(known or []), *out][-2:]


class Tokens:
    """Tokens of a window of text, and the segments that start at each."""

    def __init__(self, text: str, low: int, high: int, recent: list[str] | None = None):
        tokens = [m.group() for m in _TOKEN.finditer(text, low, high)]
        self.text, self.tokens, self.n = text, tokens, len(tokens)
        self.bounds = [low]
        self.cues: list[frozenset[str]] = []
        recent = _words_before(text, low) if recent is None else recent
        for t in tokens:
            self.bounds.append(self.bounds[-1] + len(t))
            self.cues.append(frozenset(_CUES[w] for w in recent if w in _CUES))
            if t.isalpha():
                recent = [*recent[-1:], t.lower()]
        #: n line end, b blank, d digits, w word, @, p sign of a name, s other sign.
        self.kinds = ["n" if "\n" in t else "b" if t.isspace() else "d" if t[0] in "0123456789" else "@" if t == "@" else "p" if t in "._%+-" else "w" if t.isalpha() else "s" for t in tokens]
        self.blank = [k in "nb" for k in self.kinds]
        self.signed = [t in ("@", "at", "AT") or t[0] in "0123456789" for t in tokens]
        #: Mail forms of more than LONGEST tokens: first token -> end.
        self.far: dict[int, int] = {}
        if self.n > LONGEST:
            for m in _MAIL_FORM.finditer(text, low, high):
                i, j = bisect.bisect_left(self.bounds, m.start()), bisect.bisect_left(self.bounds, m.end())
                if j - i > LONGEST and (self.bounds[i], self.bounds[j]) == m.span():
                    self.far[i] = j

    def ends(self, i: int) -> Iterator[int]:
        """Ends of the segments from token i: it alone, and those of several tokens with a sign, without blank edges or line ends.

        A segment is followed while it can still become an entity: digits, blanks and the
        signs of numbers, of at most MOST_DIGITS digits and three dots; or a name without blanks, one @,
        and parts of a host with dots between them.
        """
        yield i + 1
        if self.blank[i]:
            return
        kinds, texts = self.kinds, self.tokens
        any_sign, digits, dots, numeric, mail, name, last = self.signed[i], 0, 0, True, True, True, ""
        for j in range(i, min(self.n, i + LONGEST)):
            kind, token = kinds[j], texts[j]
            if kind == "n":
                break
            if kind == "d":
                digits += len(token)
                numeric &= digits <= MOST_DIGITS
            elif token == ".":
                dots += 1
                numeric &= dots <= 3
            elif kind != "b" and token not in "-()+":
                numeric = False
            if mail:
                if name and token in "@([":
                    name = False
                elif name:
                    mail = kind != "s" and last != "b"
                elif kind == "w" or kind == "d":
                    mail = last != "b" or before in "@.)]([" or token in ("at", "AT", "dot", "DOT")
                elif kind != "b":
                    mail = token in ".-()[]"
                if kind != "b":
                    before = token
            last = kind
            if not (numeric or mail):
                break
            if j > i:
                any_sign |= self.signed[j]
                if any_sign and kind != "b" and (numeric or not name):
                    yield j + 1
        if i in self.far:
            yield self.far[i]

    def features(self, i: int, j: int) -> list[int]:
        return segment_features(self.text, self.bounds[i], self.bounds[j], self.cues[i])


def matrix_of(rows: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(rows), len(FEATURES)))
    for r, on in enumerate(rows):
        out[r, on] = 1.0
    return out


def decoded(text: str, low: int, high: int, weights: np.ndarray, recent: list[str] | None = None, block: int = BLOCK, known: dict | None = None) -> list[Span]:
    """What Lattice(text, low, high).best(weights) gives, with the segments of `block` tokens at once.

    known: scores of segments met before with these weights.
    """
    known = {} if known is None else known
    tokens = Tokens(text, low, high, recent)
    value, back, chosen = [0.0] + [-np.inf] * tokens.n, [-1] * (tokens.n + 1), [0] * (tokens.n + 1)
    bounds, cues = tokens.bounds, tokens.cues
    for first in range(0, tokens.n, block):
        spans = [(i, j) for i in range(first, min(tokens.n, first + block)) for j in tokens.ends(i)]
        # a segment's score hangs on itself, two signs on either side and the words before: repeated ones are scored once
        keys = [(j - i > 1, cues[i], text[max(0, bounds[i] - 2) : bounds[i]], text[bounds[i] : bounds[j]], text[bounds[j] : bounds[j] + 2]) for i, j in spans]
        new = {k: s for k, s in zip(keys, spans, strict=True) if k not in known}
        if new:
            scores = matrix_of([tokens.features(i, j) for i, j in new.values()]) @ weights
            scores[np.array([k[0] for k in new]), 0] = -np.inf
            kinds = scores.argmax(axis=1)
            known.update(zip(new, zip(kinds.tolist(), scores[np.arange(len(new)), kinds].tolist(), strict=True), strict=True))
        for (i, j), key in zip(spans, keys, strict=True):
            kind, top = known[key]
            v = value[i] + top
            if v > value[j]:
                value[j], back[j], chosen[j] = v, i, kind
        if len(known) > KNOWN:
            known.clear()
    out, j = [], tokens.n
    while j > 0:
        i = back[j]
        if chosen[j]:
            out.append((KINDS[chosen[j] - 1], tokens.bounds[i], tokens.bounds[j]))
        j = i
    return out[::-1]


class Lattice:
    """All segments of a window of text: ends, and features."""

    def __init__(self, text: str, low: int, high: int):
        tokens = Tokens(text, low, high)
        self.bounds, self.n = tokens.bounds, tokens.n
        spans = [(i, j) for i in range(self.n) for j in tokens.ends(i)]
        self.spans = spans
        self.matrix = matrix_of([tokens.features(i, j) for i, j in spans])
        self.by_end: list[list[int]] = [[] for _ in range(self.n + 1)]
        self.by_start: list[list[int]] = [[] for _ in range(self.n + 1)]
        for r, (a, b) in enumerate(spans):
            self.by_end[b].append(r)
            self.by_start[a].append(r)
        self.single = np.array([b - a == 1 for a, b in spans], bool)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """segments x (outside and the kinds); outside are single tokens."""
        out = self.matrix @ weights
        out[~self.single, 0] = -np.inf
        return out

    def best(self, weights: np.ndarray) -> list[Span]:
        scores = self.scores(weights)
        kind = scores.argmax(axis=1)
        top = scores[np.arange(len(kind)), kind] if len(kind) else np.empty(0)
        value, back = [0.0] + [-np.inf] * self.n, [-1] * (self.n + 1)
        for j in range(1, self.n + 1):
            for r in self.by_end[j]:
                v = value[self.spans[r][0]] + top[r]
                if v > value[j]:
                    value[j], back[j] = v, r
        out, j = [], self.n
        while j > 0:
            r = back[j]
            a, b = self.spans[r]
            if kind[r]:
                out.append((KINDS[kind[r] - 1], self.bounds[a], self.bounds[b]))
            j = a
        return out[::-1]

    def gradient(self, weights: np.ndarray, gold: dict[tuple[int, int], int]) -> np.ndarray:
        """Of the log-likelihood of the segmentation `gold` (bounds -> kind; the rest outside)."""
        scores = self.scores(weights)
        total = np.logaddexp.reduce(scores, axis=1)
        alpha, beta = np.full(self.n + 1, -np.inf), np.full(self.n + 1, -np.inf)
        alpha[0] = beta[self.n] = 0.0
        for j in range(1, self.n + 1):
            alpha[j] = np.logaddexp.reduce([alpha[self.spans[r][0]] + total[r] for r in self.by_end[j]])
        for i in range(self.n - 1, -1, -1):
            beta[i] = np.logaddexp.reduce([beta[self.spans[r][1]] + total[r] for r in self.by_start[i]])
        starts, ends = np.array([a for a, _ in self.spans]), np.array([b for _, b in self.spans])
        expected = np.exp(alpha[starts][:, None] + scores + beta[ends][:, None] - alpha[self.n])
        actual = np.zeros_like(scores)
        covered = set()
        for r, (a, b) in enumerate(self.spans):
            k = gold.get((self.bounds[a], self.bounds[b]))
            if k:
                actual[r, k] = 1.0
                covered.update(range(a, b))
        for r, (a, b) in enumerate(self.spans):
            if b - a == 1 and a not in covered:
                actual[r, 0] = 1.0
        return self.matrix.T @ (actual - expected)


def sentences(count: int = SENTENCES, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """Labelled sentences from a seed: personal data in usual and unusual writing, and numbers that are none."""
    rng = np.random.default_rng(seed)

    def pick(*x):
        return x[int(rng.integers(len(x)))]

    def digits(n):
        return "".join(str(int(d)) for d in rng.integers(0, 10, n))

    def word():
        return "".join(pick(*"bcdfghlmnprst") + pick(*"aeiou") for _ in range(int(rng.integers(1, 4)))) + pick("", "n", "s", "r")

    def card():
        head = pick("4", "51", "37", "6011") + digits(11)
        head = head[:15]
        body = next(head + c for c in "0123456789" if luhn(head + c))
        return pick(body, " ".join(body[i : i + 4] for i in range(0, 16, 4)), "-".join(body[i : i + 4] for i in range(0, 16, 4)), ".".join(body[i : i + 4] for i in range(0, 16, 4)))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+44 {digits(2)} {c} {digits(4)}", f"00{pick('44', '49', '33')} {a} {b} {c}", f"1-{a}-{b}-{c}")

    def email():
        name = pick(word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}.{digits(2)}")
        host, top = word(), pick("com", "org", "net", "de", "example.com")
        dotted, short = f"{host}.{top}", top.split(".")[-1]
        return pick(f"{name}@{dotted}", f"{name} @ {dotted}", f"{name}(at){dotted}", f"{name} [at] {dotted}", f"{name} (at) {host} (dot) {short}", f"{name}[at]{host}[dot]{short}", f"{name} @ {host} . {short}")

    def numbers():
        return pick(" ", ", ", " ", "\t", "-").join(digits(int(rng.integers(1, 7))) for _ in range(int(rng.integers(5, 14))))

    def ip():
        parts = [str(int(x)) for x in rng.integers(0, 256, 4)]
        return pick(".".join(parts), ".".join(parts), " . ".join(parts), ". ".join(parts))

    def none():
        sixteen = digits(16)
        while luhn(sixteen):
            sixteen = digits(16)
        return pick(
            f"20{digits(2)}-0{pick(*'123456789')}-1{pick(*'0123456789')}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}", f"v{digits(1)}.{digits(2)}", f"${digits(2)}.{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(3)},{digits(3)}",
            f"@{word()}", sixteen, digits(int(rng.integers(1, 10))), f"3{digits(2)}.{digits(3)}.9{digits(2)}.{digits(2)}", f"no. {digits(5)}", f"{digits(2)}%", f"CC BY-NC {digits(1)}.0", f"version {digits(1)}.", f"{digits(1)}-{digits(2)}", f"{digits(4)}/{digits(2)}", f"pp. {digits(3)}-{digits(3)}", digits(20), f"ISBN 978-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}", f"{word()}@{word()}", f"{word()} at {word()}", f"{word()}{digits(3)}", f"#{digits(4)}", f"{digits(3)} {digits(2)} {digits(1)}", numbers(), numbers(), numbers(), numbers(),
        )

    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(int(rng.integers(1, 3))):
            text += " ".join(word() for _ in range(int(rng.integers(1, 4)))) + " "
            kind = pick(None, None, None, *KINDS)
            if kind is None:
                text += none()
            else:
                if rng.random() < 0.3:
                    text += pick(*[w for w, k in _CUES.items() if k == kind]) + pick(" ", ": ")
                item = {"email": email, "ip": ip, "card": card, "phone": phone}[kind]()
                spans.append((kind, len(text), len(text) + len(item)))
                text += item
            text += pick(" ", ". ", ", ")
        out.append((text + word(), spans))
    return out


def train(examples: list[tuple[str, list[Span]]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights by stochastic gradient on the conditional log-likelihood."""
    weights, square = np.zeros((len(FEATURES), 1 + len(KINDS))), np.full((len(FEATURES), 1 + len(KINDS)), 1e-6)
    lattices = [(Lattice(t, 0, len(t)), {(a, b): 1 + KINDS.index(k) for k, a, b in spans}) for t, spans in examples]
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(lattices)):
            lattice, gold = lattices[i]
            slope = lattice.gradient(weights, gold) - 0.003 * weights
            square += slope**2
            weights += 0.5 * slope / np.sqrt(square)
    return weights


@functools.lru_cache(maxsize=1)
def default_weights() -> np.ndarray:
    return train(sentences())


def _left(text: str, at: int, least: int) -> int:
    """Start of the LONGEST tokens before a token bound, or of its line, or least."""
    for _ in range(LONGEST):
        if at <= least or text[at - 1] == "\n":
            break
        at = _token_start(text, at, least)
    return at


def _right(text: str, at: int) -> int:
    """End of the LONGEST tokens after a token bound, or of its line."""
    for _ in range(LONGEST):
        m = _TOKEN.match(text, at)
        if not m or "\n" in m.group():
            break
        at = m.end()
    return at


def _windows(text: str) -> Iterator[tuple[int, int]]:
    """Neighbourhoods of signs, merged where they meet: every segment with a sign lies in one, so none is cut."""
    signs = [(m.start(), m.end()) for m in _SIGNS.finditer(text)]
    if any(text[a] in "@([" for a, _ in signs):
        signs += [m.span() for m in _MAIL_FORM.finditer(text)]
    low = high = None
    for start, end in sorted(signs):
        if high is not None and end <= high:
            high = max(high, _right(text, end))
            continue
        a = _left(text, start, 0 if high is None else high)
        if high is not None and a <= high:
            high = max(high, _right(text, end))
            continue
        if high is not None:
            yield low, high
        low, high = a, _right(text, end)
    if high is not None:
        yield low, high


def added_spans(text: str, base: list[Span], weights: np.ndarray, known: dict | None = None) -> list[Span]:
    """Entities of the field that touch no base span. known: scores of segments met before."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def touched(a: int, b: int) -> bool:
        i = bisect.bisect_left(starts, b)
        return i > 0 and ends[i - 1] > a

    out = []
    last, recent = 0, []
    known = {} if known is None else known
    for low, high in _windows(text):
        recent, last = _words_before(text, low, last, recent), low
        if all(touched(m.start(), m.start() + 1) for m in _SIGN.finditer(text, low, high)):
            continue  # every sign is explained
        out += [(kind, a, b) for kind, a, b in decoded(text, low, high, weights, recent, known=known) if not touched(a, b)]
    return out


_BYTES = re.compile(rb"[0-9@]|[(\[]\s?(?:at|AT)\s?[)\]]")
_NOTHING = hashlib.sha256(b"").hexdigest()


def _find_task(weights: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in common.pieces(batches, 1, 4_000_000):
            counts = {k: [] for k in KINDS}
            digests, every = [], []
            for value in batch.column(1).cast(pa.binary()):
                raw = value.as_py() or b""
                base = added = []
                if _BYTES.search(raw):
                    text = raw.decode("utf-8", "surrogatepass")
                    base = base_spans(text)
                    added = added_spans(text, base, weights, known)
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest() if base else _NOTHING)
                every.append(joined(base + added))
            columns = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return task


def find(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans."""
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(_find_task(default_weights() if weights is None else weights), schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
