"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments of a token window: digits, check
digit, shape, separators, and what stands before and after.  A dynamic program
over segments of at most LONGEST tokens and LONGEST_CHARS characters finds the
best split of the window into typed spans and single outside tokens, so
boundaries and types are chosen together.  Its weights are fitted here by maximum
likelihood on windows made from a seeded grammar of personal data and
look-alikes, so they depend on no corpus; the fit takes a few seconds on the
driver and is a small matrix.

Windows lie around digits, @ and a bracketed "at".  A long run of such words is
cut into windows of WINDOW characters that overlap by OVERLAP; a window answers
for the spans that begin in its own part, and since no segment is longer than the
overlap, it sees them whole.  All work grows linearly with the text.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import pieces

KINDS = ["email", "ip", "card", "phone"]
LONGEST, LONGEST_CHARS = 16, 254
WINDOW, OVERLAP, CONTEXT = 1024, 256, 24
#: Characters of windows that are scored together.
SCORED = 1 << 15
DIGITS = re.compile(r"[0-9]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_AFTER_PLUS = re.compile(r"[ ().0-9-]*")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, each kind leftmost without overlaps, in order.

    Work grows linearly with the text: the patterns are put together from whole runs of digits and from the
    neighbourhoods of @ and +, since a search that starts inside a run can't match where the whole run doesn't.
    """
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        low = at
        while low > free and (text[low - 1] in "._%+-" or text[low - 1].isascii() and text[low - 1].isalnum()):
            low -= 1
        if low < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((low, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    runs = [m.span() for m in DIGITS.finditer(text)]
    k = 0
    while k + 3 < len(runs):
        parts = runs[k : k + 4]
        if all(b[0] - a[1] == 1 and text[a[1]] == "." for a, b in zip(parts, parts[1:])):
            if all(len(x := text[s:e].lstrip("0")) <= 3 and int(x or 0) <= 255 for s, e in parts):
                out.append((parts[0][0], 1, parts[3][1]))
            k += 4
        else:
            k += 1
    k = 0
    while k < len(runs):
        to = k
        while to + 1 < len(runs) and runs[to + 1][0] - runs[to][1] == 1 and text[runs[to][1]] in " -":
            to += 1
        digits = sum(e - s for s, e in runs[k : to + 1])
        if 14 <= digits <= 19 and luhn("".join(text[s:e] for s, e in runs[k : to + 1])):
            out.append((runs[k][0], 2, runs[to][1]))
        k = to + 1
    at = text.find("+")
    while at >= 0:
        nxt = at + 1
        if text[at + 1 : at + 2].isascii() and text[at + 1 : at + 2].isdigit():
            tail = _AFTER_PLUS.match(text, at + 2).group().rstrip(" ().-")
            if len(tail) >= 2:
                nxt = at + 2 + len(tail)
                if 10 <= 1 + sum(c.isdigit() for c in tail) <= 15:
                    out.append((at, 3, nxt))
        at = text.find("+", nxt)
    return sorted(out)


# ---- the field ----

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.S)
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_HIDDEN = re.compile(r"[A-Za-z0-9._+-]+ ?[\[(]at[\])] ?[A-Za-z0-9-]+(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]+)+", re.I)
_QUAD = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_LOCAL_PHONE = re.compile(r"(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}")
_GROUPS = re.compile(r"\d{4}(?:([ -])\d{4})(?:\1\d{4}){1,2}(?:\1\d{1,4})?")
_DATE = re.compile(r"\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{4}")
_CUES = [{"mail", "email", "e", "contact", "write"}, {"ip", "host", "server", "address", "from"}, {"card", "visa", "credit", "payment", "carte"}, {"tel", "phone", "call", "fax", "mobile", "cell"}, {"order", "id", "isbn", "version", "v", "ref", "no", "serial", "token", "key", "invoice"}]
N_FEATURES = 32


@dataclass
class Lattice:
    """The tokens and candidate segments of some windows.

    Tokens of window w are first[w] to first[w + 1] - 1; segment (w, i, j) has its tokens i to j - 1, counted
    in the window, in order of j, then i. Segments begin and end at word edges and hold enough digits or an @.
    """

    first: np.ndarray
    spans: list[tuple[int, int]]
    segments: np.ndarray
    inside: np.ndarray
    outside: np.ndarray


def _cues(text: str, at: int) -> list[bool]:
    """Which kinds of word stand last before a place."""
    words = re.findall(r"[^\W\d_]+", text[max(0, at - CONTEXT) : at])
    return [bool(words) and words[-1].lower() in c for c in _CUES]


def lattice(windows: list[str]) -> Lattice:
    """The features of all segments, with array operations over all windows; patterns are tried only where counts allow them."""
    text = "".join(w + "\n" for w in windows)
    begin = np.cumsum([0, *(len(w) + 1 for w in windows)])
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    distinct, which = np.unique(points, return_inverse=True)
    is_ = lambda chars: np.isin(points, [ord(c) for c in chars])
    kind = lambda f: np.array([f(chr(c)) for c in distinct], bool)[which]
    alnum, alpha, number = kind(str.isalnum), kind(str.isalpha), kind(str.isdigit)
    digit = (points >= 48) & (points <= 57)
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    start, end = np.array(tokens).T
    window = np.searchsorted(begin, start, "right") - 1
    separator = end == begin[window + 1]
    first = np.searchsorted(start, begin)
    edge = np.append(~(np.append(False, alnum[start[1:] - 1]) & alnum[start]), True)
    edge[0] = True
    opens = (alnum | is_("+("))[start] & edge[:-1]
    at_word = (end - start == 2) & np.isin(np.append(0, points)[start], [91, 40])
    for k in np.flatnonzero(at_word).tolist():
        at_word[k] = text[start[k] : end[k]].lower() == "at"
    sums = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    n_digits, n_marks, n_dots = sums(digit), sums((points[start] == 64) | at_word), sums(is_("."))
    closes = alnum[end - 1] & edge[1:] & ~separator
    found = []
    starts = np.flatnonzero(opens)
    for size in range(1, LONGEST + 1):
        i = starts[starts + size <= len(start)]
        j = i + size
        i, j = i[closes[j - 1]], j[closes[j - 1]]
        a, b = start[i], end[j - 1]
        digits, marks = n_digits[b] - n_digits[a], n_marks[j] - n_marks[i]
        some = (digits >= 7) | (marks > 0) | (digits >= 4) & (n_dots[b] - n_dots[a] == 3)
        good = some & (window[i] == window[j - 1]) & (b - a <= LONGEST_CHARS) & ((digits <= 19) | (marks > 0))
        found.append(np.stack((i[good], j[good])))
    i, j = np.concatenate(found, axis=1)
    order = np.lexsort((i, j))
    i, j = i[order], j[order]
    a, b = start[i], end[j - 1]
    length, marks = b - a, n_marks[j] - n_marks[i]
    count = lambda mask: (t := sums(mask))[b] - t[a]
    n, dots, blanks, dashes, mails = n_digits[b] - n_digits[a], n_dots[b] - n_dots[a], count(is_(" ")), count(is_("-")), count(is_("@"))
    f = np.zeros((len(i), N_FEATURES))
    f[:, 0] = 1
    f[np.arange(len(i)), 1 + (n > 0) + (n > 6) + (n > 9) + (n > 13) + (n > 19)] = 1  # 1 to 6
    # Check digits: every second digit from the right counts double, so two running sums over all digits give them all.
    values = points[digit].astype(np.int64) - 48
    double, odd = 2 * values - 9 * (values > 4), np.arange(len(values)) % 2 == 1
    by_parity = [sums(np.where(odd, values, double)), sums(np.where(odd, double, values))]  # the even, the odd ones double
    low, high = n_digits[a], n_digits[b]
    check = np.where(high % 2 == 0, by_parity[0][high] - by_parity[0][low], by_parity[1][high] - by_parity[1][low])
    f[:, 7] = (n >= 14) & (n <= 19) & (check % 10 == 0)
    for column, pattern, possible in (
        (8, _EMAIL, mails == 1),
        (9, _HIDDEN, (mails == 0) & (marks > 0)),
        (10, _QUAD, (dots == 3) & (n + 3 == length) & (n <= 12)),
        (13, _LOCAL_PHONE, (n == 10) | (n == 11)),
        (14, _GROUPS, (n >= 12) & (n <= 20) & (blanks + dashes > 0)),
        (15, _DATE, (n >= 6) & (n <= 8) & (length <= 10)),
    ):
        for k in np.flatnonzero(possible).tolist():
            f[k, column] = pattern.fullmatch(text, a[k], b[k]) is not None
    for k in np.flatnonzero(f[:, 10]).tolist():
        if any(int(p) > 255 for p in text[a[k] : b[k]].split(".")):
            f[k, 10], f[k, 11] = 0, 1
    f[:, 12] = (points[a] == 43) & (count(digit | is_("+ ().-")) == length)
    f[:, 16] = n == length
    f[:, 17] = (n + blanks == length) | (n + dashes == length)
    f[:, 18] = count(alpha) > 0
    f[:, 19] = mails > 0
    f[:, 21] = count(is_("(")) != count(is_(")"))
    f[:, 21] *= count(is_("(")) > 0
    cues = {k: _cues(text[begin[w] : start[k]], start[k] - begin[w]) for k, w in {(int(k), int(window[k])) for k in np.unique(i)}}
    f[:, 22:27] = np.array([cues[k] for k in i.tolist()]).reshape(-1, len(_CUES))
    before, after, second = np.append(10, points)[a], points[b], np.append(points, 10)[b + 1]
    within = lambda x, chars: np.isin(x, [ord(c) for c in chars])
    f[:, 27] = within(before, ' \n\t("')
    f[:, 28] = within(before, ".-@_/=:")
    f[:, 29] = within(after, ' \n\t)",.;!?#$%&*')
    f[:, 30] = within(after, "-@_/=") | (after == 46) & (second >= 48) & (second <= 57)
    doubled = np.append(is_(" ")[1:] & is_(" ")[:-1], False)
    pairs = sums(doubled)
    f[:, 31] = (count(is_("\n")) > 0) | (pairs[np.maximum(b - 1, a)] > pairs[a])
    o = np.zeros((len(start), N_FEATURES))
    letters = sums(alpha)
    o[:, 0], o[:, 16], o[:, 18], o[:, 19] = 1, number[start], letters[end] - letters[start] == end - start, points[start] == 64
    at = begin[window]
    spans = list(zip((start - at).tolist(), (end - at).tolist()))
    return Lattice(first, spans, np.stack((window[i], i - first[window[i]], j - first[window[i]]), axis=1), f, o)


def best_spans(windows: list[str], weights: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of the best split of each window; column 0 of the weights is for outside tokens."""
    if not windows:
        return []
    x = lattice(windows)
    kinds = x.inside @ weights[:, 1:]
    best, alone = kinds.argmax(axis=1).tolist(), (x.outside @ weights[:, 0]).tolist()
    top = kinds.max(axis=1).tolist() if len(kinds) else []
    segments, cuts = x.segments.tolist(), np.searchsorted(x.segments[:, 0], np.arange(len(windows) + 1)).tolist()
    out = []
    for w in range(len(windows)):
        base, n = int(x.first[w]), int(x.first[w + 1] - x.first[w])
        k, last, score, back = cuts[w], cuts[w + 1], [0.0] * (n + 1), [-1] * (n + 1)
        found, j = [], n
        if k < last:
            for j in range(1, n + 1):
                score[j] = score[j - 1] + alone[base + j - 1]
                while k < last and segments[k][2] == j:
                    s = score[segments[k][1]] + top[k]
                    if s > score[j]:
                        score[j], back[j] = s, k
                    k += 1
            while j:
                if back[j] >= 0:
                    i = segments[back[j]][1]
                    found.append((x.spans[base + i][0], best[back[j]], x.spans[base + j - 1][1]))
                    j = i
                else:
                    j -= 1
        out.append(found[::-1])
    return out


def _examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows with their spans, from a grammar of personal data, look-alikes and filler."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeinorst") for _ in range(r.randint(2, 7)))

    def card() -> str:
        d = r.choice("3456") + digits(r.choice([14, 15, 15, 15]) - 1)
        d += next(c for c in "0123456789" if luhn(d + c))
        return d if r.random() < 0.5 else r.choice(" -").join(d[k : k + 4] for k in range(0, len(d), 4))

    def bad_card() -> str:
        d = digits(16)
        return d if not luhn(d) else bad_card()

    made = {
        0: [lambda: f"{word()}.{digits(2)}@{word()}{digits(1)}.example.com", lambda: f"{word()}@{word()}.org", lambda: f"{word()}+{word()}@{word()}.co.uk", lambda: f"{word()} [at] {word()} [dot] com", lambda: f"{word()}(at){word()}.net"],
        1: [lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))],
        2: [card],
        3: [lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"+{r.randint(20, 99)} {digits(3)} {digits(3)} {digits(3)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}"],
    }
    fakes = [bad_card, lambda: f"20{digits(2)}-0{r.randint(1, 9)}-1{digits(1)}", lambda: f"{r.randint(1, 9)}.{digits(1)}.{digits(2)}", lambda: f"{r.randint(300, 999)}.{digits(3)}.{r.randint(256, 999)}.{digits(2)}", lambda: digits(r.choice([7, 8, 9, 11, 12, 22, 30])), lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)), lambda: f"{digits(1)},{digits(3)},{digits(3)}.{digits(2)}", lambda: f"{digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", lambda: f"@{word()} {digits(7)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)} {digits(4)}"]
    out = []
    for _ in range(n):
        text, spans = word() + r.choice([" ", ", ", ". ", "### "]), []
        for _ in range(r.randint(1, 2)):
            kind = r.choice([-1, -1, 0, 1, 2, 3])
            item = r.choice(fakes if kind < 0 else made[kind])()
            if r.random() < 0.4:
                text += r.choice(sorted(_CUES[4] if kind < 0 else _CUES[kind])) + r.choice([" ", ": "])
            if kind >= 0:
                spans.append((len(text), kind, len(text) + len(item)))
            text += item + r.choice([" ", ", ", ". ", "$$$ ", "\n"]) + (word() + " ") * r.randint(0, 1)
        out.append((text, spans))
    return out


class Training:
    """Windows with their spans, for the likelihood of weights. Windows with a span that is no candidate are left out."""

    def __init__(self, examples: list[tuple[str, list[tuple[int, int, int]]]]):
        x = lattice([text for text, _ in examples])
        place = {(w, x.spans[x.first[w] + i][0], x.spans[x.first[w] + j - 1][1]): k for k, (w, i, j) in enumerate(x.segments.tolist())}
        used = np.array([all((w, s, e) in place for s, _, e in spans) for w, (_, spans) in enumerate(examples)])
        number = np.cumsum(used) - 1
        y, o = np.zeros((len(x.segments), len(KINDS))), np.ones(len(x.spans))
        for w in np.flatnonzero(used).tolist():
            for s, kind, e in examples[w][1]:
                k = place[w, s, e]
                y[k, kind] = 1
                o[x.first[w] + x.segments[k, 1] : x.first[w] + x.segments[k, 2]] = 0
        of = np.repeat(np.arange(len(examples)), np.diff(x.first))
        index = np.arange(len(x.spans)) - x.first[of]
        token = used[of] & (index < (np.diff(x.first) - 1)[of])  # without the ends of the windows
        segment = used[x.segments[:, 0]]
        self.inside, self.outside, self.y, self.o = x.inside[segment], x.outside[token], y[segment], o[token]
        self.segments = x.segments[segment]
        self.segments[:, 0] = number[self.segments[:, 0]]
        self.tokens = np.stack((number[of[token]], index[token]), axis=1)
        self.size = (np.diff(x.first) - 1)[used]
        longest = int(self.size.max())
        self.by_end = [np.flatnonzero(self.segments[:, 2] == j) for j in range(longest + 1)]
        self.by_start = [np.flatnonzero(self.segments[:, 1] == j) for j in range(longest + 1)]

    def likelihood(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """(mean log likelihood less the decay, its gradient).

        log Z and the segment marginals come from forward and backward sums over segments, for all windows at once.
        """
        seg, tok, b, longest = self.segments, self.tokens, len(self.size), int(self.size.max())
        s_in, s_out = self.inside @ weights[:, 1:], np.zeros((b, longest))
        s_out[tok[:, 0], tok[:, 1]] = self.outside @ weights[:, 0]
        total = np.logaddexp.reduce(s_in, axis=1)
        ahead, behind = np.full((b, longest + 1), -np.inf), np.full((b, longest + 1), -np.inf)
        ahead[:, 0] = 0
        for j in range(1, longest + 1):
            ahead[:, j] = ahead[:, j - 1] + s_out[:, j - 1]
            k = self.by_end[j]
            np.logaddexp.at(ahead[:, j], seg[k, 0], ahead[seg[k, 0], seg[k, 1]] + total[k])
        behind[np.arange(b), self.size] = 0
        for j in range(longest - 1, -1, -1):
            live = self.size > j
            behind[live, j] = behind[live, j + 1] + s_out[live, j]
            k = self.by_start[j]
            np.logaddexp.at(behind[:, j], seg[k, 0], behind[seg[k, 0], seg[k, 2]] + total[k])
        z = ahead[np.arange(b), self.size]
        p_in = np.exp(ahead[seg[:, 0], seg[:, 1]] + behind[seg[:, 0], seg[:, 2]] - z[seg[:, 0]])[:, None] * np.exp(s_in)
        p_out = np.exp(ahead[tok[:, 0], tok[:, 1]] + behind[tok[:, 0], tok[:, 1] + 1] + s_out[tok[:, 0], tok[:, 1]] - z[tok[:, 0]])
        gradient = np.concatenate((self.outside.T @ (self.o - p_out)[:, None], self.inside.T @ (self.y - p_in)), axis=1) / b - 1e-3 * weights
        gold = (s_in * self.y).sum() + (s_out[tok[:, 0], tok[:, 1]] * self.o).sum()
        return float(gold - z.sum()) / b - 5e-4 * float((weights**2).sum()), gradient


@lru_cache(maxsize=1)
def fitted(n: int = 400, steps: int = 120, seed: int = 7) -> np.ndarray:
    """Weights (features x (outside, *KINDS)) by gradient ascent on the conditional likelihood of the example windows."""
    training = Training(_examples(n, seed))
    weights, speed = np.zeros((N_FEATURES, 1 + len(KINDS))), np.zeros((N_FEATURES, 1 + len(KINDS)))
    for _ in range(steps):
        speed = 0.9 * speed + training.likelihood(weights)[1]
        weights = weights + 0.3 * speed
    return weights


_ANCHOR = re.compile(r"[0-9]+|@|[\[(][aA][tT][\])]")
_REST = re.compile(rf"\S{{0,{LONGEST_CHARS}}}")
_NEXT_WORDS = re.compile(rf"(?: ?\S{{1,{LONGEST_CHARS}}}){{0,4}}")


def stretches(text: str, reach: tuple[list[int], list[int]] = ([], [])) -> list[tuple[int, int]]:
    """The words around digits, @ and a bracketed "at", within LONGEST_CHARS of them; stretches that one character parts are one.

    Signs in base spans don't count: a span of the field holds none of them, as it touches no base span.
    """
    out: list[tuple[int, int]] = []
    for m in _ANCHOR.finditer(text):
        s, e = m.span()
        if out and e <= out[-1][1] or _touched(reach, s, e):
            continue
        floor = out[-1][1] if out else 0
        head = text[max(floor, s - LONGEST_CHARS) : s]
        if m.group()[0] in "[(":
            head = head.removesuffix(" ")
            s = s - (text[s - 1 : s] == " ")
            e = _NEXT_WORDS.match(text, e).end()
        if head and not head[-1].isspace():
            s -= len(head.rsplit(None, 1)[-1])
        e = _REST.match(text, e).end()
        if out and s - floor <= 1:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def windows(text: str, reach: tuple[list[int], list[int]] = ([], [])) -> Iterator[tuple[int, str, int, int]]:
    """(place of the window, its text, and from where to where its spans may begin)."""
    for s, e in stretches(text, reach):
        core = text[s:e]
        if "@" not in core and "at" not in core.lower() and sum(len(x) for x in DIGITS.findall(core)) < 7 and core.count(".") < 3:
            continue
        step = WINDOW - OVERLAP
        for at in range(s, max(s + 1, e - OVERLAP), step):
            low, last = max(0, at - CONTEXT), at + WINDOW >= e
            yield low, text[low : min(e, at + WINDOW) + 2], at - 2 * (at == s), e if last else at + step


def added_spans(texts: list[str], weights: np.ndarray, reach: list[tuple[list[int], list[int]]]) -> list[list[tuple[int, int, int]]]:
    """For each text the spans of the field that touch no base span of it (see _touched) and none found before."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    waiting: list[tuple[int, int, str, int, int]] = []

    def look() -> None:
        for (k, low, _, own, to), found in zip(waiting, best_spans([w[2] for w in waiting], weights)):
            for s, kind, e in found:
                s, e = s + low, e + low
                free = out[k][-1][2] if out[k] else 0
                if own <= s < to and s >= free and not _touched(reach[k], s, e):
                    out[k].append((s, kind, e))
        waiting.clear()

    size = 0
    for k, text in enumerate(texts):
        for window in windows(text, reach[k]):
            waiting.append((k, *window))
            size += len(window[1])
            if size >= SCORED:
                look()
                size = 0
    look()
    return out


def _touched(reach: tuple[list[int], list[int]], s: int, e: int) -> bool:
    """Whether a base span overlaps s to e; reach holds their starts in order and the furthest end up to each."""
    starts, ends = reach
    k = bisect_left(starts, e)
    return k > 0 and ends[k - 1] > s


def _reach(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    return [s for s, _, _ in spans], np.maximum.accumulate([e for _, _, e in spans]).tolist() if spans else []


_SIGNS = re.compile(r"[0-9@+]|[\[(][aA][tT][\])]")


def find(texts: list[str], weights: np.ndarray) -> tuple[list[list], list[list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) if _SIGNS.search(t) else [] for t in texts]
    added = added_spans(texts, weights, [_reach(b) for b in base])
    return base, [sorted(b + a) for b, a in zip(base, added)]


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _report(weights: np.ndarray):
    def run(batches):
        for batch, column in pieces(batches, "text"):
            counts, digests, every = [], [], []
            for base, spans in zip(*find([t or "" for t in column.to_pylist()], weights)):
                counts.append([sum(k == n for _, k, _ in base) for n in range(len(KINDS))])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                every.append(written(spans))
            by_kind = zip(*counts)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in by_kind), pa.array(digests), pa.array(every)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each whole text.

    Counts and digest are those of the fixed patterns, spans holds the field's as well. A null text counts as
    empty and has none. Rows are independent of each other; other columns change nothing. An empty table gives
    no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_report(fitted()), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans) -> str:
    """The text with each span as its kind in brackets; a span inside or across an earlier one goes with it."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += (text[at:s], f"[{KINDS[k].upper()}]")
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """docs with the spans of text_col masked, and with the new length in chars_col if one is named.

    Null texts stay null and have no length. Rows are masked one by one, so repeated rows stay equal; all other
    columns are kept, and an empty table stays empty.
    """
    weights = fitted()

    def run(batches):
        for batch, column in pieces(batches, text_col):
            texts = column.to_pylist()
            _, spans = find([t or "" for t in texts], weights)
            texts = [t if t is None else masked(t, x) for t, x in zip(texts, spans)]
            columns = dict(zip(batch.schema.names, batch.columns))
            columns[text_col] = pa.array(texts, batch.schema.field(text_col).type)
            if chars_col:
                columns[chars_col] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(chars_col).type)
            yield pa.record_batch(list(columns.values()), schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
