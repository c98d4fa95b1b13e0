"""Secrets: fixed patterns, and assignment-aware lexing that adds literals by the names they are given.

Source and configuration syntax is read into name-literal pairs: `name = "..."`, `name: ...`, `"name": "..."`,
`name := ...`, `table["name"] = ...`, `name: type = ...`, `NAME=value`, `--name value`, `<name>...</name>`,
`setName("...")` and `scheme://user:password@host`.  The right side may join literals and names, by operators or side
by side.  A name stands for what it was given last before that place, or first after it if nothing came
before, so a literal reaches every name that it is handed on to.  A literal is scored by the most
sensitive name that it reaches, and by its own length, variety and form; placeholders lose.

Statements are looked for only where a text has a stem of a sensitive name, since no other text has a pair
that counts.  Names and right sides are read once, from the left, so the work grows linearly with the text.
"""

from __future__ import annotations

import hashlib
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

KINDS = ["assign", "access", "hex", "literal"]
ASSIGN, ACCESS, HEX, LITERAL = range(4)
#: Sum of the scores of name and literal from which on a literal is a secret.
ENOUGH = 4

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_STEMS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def base_spans(text: str, low: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, each kind leftmost without overlaps, in order. `low` is the text in UTF-8, A-Z lower-cased."""
    out = []
    if any(s in low for s in _STEMS):
        out += [(m.start(), ASSIGN, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), ACCESS, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), HEX, m.end()) for m in _HEX.finditer(text)]  # a run that is long enough is one match of any length
    return sorted(out)


# ---- names and literals ----

#: Words and pairs of words of names, and how much they say of what the name holds.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "passcode": 3, "secret": 3, "credential": 3, "credentials": 3, "apikey": 3, "token": 2, "bearer": 2, "jwt": 2, "auth": 2, "authorization": 2, "dsn": 2, "pass": 2, "privatekey": 3, "secretkey": 3, "accesskey": 3, "authkey": 3,
    "api key": 3, "access key": 3, "private key": 3, "secret key": 3, "signing key": 3, "encryption key": 3, "master key": 3, "auth key": 3, "account key": 3, "shared key": 3, "connection string": 3, "auth token": 3, "access token": 3, "refresh token": 3, "session token": 3,
}
#: Last words of names that describe a secret and don't hold it.
ABOUT = set("id ids type name names count length size file path url uri field label policy hint prompt format header limit expiry expires ttl max min regex pattern column index description message error status version".split())
#: Words without which no name scores.
_WORTH = tuple(sorted({w.encode() for k in SENSITIVE for w in k.split()[:1]}))
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_PLACEHOLDER = re.compile(r"(?ai:example|sample|changeme|change.me|placeholder|redacted|dummy|your.|insert.|replace|todo|fixme|undefined|null\b|none\b|true\b|false\b)|\*\*\*|xxx|XXX|\.\.\.|^<.*>$|^\$\(|\{\{|^%[sd]$|^[A-Z]+(?:_[A-Z]+)+$")
_TEMPLATE = re.compile(r"\$?\{([A-Za-z_]\w*)\}|\$([A-Za-z_]\w*)")


@lru_cache(maxsize=1 << 14)
def name_score(name: str) -> int:
    """How sensitive a target is: the best of its words and pairs of words, 0 if its last word says that it is about a secret."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[-1] in ABOUT:
        return 0
    return max(SENSITIVE.get(w, 0) for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])


@dataclass
class Value:
    """What a name stands for: a literal, or parts that are joined. The features are those of the joined text."""

    span: tuple[int, int] | None
    parts: tuple[Value, ...] = ()
    length: int = 0
    chars: int = 0
    fake: bool = False
    reached: tuple[int, str] = (0, "")

    def score(self) -> int:
        """Of the literal by itself, -9 if it can't be a secret."""
        if self.length < 6 or self.fake:
            return -9
        classes = [bool(self.chars & c) for c in _CLASSES]
        return (self.length >= 8) + (self.length >= 16) + (classes[0] and (classes[1] or classes[2])) + (self.chars.bit_count() >= 12) - 3 * classes[3]


_mask = lambda chars: sum(1 << ord(c) for c in chars)
#: Digits, lower-case and upper-case letters, blanks.
_CLASSES = [_mask("0123456789"), _mask("abcdefghijklmnopqrstuvwxyz"), _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask(" \t")]


def literal(text: str, s: int, e: int) -> Value:
    part = text[s:e]
    return Value((s, e), (), e - s, _mask({c if c < "\x80" else "\x7f" for c in part}), bool(_PLACEHOLDER.search(part)))


def joined(parts: list[Value]) -> Value:
    if len(parts) == 1:
        return parts[0]
    chars = 0
    for p in parts:
        chars |= p.chars
    return Value(None, tuple(parts), min(sum(p.length for p in parts), 1 << 20), chars, any(p.fake for p in parts))


# ---- syntax ----

_NAME = r"(?:[^\W\d]|\$)[\w$]*+(?:(?:[.-]|->)[\w$]++)*+"
#: A name, maybe quoted or a key in brackets, and what gives it a value.
_HEAD = re.compile(rf"""(?:(?P<q>["'`])(?P<quoted>[\w $./-]{{1,80}}+)(?P=q)|(?<![\w$])(?<![\w$][.-])(?P<name>{_NAME}))[ \t]*+\]*+[ \t]*+(?P<op>:=|=>|\+=|=(?![=>])|:(?![:/]))""")
_TAG = re.compile(r"<([A-Za-z][\w.-]{0,80}+)>([^<\s]{1,4096}+)</")
_FLAG = re.compile(r"(?<!\S)--([A-Za-z][\w-]{0,80}+)[ \t]++(?!-)(\S+)")
_CALL = re.compile(r"""\b(?:set|with|use|add)_?([A-Za-z]\w{0,80}+)\([ \t]*+(?=["'`])""")
_URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}+://[^\s/:@\"']{0,80}+:([^\s/@\"']{1,256}+)@")
_STRING = re.compile(r""""(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\.)*+`""")
_REF = re.compile(_NAME)
_BARE = re.compile(r"""[^\s"'`,;<>(){}\[\]]+""")
_SCHEME = re.compile(r"(?ai:bearer|basic|token)[ \t]+")
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.?(?=[ \t]*[\"'`])|\|\||&|\?\?|,)?[ \t]*")
#: Calls whose first literal is the name of a setting.
_GETTER = re.compile(r"(?ai)(?:^|[._])(?:get\w*|env|environ|fetch|lookup|config|param)$")


def _right_side(text: str, at: int, stop: int) -> tuple[list[tuple[int, int] | str], int]:
    """(literals as spans and names as strings, end) of the expression at a place. It ends where another pair begins or the line does."""
    parts: list[tuple[int, int] | str] = []
    depth, skip = 0, False
    while at < stop:
        c = text[at]
        if c in " \t" or depth and c == "\n":
            at += 1
        elif c in "\"'`":
            m = _STRING.match(text, at)
            if not m:
                break
            if not skip:
                parts.append((at + 1, m.end() - 1))
            skip, at = False, m.end()
        elif c in "([":
            depth += 1
            at += 1
        elif c in ")]":
            if not depth:
                break
            depth, at = depth - 1, at + 1
        elif c in "+&|?.\\" or c == "," and depth:
            at += 1
            if text[at : at + 1] == "\n":
                at += 1
        elif m := _REF.match(text, at, stop):
            name, at = m.group(), m.end()
            if text[at : at + 1] in ('"', "'") and len(name) < 3:
                continue  # the prefix of a string
            if text[at : at + 1] in ("(", "["):
                skip = bool(_GETTER.search(name))
            else:
                parts.append(name.lstrip("$"))
        else:
            break
    return parts, at


def pairs(text: str) -> Iterator[tuple[int, str, list[tuple[int, int] | str]]]:
    """(place, name, right side) of the name-literal pairs of a text, in order for each kind of syntax."""
    heads = list(_HEAD.finditer(text))
    for k, m in enumerate(heads):
        name = m.group("quoted") or m.group("name")
        at, stop = m.end(), heads[k + 1].start() if k + 1 < len(heads) else len(text)
        while text[at : at + 1] in (" ", "\t"):
            at += 1
        if m.group("op") == ":" and k + 1 < len(heads) and heads[k + 1].group("op") == "=" and re.fullmatch(r"[\w.<>\[\], |?]*", text[at:stop][:200]) and "\n" not in text[at : heads[k + 1].end()]:
            at, stop = heads[k + 1].end(), heads[k + 2].start() if k + 2 < len(heads) else len(text)  # `name: type = ...`
            while text[at : at + 1] in (" ", "\t"):
                at += 1
        at = s.end() if (s := _SCHEME.match(text, at)) else at
        parts, end = _right_side(text, at, stop)
        bare = _BARE.match(text, at, stop)
        if bare and text[bare.end() : bare.end() + 1] not in ("(", "[") and not any(isinstance(p, tuple) for p in parts):
            word = bare.group().rstrip(".:!?&")
            if re.search(r"[0-9]", word) and re.search(r"[A-Za-z]", word) and bare.end() >= end:
                parts = [word, (at, at + len(word))] if re.fullmatch(r"\w+", word) else [(at, at + len(word))]
        yield m.start(), name, parts
    for m in _TAG.finditer(text):
        yield m.start(), m.group(1), [m.span(2)]
    for m in _FLAG.finditer(text):
        s, e = m.span(2)
        quoted = text[s] in "\"'" and e - s > 2 and text[e - 1] == text[s]
        yield m.start(), m.group(1), [(s + quoted, e - quoted)]
    for m in _CALL.finditer(text):
        if s := _STRING.match(text, m.end()):
            yield m.start(), m.group(1), [(s.start() + 1, s.end() - 1)]
    if "://" in text:
        for m in _URL.finditer(text):
            yield m.start(), "password", [m.span(1)]


_SELF = re.compile(r"^(?:self|this)(?:\.|->)")


def literals(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, name, score) of the literals that sensitive names reach, in order; score counts name and literal."""
    found = sorted(pairs(text), key=lambda p: p[0])
    known: dict[tuple[int, int], Value] = {}

    def value(span: tuple[int, int]) -> Value:
        if span not in known:
            known[span] = literal(text, *span)
        return known[span]

    first: dict[str, list[Value]] = {}  # of names that are used before they are given something
    for _, name, parts in found:
        direct = [value(p) for p in parts if isinstance(p, tuple)]
        if direct:
            first.setdefault(_SELF.sub("", name), direct)
    stands: dict[str, Value] = {}
    given: list[tuple[str, Value]] = []
    for _, name, parts in found:
        have: list[Value] = []
        alone = len(parts) == 2 and isinstance(parts[0], str) and isinstance(parts[1], tuple)  # a bare word: a name if there is one
        for p in parts:
            if isinstance(p, str):
                ref = _SELF.sub("", p)
                if ref in stands:
                    have.append(stands[ref])
                elif ref in first:
                    have += first[ref]
                if alone and have and text[parts[1][0] : parts[1][1]] == p:
                    break
            else:
                inner = [stands[r] for a, b in _TEMPLATE.findall(text[p[0] : p[1]]) if (r := a or b) in stands] if "{" in text[p[0] : p[1]] or "$" in text[p[0] : p[1]] else []
                have += inner or [value(p)]
        key = _SELF.sub("", name)
        if have:
            stands[key] = joined(have)
            given.append((key, stands[key]))
        else:
            stands.pop(key, None)
    out: dict[tuple[int, int], tuple[int, str]] = {}
    for name, whole in given:
        worth = name_score(name)
        if not worth or worth + whole.score() < ENOUGH:
            continue
        reach = (worth + whole.score(), name)
        todo = [whole]
        while todo:  # a value that a better name has reached is done with all its parts
            v = todo.pop()
            if v.reached[0] < reach[0]:
                v.reached = reach
                if v.span and v.span[1] > v.span[0]:
                    out[v.span] = reach
                todo += v.parts
    return [(s, e, name, score) for (s, e), (score, name) in sorted(out.items())]


def _free(base: list[tuple[int, int, int]]):
    """Whether a span overlaps none of the base spans."""
    starts, ends = [s for s, _, _ in base], np.maximum.accumulate([e for _, _, e in base]).tolist() if base else []

    def test(s: int, e: int) -> bool:
        k = bisect_left(starts, e)
        return not (k and ends[k - 1] > s)

    return test


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str | None, int | None]]]:
    """(base spans, all spans with the name and score of added ones) of a text; added ones overlap no others."""
    low = text.encode().lower()
    base = base_spans(text, low)
    every = [(*b, None, None) for b in base]
    if any(w in low for w in _WORTH) or b"://" in low and b"@" in low:
        free, last = _free(base), 0
        for s, e, name, score in literals(text):
            if s >= last and free(s, e):
                every.append((s, LITERAL, e, name, score))
                last = e
    return base, sorted(every, key=lambda x: x[:3])


def written(spans) -> str:
    return ",".join(f"{KINDS[x[1]]}:{x[0]}:{x[2]}" for x in spans)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts, texts.schema["doc_id"].dataType.simpleString()


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each whole text.

    Counts and digest are those of the fixed patterns, spans holds the added literals as well. A null text
    counts as empty and has none. Rows are independent of each other, so null or repeated ids, repeated
    rows and other columns change nothing; an empty table gives no rows.
    """

    def run(batches):
        for batch, column in pieces(batches, "text"):
            counts, digests, spans = [], [], []
            for text in column.to_pylist():
                base, every = find(text or "")
                counts.append([sum(b[1] == k for b in base) for k in (ASSIGN, ACCESS, HEX)])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(digests), pa.array(spans)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    texts, kind = _texts(docs, id_col, text_col)
    return texts.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, name, score): a row for each span, with the name that it was scored by if it is a literal.

    Offsets count code points. Null and empty texts give no rows, repeated rows one set each.
    """

    def run(batches):
        for batch, column in pieces(batches, "text"):
            which, rows = [], []
            for k, text in enumerate(column.to_pylist()):
                every = find(text or "")[1]
                which += [k] * len(every)
                rows += every
            start, kind, end, name, score = zip(*rows) if rows else ((),) * 5
            yield pa.record_batch([batch.column("doc_id").take(pa.array(which, pa.int64())), pa.array([KINDS[k] for k in kind], pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(name, pa.string()), pa.array(score, pa.int64())], names=["doc_id", "kind", "start", "end", "name", "score"])

    texts, kind = _texts(docs, id_col, text_col)
    return texts.mapInArrow(run, f"doc_id {kind}, kind string, start long, end long, name string, score long")


def masked(text: str, spans) -> str:
    """The text with each span as [SECRET]; one that begins inside an earlier one goes with it."""
    out, at = [], 0
    for s, _, e, *_ in spans:
        if s >= at:
            out += (text[at:s], "[SECRET]")
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with all spans of text_col masked. Null texts stay null; other columns, ids and repeated rows stay as they are, and an empty table stays empty."""

    def run(batches):
        for batch, column in pieces(batches, text_col):
            texts = [t if t is None else masked(t, find(t)[1]) for t in column.to_pylist()]
            yield batch.set_column(batch.schema.get_field_index(text_col), batch.schema.field(text_col), pa.array(texts, batch.schema.field(text_col).type))

    return docs.mapInArrow(run, docs.schema)
