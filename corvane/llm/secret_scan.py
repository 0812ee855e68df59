"""Secret scan: assignment-aware lexing of names and literals, with constant propagation.

Three plain patterns give the base spans. Beyond them, source and configuration syntax is read into
(name, expression) pairs: ``name = "a" + b``, ``"name": 'x'``, ``name => x``, ``cfg["name"] := x``. A type
between name and ``=`` is skipped (``name: str = "a"``, ``var name string = "a"``), as are prefixes of
literals (``b"a"``) and the scheme before a credential (``"Bearer x"``). Literals among a call's arguments
(``os.getenv("NAME", "a")``), triple-quoted literals and element texts (``<password>a</password>``) are
values, too. A run without blanks is read whole once, and by the operators within it up to the next one,
so the time is in proportion to the text. Names, blanks before operators and expressions may have any length. Literals
bound to names are remembered, so a secret that reaches a sensitive name through constants or
concatenation is found where its literals stand. A pair is reported when its name is sensitive and its
value looks like a secret; the score is the product of both.

Offsets are code points, the end is exclusive. Null and empty texts have no spans. Extra columns stay;
equal rows give equal results.
"""

from __future__ import annotations

import functools
import math
import re
import string
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corvane.llm.common import arrow_map, text_buffers

# Kinds in the order of ties, and the base patterns.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
# Parts of names and what they say of a secret (1 is certain).
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "pass": 0.9, "authorization": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "privatekey": 1.0, "accesskey": 1.0,
    "signingkey": 0.9, "encryptionkey": 0.9, "connectionstring": 0.7, "dsn": 0.6, "webhook": 0.6, "salt": 0.5, "pin": 0.4,
}
PAIRED = {"api": "key", "private": "key", "access": "key", "signing": "key", "encryption": "key", "connection": "string"}
PLACEHOLDERS = {"changeme", "example", "password", "secret", "token", "none", "null", "true", "false", "undefined", "todo"}
LEAST_SCORE = 0.45
#: So many characters of a value tell whether it is a placeholder.
HEAD = max(map(len, PLACEHOLDERS)) + 1

_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*b"0123456789abcdef"]] = True
_BLANKS, _NAME_CHARS, _NOT_FIRST = " \t", string.ascii_letters + string.digits + "_.-", string.digits + ".-"
_OPERATOR = re.compile(r":=|=>|==|::|=|:")
_LITERAL = r"""[ \t]*(?:(?:[bBfFrRuUtTcLN]|[bBfFuU][rR]|[rR][bBfF]|u8R?|[LU]R|b?r\#*|[@$]{1,2})?(?:(?:\"{3}|'{3})((?:[^"'\\]|\\[\s\S]|["'](?!["']{2}))*+)(?:\"{3}|'{3})|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)|([A-Za-z_][A-Za-z0-9_.-]*+)(?![A-Za-z0-9+/=_-])|(%s))"""
_ATOM = re.compile(_LITERAL % r"""[^\s,;(){}\[\]"'`]+""")
#: Within an unquoted run that an earlier operator has read whole, a value ends where the next pair may begin.
_INNER_ATOM = re.compile(_LITERAL % r"""[^\s,;(){}\[\]"'`&=:?]+(?:={1,2}(?![^\s,;(){}\[\]"'`&]))?""")
#: Literals in the arguments of a call, up to its end or the end of the line.
_ARGUMENT = re.compile(r"""[^"'`()\n]*+(?:([()])|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)""")
_IDENTIFIER = re.compile(r"[A-Z][A-Z0-9_]*|[a-z][a-z_./-]*")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)>[ \t\n]*+([^<>\s][^<>]*+)</")
#: Names of schemes that stand before a credential.
_SCHEME = re.compile(r"(?:Bearer|Basic|Token|bearer|basic|token)[ \t]+(?=\S+$)")
_PLUS = re.compile(r"[ \t]*(?:\+|\.\.)[ \t]*(?=[\"'`A-Za-z_]|[@$]{1,2}\")")
_BRACKETS = re.compile(r"[<(\[]|[>)\]]|[^<>()\[\]]+")
#: A type whose brackets are written as one word: ``str``, ``&'static str``, ``string | null``, ``"Key"``, ``String?``.
_UNIT = r"""["']?[&*]*+(?:'[a-z_]+[ \t]+)?(?:(?:mut|readonly|const|dyn|unsigned|static)[ \t]+)*+[A-Za-z_][A-Za-z0-9_.]*+(?:::[A-Za-z0-9_.]+)*+[?!]?["']?"""
_TYPE = re.compile(rf"[ \t]*+{_UNIT}(?:[ \t]*+[|&][ \t]*+{_UNIT})*+[ \t]*+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value_start: int
    score: float


def base_spans(text: str, maybe_hex: bool = True) -> list[Span]:
    """The base patterns, leftmost and non-overlapping within each kind."""
    low = text.lower()
    spans = []
    if any(name in low for name in _NAMES):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= MIN_VALUE:
                spans.append(Span("assign", m.start(), m.end(), m.start(2), 1.0))
    if "AKIA" in text:
        spans += [Span("access", m.start(), m.end(), m.start(), 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if maybe_hex:
        spans += [Span("hex", m.start(), m.end(), m.start(), 1.0) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return spans


@functools.lru_cache(maxsize=4096)
def name_weight(name: str) -> float:
    """How sensitive a target name is, by its parts (snake, kebab, dotted or camel case)."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:]) if PAIRED.get(a) == b]
    return max((SENSITIVE.get(p, 0.0) for p in parts + pairs), default=0.0)


class Value:
    """Literals and earlier values in a row, with what the score needs of their joined text.

    Only the parts themselves are held, not the literals below them, so a value of values stays small.
    A value of literals alone is measured when it is first asked for: most names are not sensitive.
    """

    __slots__ = ("parts", "length", "counts", "head", "plain", "score")

    def __init__(self, parts: list[Value | tuple[str, int, int, bool]]):
        self.parts, self.length, self.score = parts, -1, 0.0
        if any(isinstance(part, Value) for part in parts):
            self.measure()

    def measure(self) -> Value:
        if self.length >= 0:
            return self
        self.length, self.counts, self.head, self.plain = 0, Counter(), "", True
        for part in self.parts:
            if isinstance(part, Value):
                part.measure()
                length, counts, text, plain = part.length, part.counts, part.head, part.plain
            else:
                text, _, _, quoted = part
                length, counts, plain = len(text), text, not quoted and text.isalpha()
            if self.length < HEAD:
                self.head = (self.head + text[:HEAD])[:HEAD]
            self.length += length
            self.counts.update(counts)
            self.plain = self.plain and plain
        if self.length > 1 << 60:  # doubled over and over: only the shares of the characters count from here
            self.counts = Counter({c: n * (1 << 30) / self.length for c, n in self.counts.items()})
            self.length = 1 << 30
        return self


def literal_weight(value: Value) -> float:
    """How much a measured value looks like a secret: length, kinds of characters, entropy."""
    if value.length < MIN_VALUE or value.length < HEAD and value.head.lower() in PLACEHOLDERS:
        return 0.0
    if value.head[:1] in "<$%{" or any(c.isspace() for c in value.counts):
        return 0.0
    shares = [n / value.length for n in value.counts.values()]
    entropy = -sum(p * math.log2(p) for p in shares if p)
    kinds = sum((any(c.islower() for c in value.counts), any(c.isupper() for c in value.counts), any(c.isdigit() for c in value.counts)))
    kinds += any(not c.isalnum() for c in value.counts)
    return min(1.0, 0.15 * kinds + 0.12 * entropy + 0.01 * min(value.length, 20))


def _run_before(text: str, at: int, chars: str) -> int:
    """Where the run of ``chars`` that ends at ``at`` begins."""
    step = 64
    while True:
        low = max(0, at - step)
        start = low + len(text[low:at].rstrip(chars))
        if start > low or not low:
            return start
        step *= 4


def _name_before(text: str, at: int) -> tuple[int, int] | None:
    """The name right before ``at``, quoted and indexed names and blanks included."""
    at = _run_before(text, at, _BLANKS)
    at -= text[at - 1 : at] == "]"
    at -= text[at - 1 : at] in ('"', "'")
    start = _run_before(text, at, _NAME_CHARS)
    start = at - len(text[start:at].lstrip(_NOT_FIRST))
    return (start, at) if start < at else None


def _is_type(text: str) -> bool:
    """Whether the text between a colon and ``=`` reads as a type."""
    words, depth = [], 0
    for m in _BRACKETS.finditer(text):
        if m.group() in ("<", "(", "["):
            depth += 1
            words.append("_" * (depth == 1))
        elif m.group() in (">", ")", "]"):
            depth -= 1
            if depth < 0:
                return False
        elif not depth:
            words.append(m.group())
    return not depth and bool(_TYPE.fullmatch("".join(words)))


def _declared_before(text: str, start: int) -> str | None:
    """The name in ``var name type``, where the type begins at ``start``."""
    end = _run_before(text, _run_before(text, start, "*[]"), _BLANKS)
    name = _run_before(text, end, _NAME_CHARS)
    word = _run_before(text, name, _BLANKS)
    if end < start and word < name < end and text[_run_before(text, word, _NAME_CHARS) : word] in ("var", "const"):
        return text[name:end]
    return None


def _literal(text: str, start: int, end: int) -> tuple[str, int, int, bool]:
    """A quoted literal without the name of a scheme before its credential."""
    own = text[start:end]
    scheme = _SCHEME.match(own)
    skip = scheme.end() if scheme else 0
    return own[skip:], start + skip, end, True


def _expression(text: str, at: int, bound: dict[str, Value], atom: re.Pattern) -> tuple[Value | None, int, int]:
    """(value, end of unquoted runs, call) of the literals and names joined by plus from ``at``.

    The value is None if a part is a call (its opening bracket is returned, else -1) or there is none.
    """
    parts, reach, call = [], 0, -1
    while True:
        m = atom.match(text, at)
        if not m:
            break
        kind = m.lastindex
        if kind == 5 and m.group(5) in bound:
            parts.append(bound[m.group(5)])
        elif kind < 5:
            parts.append(_literal(text, m.start(kind), m.end(kind)))
        elif kind == 6 or not text[m.end() : m.end() + 1] == "(":
            parts.append((m.group(kind), m.start(kind), m.end(kind), False))
            reach = m.end()
        else:
            call = m.end()
        plus = _PLUS.match(text, m.end())
        if not plus:
            break
        at = plus.end()
    return Value(parts) if parts and call < 0 else None, reach, call


def _arguments(text: str, at: int):
    """Values of the literals in a call whose bracket opens at ``at``, up to the next bracket; a key's name is none."""
    at += 1
    first = True
    while (m := _ARGUMENT.match(text, at)) and not m.group(1):
        literal = m.group(m.lastindex)
        if not (first and _IDENTIFIER.fullmatch(literal)):
            yield Value([_literal(text, m.start(m.lastindex), m.end(m.lastindex))])
        first, at = False, m.end()


def lexed_pairs(text: str):
    """(name, value) of every assignment, in order of the source, then of elements.

    Names in expressions stand for the value last bound to them. What stands between a colon and ``=`` may
    be a type or a name (``Error: password = "x"``), so the expression is given to the names before both.
    The literals among the arguments of a call are values of the name that it is assigned to.
    """
    bound: dict[str, Value] = {}
    reach = 0
    ops = [op for op in _OPERATOR.finditer(text) if op.group() != "::"]
    for k, op in enumerate(ops):
        if op.group() == "==":
            continue
        # A type before the next operator is no value, so that no earlier literal is taken for it.
        after = ops[k + 1] if k + 1 < len(ops) else None
        typed = op.group() == ":" and after and after.group() == "=" and _is_type_line(text, op.end(), after.start())
        names = []
        at = _name_before(text, op.start())
        if at:
            names.append(text[slice(*at)])
        if op.group() == "=":
            if k and ops[k - 1].group() == ":" and _is_type_line(text, ops[k - 1].end(), op.start()):
                colon = ops[k - 1].start()
                other = _name_before(text, colon - (text[colon - 1 : colon] in ("?", "!")))
                names += [text[slice(*other)]] if other else []
            elif at and (other := _declared_before(text, at[0])):
                names.append(other)
        if not names:
            continue
        # A run without blanks is read whole once; operators within it read up to the next one.
        inner = op.start() < reach
        value, end, call = _expression(text, op.end(), {} if typed else bound, _INNER_ATOM if inner else _ATOM)
        reach = max(reach, end)
        if call >= 0 and any(map(name_weight, names)):
            for value in _arguments(text, call):
                yield from ((name, value) for name in dict.fromkeys(names))
        elif value:
            for name in dict.fromkeys(names):
                if not typed:
                    bound[name] = value
                yield name, value
    for m in _ELEMENT.finditer(text):
        if name_weight(m.group(1)):
            own = m.group(2).rstrip()
            yield m.group(1), Value([(own, m.start(2), m.start(2) + len(own), True)])


def _is_type_line(text: str, start: int, end: int) -> bool:
    return text.find("\n", start, end) < 0 and _is_type(text[start:end])


def method_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name, directly or through constants."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    values = {}
    for name, value in lexed_pairs(text):
        values[id(value)] = value
        weight = name_weight(name)
        # A bare word after a colon is prose; unquoted values must hold a digit or a sign.
        if weight and not value.measure().plain:
            score = weight * literal_weight(value)
            value.score = max(value.score, score if score >= LEAST_SCORE else 0.0)
    found = {}
    # Later values first: each hands its score down to the parts it was made of.
    for value in reversed(values.values()):
        for part in value.parts if value.score else ():
            if isinstance(part, Value):
                part.score = max(part.score, value.score)
            elif part[2] > part[1]:
                found[part[1:3]] = max(value.score, found.get(part[1:3], 0.0))
    return [Span("literal", start, end, start, score) for (start, end), score in found.items()]


def find_secrets(text: str | None, maybe_hex: bool = True) -> list[Span]:
    """All spans by start, then kind as listed. Base spans always stay."""
    text = text or ""
    return sorted(base_spans(text, maybe_hex) + method_spans(text), key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def _long_hex(column) -> np.ndarray:
    """Which texts may hold a hex run of 24: such a run covers eight multiples of three in a row."""
    data, offsets = text_buffers(column)
    flags = np.zeros(len(offsets) - 1, bool)
    m = _IS_HEX[data[::3]]
    if len(m) >= 8:
        two = m[:-1] & m[1:]
        four = two[:-2] & two[2:]
        at = np.flatnonzero(four[:-4] & four[4:]) * 3
        flags[np.searchsorted(offsets, at, "right") - 1] = True
    return flags


def redacted(text: str | None, spans: list[Span], mark: str = "[SECRET]") -> str | None:
    """``text`` with the values of the spans replaced; overlapping values become one mark."""
    out, at = [], 0
    for start, end in sorted((s.value_start, s.end) for s in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("value_start", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def scan_secrets(docs: DataFrame, redact: bool = False) -> DataFrame:
    """``docs`` plus ``spans``, an array of (kind, start, end, value_start, score) for the input text.

    With ``redact`` the values are replaced in ``text``. A map over batches: nothing is shuffled.
    """
    own = [f for f in docs.schema.fields if f.name != "spans"]
    names = [f.name for f in own]
    at = names.index("text")
    numbers = [pa.int64()] * 3
    fields = [pa.field(f.name, k) for f, k in zip(SPAN.fields, [pa.string(), *numbers, pa.float64()])]

    def scan(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [find_secrets(t, flag) for t, flag in zip(texts, _long_hex(batch.column("text")).tolist())]
            arrays = list(batch.columns)
            if redact:
                arrays[at] = pa.array([redacted(t, s) for t, s in zip(texts, found)], pa.string())
            spans = pa.array([[s._asdict() for s in own] for own in found], pa.list_(pa.struct(fields)))
            yield pa.RecordBatch.from_arrays([*arrays, spans], [*names, "spans"])

    schema = T.StructType([*own, T.StructField("spans", T.ArrayType(SPAN))])
    return arrow_map(docs.select(*names), scan, schema)
