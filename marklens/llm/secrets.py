"""Secrets in whole texts: a keyword automaton, anchored patterns only at its hits, then embedded checksums.

An Aho-Corasick automaton runs over the lower-cased bytes of a batch of texts.  A pattern is tried only where one of its
keywords begins, so text without keywords is read once.  Hexadecimal runs have no keyword; they are found as runs of a
byte class.  Kinds that carry a check value count only if it holds.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marklens.llm import bytetext as bt
from marklens.llm.tables import small_batches, texts

# Kinds of the base, their keywords and patterns.
BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX_LENGTH = 16
_DIGITS62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# Kinds with a check inside, after the base.
CHECKED = ("git_token", "package_token", "web_token", "private_key")
_GIT = re.compile(rb"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
_PACKAGE = re.compile(rb"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])")
_WEB = re.compile(rb"eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+")
_PRIVATE = re.compile(rb"-----BEGIN ([A-Z ]{0,20}PRIVATE KEY)-----\s*((?:[A-Za-z0-9-]+:[^\n]*\n(?:[ \t]+[^\s][^\n]*\n)*)*)([0-9A-Za-z+/=\s]+?)-----END \1-----")
_ENCRYPTED = re.compile(rb"^DEK-Info: *[A-Z0-9]+-[A-Z0-9-]+, *([0-9A-Fa-f]+)\s*$", re.MULTILINE)
_OPENSSH = b"openssh-key-v1\0"
KINDS = BASE + CHECKED


def _assign(m: re.Match) -> bool:
    return len(m[2]) >= 12


def _access(m: re.Match) -> bool:
    return len(m[0]) >= 18


def _crc62(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the thirty before, in base 62."""
    body, tail = m[0][-36:-6], m[0][-6:]
    value = zlib.crc32(body)
    digits = bytearray()
    for _ in range(6):
        value, r = divmod(value, 62)
        digits.append(_DIGITS62[r])
    return bytes(digits[::-1]) == tail


def _web(m: re.Match) -> bool:
    """The first part decodes to a JSON object that names an algorithm."""
    head = m[0].split(b".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


def _private(m: re.Match) -> bool:
    """The body decodes to one DER sequence of just its stated length, to an OpenSSH key whose lengths fill it, or, below
    a header that names cipher and start vector, to whole blocks of that vector's size or at least of eight bytes."""
    try:
        body = base64.b64decode(re.sub(rb"\s", b"", m[3]), validate=True)
    except (ValueError, binascii.Error):
        return False
    if body.startswith(_OPENSSH):
        return _fields_fill(body[len(_OPENSSH) :])
    sealed = _ENCRYPTED.search(m[2])
    if sealed:
        return len(body) > 0 and len(body) % min(max(len(sealed[1]) // 2, 1), 8) == 0
    return _der(body)


def _der(der: bytes) -> bool:
    if len(der) < 2 or der[0] != 0x30:
        return False
    if der[1] < 128:
        return len(der) == 2 + der[1]
    n = der[1] & 127
    return len(der) > 2 + n and len(der) == 2 + n + int.from_bytes(der[2 : 2 + n], "big")


def _fields_fill(rest: bytes) -> bool:
    """Cipher, key derivation and its options, the number of keys, so many public keys and the private part, and no more."""
    at, left = 0, 3
    keys = None
    while left:
        if at + 4 > len(rest):
            return False
        at += 4 + int.from_bytes(rest[at : at + 4], "big")
        left -= 1
        if not left and keys is None:
            keys = int.from_bytes(rest[at : at + 4], "big")
            at, left = at + 4, keys + 1
    return at == len(rest) and keys > 0


#: keyword, lower-cased -> kind, pattern anchored at it, check of a match.
_RULES: list[tuple[str, str, re.Pattern, Callable[[re.Match], bool]]] = [
    *((k, "assign", _ASSIGN, _assign) for k in ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("akia", "access", _ACCESS, _access),
    *((k, "git_token", _GIT, _crc62) for k in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("npm_", "package_token", _PACKAGE, _crc62),
    ("eyj", "web_token", _WEB, _web),
    ("-----begin ", "private_key", _PRIVATE, _private),
]
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_automaton = None


def _keywords():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for i, rule in enumerate(_RULES):
            _automaton.add_word(rule[0], (len(rule[0]), i))
        _automaton.make_automaton()
    return _automaton


def find(data: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, str, int]]]:
    """For each text its (start, kind, end) by start, then kind; leftmost and non-overlapping within a kind."""
    out: list[list[tuple[int, str, int]]] = [[] for _ in range(len(bounds) - 1)]
    if not len(data):
        return out
    raw = data.tobytes()
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    hits = sorted((end - size + 1, i) for end, (size, i) in _keywords().iter(bt.LOWER[data].tobytes().decode("latin-1")))
    owner = np.searchsorted(bounds, [h[0] for h in hits], "right") - 1
    reach: dict[tuple[int, str], int] = {}
    for (at, i), d in zip(hits, owner.tolist(), strict=True):
        _, kind, pattern, holds = _RULES[i]
        if at < reach.get((d, kind), 0):
            continue
        m = pattern.match(raw, at, int(bounds[d + 1]))
        if m:
            reach[d, kind] = m.end()
            if holds(m):
                out[d].append((at, kind, m.end()))
    inside = _HEX[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = bounds[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = b - a >= _HEX_LENGTH
    for x, y, d in zip(a[long].tolist(), b[long].tolist(), (np.searchsorted(bounds, a[long], "right") - 1).tolist(), strict=True):
        out[d].append((x, "hex", y))
    for d, spans in enumerate(out):
        if spans:
            base = int(points[bounds[d]])
            spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
            out[d] = [(int(points[x]) - base, kind, int(points[y]) - base) for x, kind, y in spans]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``found``, an array of (kind, start, end) by start, then kind.

    Null and empty texts hold nothing; repeated rows are scanned as often as they occur; null ids stay null; other
    columns are ignored; texts of any length are read whole; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = bt.raw(batch.column(1))
            for i, j in bt.pieces(bounds):
                found = find(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                rows = [[{"kind": k, "start": a, "end": b} for a, k, b in spans] for spans in found]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, kind)], names=["doc_id", "found"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs``, all columns and rows, with every found span replaced by ``[kind]``; overlapping spans become one.

    ``size_col``, where present, is set to the new length of a changed text.  Null texts stay null.
    """
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)
    sized = docs.columns.index(size_col) if size_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = bt.raw(batch.column(place))
            changed: dict[int, str] = {}
            for i, j in bt.pieces(bounds):
                for k, spans in enumerate(find(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]), i):
                    if spans:
                        text, at, out = data[bounds[k] : bounds[k + 1]].tobytes().decode(), 0, []
                        for a, kind, b in spans:
                            if a >= at:
                                out += [text[at:a], f"[{kind}]"]
                            at = max(at, b)
                        changed[k] = "".join(out) + text[at:]
            if changed:
                columns = list(batch.columns)
                values = columns[place].to_pylist()
                for k, t in changed.items():
                    values[k] = t
                columns[place] = pa.array(values, columns[place].type)
                if sized is not None:
                    sizes = columns[sized].to_pylist()
                    for k, t in changed.items():
                        sizes[k] = len(t)
                    columns[sized] = pa.array(sizes, columns[sized].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)

