"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Every proposal starts from the score of its pattern. A checksum or a rule of its kind either rejects it (Luhn for cards,
mod-97 for bank accounts, ranges for addresses and social security numbers) or leaves it; words of the kind within
``WINDOW`` characters raise the score, words that speak against it lower it. A span counts from ``threshold`` on. The
*base* spans (e-mail, IPv4, cards of 16 to 19 digits, numbers with a plus sign) need no context: whatever their score,
they stay. Other proposals that overlap a base span, or a better one of their own sort, go.

All patterns run in time that grows with the text's length: runs of characters are taken whole, never tried from each
of their places, so one text of many megabytes is no trouble. Offsets are code points, the end exclusive.

Null and empty texts have no spans; rows stay as they are, repeated ones and those without an id included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerlens.llm.common import add_columns, texts

#: All kinds, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "ipv6")
BASE = KINDS[:4]
THRESHOLD = 0.5
WINDOW = 48
RAISE, LOWER = 0.35, 0.25


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


# ---- base patterns ----

_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(rb"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)


def emails(text: bytes) -> Iterator[tuple[int, int]]:
    """Around each ``@``: the run of local characters before it, a domain behind it."""
    free, at = 0, text.find(b"@")
    while at >= 0:
        local = text[free:at]
        local = len(local) - len(local.rstrip(_LOCAL))
        free = at + 1
        if local and (domain := _DOMAIN.match(text, at + 1)):
            yield at - local, domain.end()
            free = domain.end()
        at = text.find(b"@", at + 1)


def ips(text: bytes) -> Iterator[tuple[int, int]]:
    """Fours of the numbers of each dotted sequence, from its left; a four with a part above 255 is passed over."""
    for found in _NUMBERS.finditer(text):
        parts = found[0].split(b".")
        place = found.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = place + sum(map(len, four)) + 3
            if all(len(p := part.lstrip(b"0")) <= 3 and int(p or b"0") <= 255 for part in four):
                yield place, end
            place = end + 1


def luhn(digits: bytes) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    doubled = sum(2 * d - (9 if d > 4 else 0) for d in (b - 48 for b in even))
    return (sum(odd) - 48 * len(odd) + doubled) % 10 == 0


def _numbers(text: bytes, pattern: re.Pattern, least: int, most: int) -> Iterator[tuple[int, int, bytes]]:
    for found in pattern.finditer(text):
        digits = found[0].translate(None, _NOT_DIGIT)
        if least <= len(digits) <= most:
            yield found.start(), found.end(), digits


def cards(text: bytes) -> Iterator[tuple[int, int]]:
    return ((a, b) for a, b, digits in _numbers(text, _CARD, 16, 19) if luhn(digits))


def phones(text: bytes) -> Iterator[tuple[int, int]]:
    return ((a, b) for a, b, _ in _numbers(text, _PHONE, 8, 15))


_BASE = {"email": (emails, 0.9), "ip": (ips, 0.6), "card": (cards, 0.8), "phone": (phones, 0.7)}

# ---- further patterns ----

_AT = re.compile(rb" ?[\[(] ?at ?[\])] ?", re.I)
_SPELLED = re.compile(rb"[A-Za-z0-9-]++(?:(?:\.| ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]++)++", re.I)
_LOCAL_PHONE = re.compile(rb"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{3,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9A-Za-z])")
_IBAN = re.compile(rb"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}(?![0-9A-Za-z])")
_SSN = re.compile(rb"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")
_IPV6 = re.compile(rb"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")


def spelled_emails(text: bytes) -> Iterator[tuple[int, int]]:
    """``name (at) host (dot) org``."""
    free = 0
    for at in _AT.finditer(text):
        local = text[free : at.start()]
        local = len(local) - len(local.rstrip(_LOCAL))
        free = at.end()
        if local and (domain := _SPELLED.match(text, at.end())):
            yield at.start() - local, domain.end()


def short_cards(text: bytes) -> Iterator[tuple[int, int]]:
    """Older and 15-digit cards, by their issuers' first digits."""
    return ((a, b) for a, b, d in _numbers(text, _CARD, 13, 15) if luhn(d) and (d[:2] in (b"34", b"37") and len(d) == 15 or d[:1] == b"4" and len(d) == 13))


def local_phones(text: bytes) -> Iterator[tuple[int, int]]:
    return ((a, b) for a, b, _ in _numbers(text, _LOCAL_PHONE, 8, 12))


def mod97(account: bytes) -> bool:
    """Of an account number whose first four characters are moved to its end, letters read as 10 to 35."""
    return int("".join(str(int(chr(c), 36)) for c in account[4:] + account[:4])) % 97 == 1


def ibans(text: bytes) -> Iterator[tuple[int, int]]:
    """Words of capitals may stand behind an account number: the longest part that ends with a whole group and passes."""
    for found in _IBAN.finditer(text):
        groups = re.split(rb"[ -]", found[0])
        for n in range(len(groups), 0, -1):
            account = b"".join(groups[:n])
            if 15 <= len(account) <= 34 and mod97(account):
                yield found.start(), found.start() + sum(map(len, groups[:n])) + n - 1
                break


def _found(pattern: re.Pattern):
    return lambda text: (m.span() for m in pattern.finditer(text))


_FURTHER = (
    ("email", spelled_emails, 0.6),
    ("card", short_cards, 0.45),
    ("iban", ibans, 0.8),
    ("ssn", _found(_SSN), 0.3),
    ("ipv6", _found(_IPV6), 0.6),
    ("phone", local_phones, 0.2),
)


def _any_of(words: str) -> re.Pattern:
    return re.compile(rb"(?<![a-z])(?:" + "|".join(words.split()).encode() + rb")(?![a-z])")


_FOR = {
    "email": _any_of("e-?mail mail contact correo courriel"),
    "ip": _any_of("ip address server host adresse"),
    "card": _any_of("card credit visa mastercard amex payment karte tarjeta carte"),
    "phone": _any_of("phone tel telephone telefon mobile cell call fax whatsapp handy"),
    "iban": _any_of("iban account bank konto cuenta compte"),
    "ssn": _any_of("ssn social security"),
    "ipv6": _any_of("ip ipv6 address server host"),
}
_AGAINST = {
    "ip": _any_of("version release section build"),
    "card": _any_of("isbn order tracking serial"),
    "phone": _any_of("isbn order tracking serial version part"),
    "ssn": _any_of("isbn order part serial model"),
}


def _score(text: bytes, kind: str, start: int, end: int, score: float) -> float:
    near = (text[max(0, start - WINDOW) : start] + b" " + text[end : end + WINDOW // 2]).lower()
    if _FOR[kind].search(near):
        score += RAISE
    if kind in _AGAINST and _AGAINST[kind].search(near):
        score -= LOWER
    return round(min(max(score, 0.0), 1.0), 4)


_ANY = re.compile(rb"[0-9@]|[\[(] ?at ?[\])]", re.I)


def _in_bytes(text: bytes, threshold: float) -> list[Span]:
    spans = [Span(k, a, b, _score(text, k, a, b, s), True) for k, (find, s) in _BASE.items() for a, b in find(text)]
    more = [Span(k, a, b, _score(text, k, a, b, s), False) for k, find, s in _FURTHER for a, b in find(text)]
    more = sorted((s for s in more if s.score >= threshold), key=lambda s: (-s.score, s.start, s.end))
    if more:
        # Base spans of two kinds may overlap; what a span covers is marked once, then looked up.
        covered = np.zeros(len(text), np.bool_)
        for s in spans:
            covered[s.start : s.end] = True
        for s in more:
            if not covered[s.start : s.end].any():
                covered[s.start : s.end] = True
                spans.append(s)
    return spans


def find_spans(text: bytes | None, threshold: float = THRESHOLD) -> list[Span]:
    """Spans of a UTF-8 text, by kind, then start; offsets in code points."""
    if not text or not _ANY.search(text):
        return []
    spans = _in_bytes(text, threshold)
    if spans and not text.isascii():
        heads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        at, place, n = {}, 0, 0
        for x in sorted({x for s in spans for x in (s.start, s.end)}):
            n += int(np.count_nonzero(heads[place:x]))
            at[x], place = n, x
        spans = [s._replace(start=at[s.start], end=at[s.end]) for s in spans]
    return sorted(spans, key=lambda s: (KINDS.index(s.kind), s.start))


SPANS = "array<struct<kind: string, start: bigint, end: bigint, score: double, base: boolean>>"


def find_pii(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, out: str = "pii") -> DataFrame:
    """All rows and columns of ``docs`` with ``out``, the text's spans; a column of that name is replaced."""

    def compute(batch: pa.RecordBatch) -> list:
        return [[[s._asdict() for s in find_spans(t, threshold)] for t in texts(batch, text_col)]]

    return add_columns(docs, compute, f"`{out}` {SPANS}")


def mask(text: bytes | None, threshold: float = THRESHOLD) -> tuple[bytes | None, int]:
    """A text with each stretch of overlapping spans replaced by the first one's kind, and the number of stretches."""
    spans = [] if not text or not _ANY.search(text) else sorted(_in_bytes(text, threshold), key=lambda s: (s.start, KINDS.index(s.kind)))
    parts, done, n = [], 0, 0
    for s in spans:
        if n and s.start < done:
            done = max(done, s.end)
            continue
        parts += [text[done : s.start], b"[" + s.kind.upper().encode() + b"]"]
        done, n = s.end, n + 1
    return (b"".join([*parts, text[done:]]) if n else text), n


def redact(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, count: str = "n_redacted") -> DataFrame:
    """``docs`` with personal data replaced by the name of its kind, and how many stretches were replaced.

    Null stays null. A column named like ``count`` is replaced.
    """

    def compute(batch: pa.RecordBatch) -> list:
        done = [mask(t, threshold) for t in texts(batch, text_col)]
        return [pa.array([t for t, _ in done], pa.binary()).cast(pa.string()), [n for _, n in done]]

    return add_columns(docs, compute, f"`{text_col}` string, `{count}` bigint").select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() != count.lower()], F.col(f"`{count}`")
    )
