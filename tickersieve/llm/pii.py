"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in each whole text: at-signs, plus signs, digits, URL schemes
and identifier cues. A local parser at each anchor expands to the boundaries of an email address, IP
address, payment card, phone number, URL, secret or account number and validates it. Null and empty
texts have no spans. Rows keep their order and number; repeated rows repeat their result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickersieve.llm.frames import batch, map_arrow

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "secret", "account")
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "ws://", "wss://")
SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "api key", "access_key", "private_key")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "ssn", "passport", "tax id")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'|]+")
_SECRET = re.compile(r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/=.-]{8,})")
_ACCOUNT = re.compile(r"(?:\s{0,3}(?:number|no\.?|nr\.?|id))?\s{0,3}[:=#]?\s{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){10,30}|[0-9](?:[ -]?[0-9]){5,29})", re.ASCII)


@cache
def _anchors() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for sign in ("@", "+", *sorted(_DIGITS)):
        out.add_word(sign, (sign if sign in "@+" else "digit", 1))
    for kind, cues in (("url", SCHEMES), ("secret", SECRET_CUES), ("account", ACCOUNT_CUES)):
        for cue in cues:
            for form in {cue, cue.capitalize(), cue.upper()}:
                out.add_word(form, (kind, len(form)))
    out.make_automaton()
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _iban(text: str) -> bool:
    text = text.replace(" ", "")
    return len(text) >= 15 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, place of the kind in KINDS, end) of all spans in order, in code points."""
    out: list[tuple[int, int, int]] = []
    ends = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in _anchors().iter(text):
        at = last - length + 1
        if kind == "digit":
            if at and text[at - 1] in _DIGITS:
                continue
            if at >= ends["ip"] and (m := _IP.match(text, at)):
                ends["ip"] = m.end()
                if all(map(_byte, m[0].split("."))):
                    out.append((at, 1, m.end()))
            if at >= ends["card"] and (m := _CARD.match(text, at)):
                ends["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((at, 2, m.end()))
        elif kind == "@":
            start = at
            while start > ends["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                ends["email"] = m.end()
                out.append((start, 0, m.end()))
        elif kind == "+":
            if at >= ends["phone"] and (m := _PHONE.match(text, at)):
                ends["phone"] = m.end()
                if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out.append((at, 3, m.end()))
        elif kind == "url":
            if at >= ends["url"] and (m := _URL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)]}"))
                if end > last + 1:
                    ends["url"] = end
                    out.append((at, 4, end))
        elif kind == "secret":
            if at >= ends["secret"] and (m := _SECRET.match(text, last + 1)) and any(c in _DIGITS for c in m[1]):
                ends["secret"] = m.end(1)
                out.append((m.start(1), 5, m.end(1)))
        elif at >= ends["account"] and not (at and text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, last + 1)):
            if not m[1][0].isalpha() or _iban(m[1]):
                ends["account"] = m.end(1)
                out.append((m.start(1), 6, m.end(1)))
    out.sort()
    return out


def _step(chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    counts: list[list[int]] = [[] for _ in BASE_KINDS]
    shas, spans = [], []
    for text in chunk.column("text").to_pylist():
        found = find(text or "")
        for k, column in enumerate(counts):
            column.append(sum(kind == k for _, kind, _ in found))
        base = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found if k < len(BASE_KINDS))
        shas.append(hashlib.sha256(base.encode()).hexdigest())
        spans.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found))
    named = {f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(BASE_KINDS, counts)}
    yield batch(doc_id=chunk.column("doc_id"), **named, base_sha256=pa.array(shas, pa.string()), spans=pa.array(spans, pa.string()))


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: counts per base kind, digest of the base spans, and all spans."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    columns = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return map_arrow(docs, _step, f"doc_id long, {columns}, base_sha256 string, spans string")
