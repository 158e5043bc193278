"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds are email, ip, card and phone; ``iban`` (mod-97) is added by the method.
All patterns are written so that a scan is linear in the text: no start inside a
run is tried again after the run has failed.

Defined cases: a null text is empty; a text without spans has zero counts, an
empty ``spans`` and the digest of the empty string; a null id is kept; repeated
rows give repeated results; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from .common import map_rows, session, spans_text, text_or_empty

KINDS = ("email", "ip", "card", "phone", "iban")
ORDER = {k: i for i, k in enumerate(KINDS)}
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
DIGIT = re.compile(r"[0-9]")
#: Words that raise or lower the score of a span when they stand within WINDOW characters before it.
NEAR = {
    "email": ("mail", "contact", "write", "e-mail"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("call", "phone", "tel", "mobile"),
    "iban": ("iban", "account", "bank"),
}
AGAINST = ("example", "sample", "dummy", "version", "test")
WINDOW, PRIOR, STEP = 40, {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}, 0.1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(text: str) -> bool:
    s = text.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    rest = 0
    for c in s[4:] + s[:4]:
        rest = (rest * 10 + ord(c) - 48) % 97 if c <= "9" else (rest * 100 + ord(c) - 55) % 97
    return rest == 1


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return out


def spans_of(text: str) -> list[tuple[int, int, str]]:
    out = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m.groups()):
                out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGIT.findall(m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    for m in IBAN.finditer(text):
        if mod97(m[0]):
            out.append((m.start(), m.end(), "iban"))
    return out


def span_score(text: str, start: int, kind: str) -> float:
    before = text[max(0, start - WINDOW) : start].lower()
    score = PRIOR[kind] + STEP * any(w in before for w in NEAR[kind]) - 3 * STEP * any(w in before for w in AGAINST)
    return min(1.0, max(0.0, round(score, 6)))


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts, digest of the base spans, all spans, their scores."""
    session(docs)

    def make():
        def step(columns):
            ids, texts = columns
            out = [[] for _ in range(8)]
            for i, text in zip(ids, texts, strict=True):
                spans = spans_of(text)
                base = [x for x in spans if x[2] != "iban"]
                row = [i, *(sum(k == x[2] for x in base) for k in KINDS[:4]), hashlib.sha256(spans_text(base, ORDER).encode()).hexdigest(), spans_text(spans, ORDER)]
                ranked = sorted(spans, key=lambda x: (x[0], ORDER[x[2]], x[1]))
                row.append([span_score(text, s, k) for s, _, k in ranked])
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            return out

        return step

    ddl = "doc_id long,n_email long,n_ip long,n_card long,n_phone long,base_sha256 string,spans string,scores array<double>"
    return map_rows(text_or_empty(docs.select(id_col, text_col), text_col), make, ddl)
