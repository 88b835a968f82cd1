"""Personal data: patterns propose spans, checksums confirm, context words adjust the score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import array, column, map_rows

BASE_KINDS = ("email", "ip", "card", "phone")
SPANS = "spans array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# the look-behind only saves rescanning a run of digits: a start inside a run that
# failed at its head fails in the same way
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
# score without context, step for a context word within CONTEXT characters
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
CONTEXT, STEP, KEEP = 48, 0.25, 0.5
WORDS = {
    "email": {"email", "mail", "contact", "write"},
    "ip": {"ip", "host", "server", "address", "login"},
    "card": {"card", "visa", "credit", "debit", "karte", "tarjeta", "carte", "payment"},
    "phone": {"phone", "call", "tel", "telephone", "mobile", "fax", "telefon"},
    "iban": {"iban", "bank", "account", "konto", "transfer", "cuenta", "compte"},
    "ssn": {"ssn", "social", "security"},
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 check of an account number without spaces."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, by start, then kind; offsets are code points."""
    found: list[tuple[str, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = _local_start(text, done, at)
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
        # a later local part may begin anywhere behind this match or this sign
        done = domain.end() if domain else at + 1
        at = text.find("@", done)
    if re.search("[0-9]", text):
        found += [("ip", *m.span()) for m in IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def _local_start(text: str, low: int, at: int) -> int:
    while at > low and text[at - 1] in LOCAL:
        at -= 1
    return at


def more_spans(text: str) -> list[tuple[str, int, int]]:
    """Bank accounts that pass mod 97, and social security numbers."""
    found = []
    if not re.search("[0-9]{2}", text):
        return found
    for m in IBAN.finditer(text):
        end = m.end()
        while end - m.start() >= 15:  # a following word in capitals may have been taken along
            if mod97(text[m.start():end].replace(" ", "")):
                found.append(("iban", m.start(), end))
                break
            cut = text.rfind(" ", m.start(), end)
            if cut < 0:
                break
            end = cut
    found += [("ssn", *m.span()) for m in SSN.finditer(text)]
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - CONTEXT):start]} {text[end:end + CONTEXT]}".lower()
    hits = len(WORDS[kind] & set(re.findall(r"[a-z]+", near)))
    return min(1.0, PRIOR[kind] + STEP * min(hits, 2))


def all_spans(text: str) -> list[dict]:
    rows = [(k, s, e, True) for k, s, e in base_spans(text)]
    rows += [(k, s, e, False) for k, s, e in more_spans(text)]
    order = {k: i for i, k in enumerate(PRIOR)}
    out = []
    for k, s, e, base in sorted(rows, key=lambda r: (r[1], order[r[0]])):
        p = score(text, k, s, e)
        if base or p >= KEEP:
            out.append({"kind": k, "start": s, "end": e, "score": p, "base": base})
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and its spans with score, by start, then kind.

    Base spans (email, ip, card, phone) always stay; the method adds ``iban`` and
    ``ssn`` spans whose score reaches KEEP. Null and empty texts have no spans,
    repeated rows are scanned one by one, a null id stays null, an empty table gives
    an empty one; other columns are not read. All scans are linear in the text but for
    bounded patterns.
    """

    def scan(batch: pa.RecordBatch):
        yield {"id": array(batch, "id"), "spans": [all_spans(t) if t else [] for t in column(batch, "text")]}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, scan, f"id bigint, {SPANS}").withColumnRenamed("id", id_col)
