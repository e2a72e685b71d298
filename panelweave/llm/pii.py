"""Personal data in texts: patterns propose, checksums confirm, words nearby move the score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, in the order in which kinds are listed. Runs are entered at their first
# character only, which changes no match and keeps very long runs linear.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ID_NUMBER = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
KINDS = ("email", "ip", "card", "phone", "iban", "id_number")
BASE = KINDS[:4]
# Words that make a kind more likely, and words that make any kind less likely, in
# English, German, French and Spanish.
CONTEXT = {
    "email": ("mail", "email", "contact", "write", "kontakt", "schreiben", "courriel", "contactez", "correo", "contacto", "escribe"),
    "ip": ("ip", "address", "host", "server", "login", "adresse", "rechner", "serveur", "hôte", "dirección", "servidor"),
    "card": ("card", "visa", "credit", "payment", "debit", "karte", "kreditkarte", "zahlung", "carte", "paiement", "tarjeta", "pago"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "handy", "anrufen", "téléphone", "appeler", "teléfono", "llamar", "móvil"),
    "iban": ("iban", "bank", "account", "transfer", "konto", "überweisung", "compte", "virement", "banque", "cuenta", "banco"),
    "id_number": ("ssn", "social", "security", "identity", "ausweis", "sozialversicherung", "sécurité", "identité", "seguridad", "identidad"),
}
DOUBT = (
    "example", "sample", "test", "version", "isbn", "order",
    "beispiel", "muster", "bestellung", "exemple", "essai", "commande", "ejemplo", "prueba", "pedido",
)
#: Score of a pattern alone, and what a passed checksum, a context word and a word of doubt change.
PRIOR, CONFIRMED, NEARBY, DOUBTFUL = 0.5, 0.4, 0.2, -0.2
#: Characters on either side that are looked at for words, and the score from which added kinds count.
REACH, LEAST = 40, 0.7
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = int(ch) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The checksum of bank account numbers: letters as 10 to 35, country and digits last."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(ch, 36)) for ch in turned)) % 97 == 1


def _digits(match: str) -> str:
    return "".join(ch for ch in match if "0" <= ch <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # the end of the match before
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        rest = EMAIL_DOMAIN.match(text, at) if start < at else None
        if rest:
            yield start, rest.end()
            free = rest.end()
        # What was passed over holds no other @, so nothing is walked twice.
        free = max(free, at + 1)
        at = text.find("@", free)


def proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Kind, start, end, and whether a checksum or a range confirmed it; failing matches are dropped."""
    for start, end in emails(text):
        yield "email", start, end, False
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            yield "ip", m.start(), m.end(), False
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            yield "card", m.start(), m.end(), True
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end(), False
    for m in IBAN.finditer(text):
        code = m[0].replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            yield "iban", m.start(), m.end(), True
    for m in ID_NUMBER.finditer(text):
        yield "id_number", m.start(), m.end(), False


def score(text: str, kind: str, start: int, end: int, confirmed: bool) -> float:
    around = f"{text[max(0, start - REACH) : start]} {text[end : end + REACH]}".lower()
    words = set(_WORD.findall(around))
    value = PRIOR + CONFIRMED * confirmed
    value += NEARBY * any(w in words for w in CONTEXT[kind])
    value += DOUBTFUL * any(w in words for w in DOUBT)
    return round(min(1.0, max(0.0, value)), 3)


def find(text: str) -> list[dict]:
    """Personal data of one text, by kind as listed, then start."""
    out = []
    for kind, start, end, confirmed in proposals(text):
        value = score(text, kind, start, end, confirmed)
        if kind in BASE or value >= LEAST:
            out.append({"kind": kind, "start": start, "end": end, "score": value})
    return out


_FOUND = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [find(t.as_py() or "") for t in batch["_text"]]
        yield pa.RecordBatch.from_arrays([batch["_doc"], pa.array(found, _FOUND)], ["_doc", "found"])


def pii_scan(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs`` with ``found``: kind, start, end (code points) and score.

    E-mail addresses, IP addresses, cards and phone numbers are kept whatever their score, which
    says how sure they are; bank accounts need their checksum, identity numbers a word nearby.
    Each kind's matches are leftmost and do not overlap. A missing or empty text has none; repeated
    rows are reported each; other columns are ignored; an empty table gives an empty result.
    """
    picked = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"))
    kind = picked.schema["_doc"].dataType.simpleString()
    found = "array<struct<kind: string, start: bigint, end: bigint, score: double>>"
    return picked.mapInArrow(_scan, f"_doc {kind}, found {found}").withColumnRenamed("_doc", doc)


def of_kind(found: Column, *kinds: str) -> Column:
    return F.filter(found, lambda r: r["kind"].isin(*kinds))
