"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby move their scores."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import long_texts, slices, texts_of

#: Kinds that are found by pattern and checksum alone, then those that the method adds; spans are listed in this order.
BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "national_id")

_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
#: Letters and digits after an account number's first four: 30 at most, one more tells that it doesn't end there.
_OF_IBAN = re.compile(r"(?:\x20?[A-Z0-9]){0,31}")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile("[0-9]")

#: Length of an account number by country (fixed values of its registry).
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 "
    "IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 "
    "SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}

#: Characters looked at on either side of a span, what a word there adds to its score, and the words.
REACH, GAIN = 48, 0.3
CONTEXT = {
    kind: re.compile(rf"\b(?:{words})\b", re.I)
    for kind, words in {
        "email": r"e-?mail|mail|contact|write|reply|kontakt|schreiben|antworten|courriel|écri(?:re|vez)|répond(?:re|ez)|correo|contacto|escrib(?:a|ir)|responder",
        "ip": r"ip|host|address|server|adresse|rechner|serveur|hôte|dirección|servidor",
        "card": r"card|visa|credit|debit|payment|\w*karte|zahlung|carte|crédit|débit|paiement|tarjeta|crédito|débito|pago",
        "phone": r"phone|tel|call|mobile|fax|telefon\w*|handy|anruf\w*|téléphone|appel\w*|teléfono|llam\w+|móvil",
        "iban": r"iban|account|bank|transfer|konto\w*|überweisung|compte|banque|virement|cuenta|banco|transferencia",
        "national_id": r"ssn|social|security|identity|national|sozialversicherung\w*|ausweis\w*|sécurité|sociale|identité|nationale|seguridad|identidad|nacional",
    }.items()
}
#: Score before context, and the score from which a span of an added kind is kept.
PRIOR = {"email": 0.7, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "national_id": 0.3}
KEEP = 0.5


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others: every second digit from the right is doubled, nines cast out."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an account number, its first four characters moved to the end and letters read as 10 to 35, leaves 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: every one has just one @, so each @ is looked at once and its local part read backwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        if host := _HOST.match(text, at):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, host.end()
                done = host.end()
        at = text.find("@", max(at + 1, done))


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers that pass modulo 97: as long as their country says, whatever follows; of other countries, all that follows."""
    done = 0
    for m in _IBAN.finditer(text):
        if m.start() < done:
            continue
        end = _OF_IBAN.match(text, m.end()).end()
        if size := IBAN_LENGTHS.get(m[0][:2]):
            at, left = m.end(), size - 4
            while at < end and left:
                left -= text[at] != " "
                at += 1
            if left or text[at : at + 1].isalnum() and text[at : at + 1].isascii():
                continue
            end = at
        elif text[end : end + 1].isascii() and text[end : end + 1].isalpha():
            continue
        number = text[m.start() : end].replace(" ", "")  # of 35 characters where the run goes on: too long
        if 15 <= len(number) <= 34 and mod97(number):
            yield m.start(), end
            done = end


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all personal data in a whole text, by kind as listed, then start; end exclusive, in characters."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
        found += [("iban", s, e) for s, e in _accounts(text)]
        if "-" in text:
            found += [("national_id", m.start(), m.end()) for m in _NATIONAL.finditer(text)]
    scored = []
    for kind, s, e in found:
        near = CONTEXT[kind].search(text[max(0, s - REACH) : s]) or CONTEXT[kind].search(text[e : e + REACH])
        score = min(1.0, PRIOR[kind] + (GAIN if near else 0.0))
        if kind in BASE or score >= KEEP:
            scored.append((kind, s, e, round(score, 4)))
    return scored


def find_pii(docs: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, pii): all spans of each row's whole text, array<struct<kind, start, end, score>>, ordered by kind, then start.

    Base kinds are kept whatever their score; added kinds (account numbers that pass modulo 97, national numbers) from a
    score of KEEP on, which a national number reaches only with a word of its context nearby. Null and empty texts have
    none; a text is read once however long; repeated rows come back each; an empty table gives no rows; other columns
    are ignored. Nothing is shuffled.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("pii", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in spans(t)] for t in texts_of(batch, column)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, schema.field("pii").type)], schema=schema)

    return long_texts(docs).select("doc_id", column).mapInArrow(run, "doc_id long, pii array<struct<kind:string,start:long,end:long,score:double>>")


def listed(pii: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(pii, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, column: str = "text", mark: str = "[{}]") -> DataFrame:
    """docs with every span of personal data in `column` replaced by its kind in brackets; overlapping spans become one,
    named by the first. All columns and their order stay; null stays null. Nothing is shuffled."""
    at = docs.columns.index(column)

    def clean(text: str) -> str:
        found = sorted((s, -e, kind) for kind, s, e, _ in spans(text))
        if not found:
            return text
        parts, done = [], 0
        for s, e, kind in found:
            if s >= done:
                parts += [text[done:s], mark.format(kind.upper())]
                done = -e
            elif -e > done:
                done = -e
        return "".join([*parts, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            new = pa.array([None if t is None else clean(t) for t in batch.column(at).cast(pa.string()).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return long_texts(docs).mapInArrow(run, docs.schema)
