"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

One pass over the rows, no shuffle. Every pattern is searched in time linear in the text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of kinds at one start; the first four are always reported, the others on their score.
KINDS = ("email", "ip", "card", "phone", "iban", "local_phone", "secret")
BASE_KINDS = KINDS[:4]

SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20-][0-9]{3}-[0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")
#: Beginnings that issuers of keys use.
_ISSUED = re.compile(r"(?:sk|pk|rk)[-_](?:live|test|proj)?|gh[oprsu]_|xox[abprs]-|AKIA|ASIA|AIza|glpat-|eyJ")
#: Least entropy of a secret's characters, in bits.
LEAST_BITS = 3.0

#: Score of a confirmed span before its context is read.
START = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "local_phone": 0.4, "secret": 0.35}
#: Words that raise a kind's score when one stands shortly before the span.
CONTEXT = {
    "email": frozenset("email mail e-mail contact address write".split()),
    "ip": frozenset("ip address host server client from".split()),
    "card": frozenset("card visa mastercard amex credit debit payment".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell".split()),
    "iban": frozenset("iban account bank transfer konto cuenta compte".split()),
    "local_phone": frozenset("phone tel telephone call mobile fax cell".split()),
    "secret": frozenset("token key apikey api-key secret password passwd pwd bearer credential authorization auth".split()),
}
#: Words that lower it: what follows is likelier an identifier of something else.
AGAINST = frozenset("version order invoice serial build isbn ref".split())
CONTEXT_CHARS = 40
LEAST_SCORE = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """Spans that pass mod 97; words of capitals behind a number are not part of it."""
    found = []
    for m in _IBAN.finditer(text):
        number = m.group()
        while len(number.replace(" ", "")) >= 12:
            if mod97(number.replace(" ", "")):
                found.append((m.start(), m.start() + len(number)))
                break
            number = number.rpartition(" ")[0]
    return found


def secrets(text: str) -> list[tuple[int, int, float]]:
    """Long runs of letters and digits as random as a key, with what a known beginning adds to the score."""
    found = []
    for m in _SECRET.finditer(text):
        run = m.group()
        if re.search("[0-9]", run) and re.search("[A-Za-z]", run):
            bits = -sum(c / len(run) * math.log2(c / len(run)) for c in Counter(run).values())
            if bits >= LEAST_BITS:
                found.append((m.start(), m.end(), 0.3 if _ISSUED.match(run) else 0.0))
    return found


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses. Each holds one @, so the search goes from @ to @."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _score(text: str, kind: str, start: int) -> float:
    words = set(re.findall(r"[a-z-]+", text[max(0, start - CONTEXT_CHARS):start].lower()))
    return START[kind] + 0.2 * bool(words & CONTEXT[kind]) - 0.3 * bool(words & AGAINST)


def find_spans(text: str) -> list[dict]:
    """All spans of a text by start, then kind. Offsets are code points, ends exclusive."""
    out = []
    if "@" in text:
        out += [("email", s, e) for s, e in emails(text)]
    if _DOTTED.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    spans = [{"kind": k, "start": s, "end": e, "score": _score(text, k, s)} for k, s, e in out]
    taken = sorted((s, e) for _, s, e in out)
    starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    more = [("iban", s, e, 0.0) for s, e in ibans(text)]
    more += [("local_phone", *m.span(), 0.0) for m in _LOCAL_PHONE.finditer(text)]
    more += [("secret", *x) for x in secrets(text)]
    free = 0
    for k, s, e, gain in sorted(more, key=lambda x: (x[1], KINDS.index(x[0]))):
        before = bisect_left(starts, e)  # reported spans that start before this one ends
        if s >= free and not (before and ends[before - 1] > s) and (score := _score(text, k, s) + gain) >= LEAST_SCORE:
            spans.append({"kind": k, "start": s, "end": e, "score": score})
            free = e
    return sorted(spans, key=lambda x: (x["start"], KINDS.index(x["kind"])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and spans, an array of (kind, start, end, score).

    Confirmed e-mail addresses, IPv4 addresses, payment cards and international phone numbers are
    always reported; IBANs (mod 97), local phone numbers, and keys or tokens (long random runs) where the
    score with its context reaches LEAST_SCORE and nothing reported overlaps; of two such spans the first. Null and empty texts give an empty array. Repeated
    rows and null ids come back as they are. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.sparkSession.createDataFrame([], f"id {rows.schema['id'].dataType.simpleString()}, spans {SPANS}").schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            found = [find_spans(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["id", "spans"])

    return rows.mapInArrow(scan, out).withColumnRenamed("id", id_col)
