r"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts scores.

Kinds: email, ip, card, phone (found as the contract says) and iban, which only this operator adds.
A proposal that its validator refuses is dropped and not tried again from a later start. Spans are
code points, end exclusive. Defined results: a null or empty text has no spans and empty strings'
hash; very long texts are scanned in time linear in their length; a null id stays null; repeated
rows are each scanned; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import string

from pyspark.sql import DataFrame

from fonoteca.llm import common

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = 4
#: Score of a confirmed span, and what a context word within WINDOW characters adds. Fixed values.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.85}
BONUS, WINDOW = 0.1, 40
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "server", "host", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank", "transfer"),
}
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
# A look-behind keeps long runs of digits linear and changes no result: a match inside such a run
# would have begun at its first digit.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
DOUBLED = tuple(sum(divmod(2 * d, 10)) for d in range(10))
DIGIT_VALUES = {c: str(i) for i, c in enumerate(string.digits + string.ascii_uppercase)}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    """ISO 13616: the country and check digits to the end, letters as numbers, remainder one."""
    return int("".join(DIGIT_VALUES[c] for c in account[4:] + account[:4])) % 97 == 1


def only_digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Each domain with the longest run of local-part characters before it, back to the last match."""
    found, last = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, last := m.end()))
    return found


def ips(text: str) -> list[tuple[int, int]]:
    small = lambda part: len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255
    return [m.span() for m in IP.finditer(text) if all(map(small, m[0].split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CARD.finditer(text) if 14 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]


def ibans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IBAN.finditer(text) if 15 <= len(a := m[0].replace(" ", "")) <= 34 and mod97(a)]


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans}
#: A text without this character cannot hold the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    found = []
    for k, kind in enumerate(KINDS):
        if NEEDS.get(kind, "") in text:
            found += [(start, k, end) for start, end in FINDERS[kind](text)]
    return sorted(found)


def score_of(text: str, start: int, kind: str, end: int) -> float:
    near = (text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]).lower()
    return round(min(1.0, SCORES[kind] + BONUS * sum(word in near for word in CONTEXT[kind])), 4)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans array<struct<kind, start, end, score>> of every row."""

    def make():
        def of(texts: list[bytes]) -> list[list]:
            out = []
            for raw in texts:
                text = raw.decode("utf-8", "replace")
                out.append([(KINDS[k], s, e, score_of(text, s, KINDS[k], e)) for s, k, e in spans_of(text)])
            return [[[dict(zip(("kind", "start", "end", "score"), x)) for x in row] for row in out]]

        return of

    return common.map_texts(docs, text_col, [id_col], "spans array<struct<kind:string,start:long,end:long,score:double>>", make)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and hashes a row: n_<base kind>, base_sha256, spans, and each span's score, in span order."""

    def make():
        def of(texts: list[bytes]) -> list[list]:
            columns: list[list] = [[] for _ in range(BASE + 3)]
            for raw in texts:
                text = raw.decode("utf-8", "replace")
                spans = spans_of(text)
                for k in range(BASE):
                    columns[k].append(sum(x[1] == k for x in spans))
                columns[BASE].append(hashlib.sha256(joined([x for x in spans if x[1] < BASE]).encode()).hexdigest())
                columns[BASE + 1].append(joined(spans))
                columns[BASE + 2].append(",".join(f"{score_of(text, s, KINDS[k], e):.2f}" for s, k, e in spans))
            return columns

        return of

    counts = ", ".join(f"n_{kind} long" for kind in KINDS[:BASE])
    return common.map_texts(docs, text_col, [id_col], f"{counts}, base_sha256 string, spans string, scores string", make)
