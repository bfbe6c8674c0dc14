"""Personal data: patterns propose spans, checksums confirm them, words nearby move their scores.

Method. Each kind has a pattern and a starting score. A validator (Luhn for cards, mod 97 and the country's length for
account numbers, ranges for addresses) rejects a span or adds to its score; words of its kind within 48 characters before
it add, words that speak against it subtract. The four base kinds stay whatever their score; every other span needs
THRESHOLD, and none of a kind overlaps another of that kind.

Added to the base: account numbers, social security numbers, secrets (assigned ones, keys of known form, private key
blocks), IPv6 addresses, phone numbers in national form, and cards in longer digit runs or with dots.

Offsets count code points, ends exclusive. A null text counts as empty and has no spans. Whole texts are searched; no
pattern backtracks over more than one run and spans are swept in order, so a text of any length takes time in proportion.
An input column named pii_spans or redacted is replaced.
"""

from __future__ import annotations

import ipaddress
import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_text_columns

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "secret", "ipv6")
KINDS = BASE + ADDED
THRESHOLD, NEAR = 0.6, 48

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
GROUP = re.compile(r"[0-9]+(?:-[0-9]+)*")
DOTTED = re.compile(r"(?<![0-9.])[0-9]{4}(?:\.[0-9]{4}){3}(?![0-9]|\.[0-9])")
NATIONAL = re.compile(r"(?<![0-9+(./-])(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[\x20.-])[2-9][0-9]{2}[\x20.-][0-9]{4}(?![0-9-]|\.[0-9])")
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{2,39}(?![0-9A-Za-z:]))[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
#: Lengths of account numbers by country.
LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Keys whose form alone gives them away.
KEY = re.compile(r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|xox[abprs]-[A-Za-z0-9-]{10,255}|sk-[A-Za-z0-9_-]{20,255}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9_-])")
#: What a text must hold for the patterns beside them to be tried at all.
DIGIT, STARTS = re.compile("[0-9]"), ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "AIza", "eyJ")
PRIVATE, CLOSE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----"), re.compile(r"-----END (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?i)(?<![a-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\x20?[=:]\x20?[\"']?([A-Za-z0-9+/_.=-]{16,})")

#: Starting scores, and the words that speak for and against a kind.
START = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.5, "ssn": 0.4, "secret": 0.5, "ipv6": 0.7}
FOR = {
    "email": "mail email contact write", "ip": "ip host server address login", "card": "card visa mastercard credit debit payment carte karte tarjeta",
    "phone": "phone tel call mobile fax", "iban": "iban account bank konto compte cuenta", "ssn": "ssn social security", "ipv6": "ip host server address", "secret": "secret token password key credential",
}
AGAINST = {"ip": "version release section", "card": "order invoice isbn tracking", "ssn": "part serial order invoice", "secret": "example placeholder sample"}
HINTS = {(k, s): re.compile(r"(?i)\b(?:" + "|".join(words.split()) + r")") for s, table in ((1, FOR), (-1, AGAINST)) for k, words in table.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return 15 <= len(account) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the base kinds, and the digit runs that failed as cards."""
    found, failed = [], []
    if "@" in text:
        last = 0
        for m in iter_domains(text):
            start = m[0]
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m[0]:
                found.append((start, "email", m[1]))
                last = m[1]
    if not DIGIT.search(text):
        return found, failed
    for m in IP.finditer(text):
        if all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in CARD.finditer(text):
        digits = digits_of(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), "card", m.end()))
        elif len(digits) > 19:
            failed.append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                found.append((m.start(), "phone", m.end()))
    return found, failed


def iter_domains(text: str):
    """Spans of '@domain' from left to right. A domain never holds '@', so none hides another."""
    at = 0
    while m := DOMAIN.search(text, at):
        yield m.start(), m.end()
        at = m.end()


def account_end(text: str, start: int) -> int | None:
    """Where the account number ends that starts here: as many letters and digits as its country's have, single blanks between them, and no further one after them."""
    need, at = LENGTHS.get(text[start : start + 2], 0), start
    while need and at < len(text):
        if text[at] == " " and at > start and text[at - 1] != " ":
            at += 1
        if not (at < len(text) and ("A" <= text[at] <= "Z" or "0" <= text[at] <= "9")):
            return None
        need, at = need - 1, at + 1
    return at if at > start and not need and not text[at : at + 1].isalnum() else None


def added_spans(text: str, failed: list[tuple[int, int]]) -> list[tuple[int, str, int, float]]:
    """(start, kind, end, score) of what is no base span."""
    out = []
    if ":" in text:
        for m in IPV6.finditer(text):
            try:
                ipaddress.IPv6Address(m.group())
            except ValueError:
                continue
            if max(map(len, m.group().split(":"))) >= 3 and m.group().count(":") > 1:
                out.append((m.start(), "ipv6", m.end(), START["ipv6"]))
    if "=" in text or ":" in text:
        for m in SECRET.finditer(text):
            s = m.group(1)
            out.append((m.start(1), "secret", m.end(1), START["secret"] + (0.4 if entropy(s) > 3 and any(c.isdigit() for c in s) else -0.2)))
    if any(s in text for s in STARTS):
        for m in KEY.finditer(text):
            out.append((m.start(), "secret", m.end(), START["secret"] + 0.4))
    if "-----BEGIN " in text:
        ends = [m.end() for m in CLOSE.finditer(text)]
        for m in PRIVATE.finditer(text):
            after = bisect_left(ends, m.end())
            out.append((m.start(), "secret", ends[after] if after < len(ends) else m.end(), START["secret"] + 0.5))
    if not DIGIT.search(text):
        return out
    for lo, hi in failed:  # several numbers in a row: each group by itself
        for m in GROUP.finditer(text, lo, hi):
            digits = digits_of(m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), "card", m.end(), START["card"] + 0.3))
    for m in DOTTED.finditer(text):
        if luhn(digits_of(m.group())):
            out.append((m.start(), "card", m.end(), START["card"] + 0.3))
    for m in NATIONAL.finditer(text):
        out.append((m.start(), "phone", m.end(), START["phone"]))
    for m in IBAN.finditer(text):
        if (end := account_end(text, m.start())) and mod97(text[m.start() : end].replace(" ", "")):
            out.append((m.start(), "iban", end, START["iban"] + 0.4))
    for m in SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            out.append((m.start(), "ssn", m.end(), START["ssn"] + 0.1))
    return out


def moved(score: float, kind: str, text: str, start: int) -> float:
    before = text[max(0, start - NEAR) : start]
    for sign, step in ((1, 0.2), (-1, -0.3)):
        if (hint := HINTS.get((kind, sign))) and hint.search(before):
            score += step
    return min(1.0, max(0.0, score))


def spans(text: str | None) -> list[dict]:
    """All spans of a text by start, then kind: kind, start, end, score and whether it is a base span."""
    if not text:
        return []
    base, failed = base_spans(text)
    out = [{"kind": k, "start": s, "end": e, "score": moved(START[k] + 0.3 * (k == "card"), k, text, s), "base": True} for s, k, e in base]
    held: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}  # base spans of a kind come in order and apart
    for s, k, e in base:
        held[k].append((s, e))
    last = dict.fromkeys(KINDS, 0)
    for s, k, e, score in sorted(added_spans(text, failed), key=lambda x: (x[0], -x[2])):
        before = bisect_left(held[k], (e, 0))  # base spans that start before e; only the last can reach s
        if s >= last[k] and not (before and held[k][before - 1][1] > s) and (score := moved(score, k, text, s)) >= THRESHOLD:
            out.append({"kind": k, "start": s, "end": e, "score": score, "base": False})
            last[k] = e
    return sorted(out, key=lambda x: (x["start"], KINDS.index(x["kind"]), x["end"]))


def redacted(text: str | None, found: list[dict]) -> str | None:
    """text with each span, or run of overlapping spans, replaced by its (first) kind in angle brackets."""
    if text is None or not found:
        return text
    parts, at, end = [], 0, -1
    for x in found:
        if x["start"] >= end:
            parts += [text[max(at, end) if end >= 0 else 0 : x["start"]], f"<{x['kind'].upper()}>"]
            at = x["start"]
        end = max(end, x["end"])
    return "".join(parts) + text[end:]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("base", T.BooleanType())])


def find(df: DataFrame, column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (its columns keep) with pii_spans, an array of (kind, start, end, score, base), and redacted, the text without them."""

    def work(texts: list) -> dict:
        found = [spans(t) for t in texts]
        return {"pii_spans": found, "redacted": [redacted(t, f) for t, f in zip(texts, found, strict=True)]}

    return with_text_columns(df, [T.StructField("pii_spans", T.ArrayType(SPAN)), T.StructField("redacted", T.StringType())], lambda: work, column, keep)
