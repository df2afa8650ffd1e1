"""Personal data: regular expressions propose spans, validators confirm them, context adjusts scores.

Only texts with a digit of any script, an at sign or a secret's letters leave the JVM. Spans of all kinds are scored from 0
to 1; those that reach the threshold are kept, the best where they overlap, and replaced.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import column, spare, table

THRESHOLD, WINDOW = 0.5, 48
KINDS = ("email", "iban", "card", "ssn", "ip", "phone", "secret")
_DOMAIN = re.compile(r"@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
_LOCAL = re.compile(r"[\w.%+'-]{1,64}$")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])")
_LENGTHS = "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
#: IBANs by country: whole groups of four, then the rest of its length.
_IBAN_OF = {c[:2]: re.compile(rf"[A-Za-z]{{2}}\d{{2}}(?: ?[A-Za-z0-9]{{4}}){{{int(c[2:]) // 4 - 1}}}" + (rf" ?[A-Za-z0-9]{{{int(c[2:]) % 4}}}" if int(c[2:]) % 4 else "") + "(?![A-Za-z0-9])") for c in _LENGTHS.split()}
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}")
_CARD = re.compile(r"(?<![\d+-])(?<!\d\.)\d(?:[ -]?\d){12,18}")
#: Issuers' first digits, asked of cards that are part of a longer run of digits.
_ISSUER = re.compile(r"4|5|6|3[04-9]|2[2-7]")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_IP = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)")
_PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?)?(?<!\d)\(?\d{2,4}\)?[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)")
#: Numbers with a country code and no blanks.
_E164 = re.compile(r"(?<![\w+])\+[1-9]\d{7,14}(?!\d)")
_SECRET = re.compile(r"(?<![A-Za-z0-9_])(?:[0-9a-fA-F]{32,}|(?:sk|pk|ghp|xox[bp]|AKIA)[A-Za-z0-9_-]{16,})(?![A-Za-z0-9_])")
#: Keys that their prefix alone gives away; after sk and pk, which also begin words, with a digit.
_PREFIXED = re.compile(r"AKIA[A-Z0-9]{16}|ghp_|xox[bp]-|[sp]k[_-](?=.*\d)")
_LOCAL_PHONE = re.compile(r"\(?[2-9]\d\d\)?([ .-])\d{3}\1\d{4}")
#: Java pattern of what every match of the patterns above has.
_ANY = r"[\p{Nd}@]|[a-fA-F]{32}|(?:sk|pk|ghp|xox[bp]|AKIA)[A-Za-z_-]{16}"
_CONTEXT = {
    "email": r"mail|contact|write",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "card": r"card|visa|credit|mastercard|karte|carte|tarjeta",
    "ssn": r"ssn|social|security",
    "ip": r"\bip\b|address|host|server|login",
    "phone": r"phone|tel|call|mobil|fax|cell",
    "secret": r"token|secret|key|passw|auth|credential",
}
_CONTEXT = {k: re.compile(v, re.IGNORECASE) for k, v in _CONTEXT.items()}
_AGAINST = re.compile(r"version|isbn|doi|commit|checksum|sha\d|md5|section|release", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    moved = (text[4:] + text[:4]).upper()
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _ibans(text: str):
    """IBANs of their country's length, else as far as groups of four go."""
    reached = 0
    for start in _IBAN_START.finditer(text):
        if start.start() < reached:
            continue
        of = _IBAN_OF.get(start.group()[:2].upper())
        tries = [m for m in (of and of.match(text, start.start()), _IBAN.match(text, start.start())) if m]
        tries = [m for m in tries if 15 <= len(m.group().replace(" ", "")) <= 34]
        sound = next((m for m in tries if mod97(m.group().replace(" ", ""))), None)
        if sound:
            reached = sound.end()
            yield "iban", sound.start(), sound.end(), 0.9
        elif tries:
            yield "iban", tries[-1].start(), tries[-1].end(), 0.1


def _cards(text: str):
    """Cards of 13 to 19 digits, the longest with a sound check digit at each start."""
    at = tried = 0
    while m := _CARD.search(text, at):
        start = m.start()
        ends = [start + k + 1 for k, c in enumerate(m.group()) if c not in " -"]
        ends = [e for e in ends[12:] if not text[e : e + 1].isdecimal()][::-1]
        at = start + 1
        for end in ends:
            digits = re.sub(r"\D", "", text[start:end])
            whole = start >= tried and end == ends[0]
            if luhn(digits) and len(set(digits)) > 1 and (whole or _ISSUER.match(digits)):
                at = end
                yield "card", start, at, 0.7
                break
        else:
            if ends and start >= tried:
                yield "card", start, ends[0], 0.1
        tried = max(tried, m.end())


def _proposed(text: str):
    """(kind, start, end, score without context)."""
    at = text.find("@")
    while at >= 0:
        if (domain := _DOMAIN.match(text, at)) and (local := _LOCAL.search(text[max(0, at - 64) : at])):
            name = local.group().lstrip(".'-%+")
            if name:
                yield "email", at - len(name), domain.end(), 0.9
        at = text.find("@", at + 1)
    yield from _ibans(text)
    yield from _cards(text)
    for m in _SSN.finditer(text):
        a, b, c = m.group().split("-")
        yield "ssn", m.start(), m.end(), 0.1 if a in ("000", "666") or a[0] == "9" or b == "00" or c == "0000" else 0.6
    for m in _IP.finditer(text):
        parts = m.group().split(".")
        sound = all(int(p) < 256 and (p == "0" or p[0] != "0") for p in parts) and m.group() not in ("0.0.0.0", "127.0.0.1")
        yield "ip", m.start(), m.end(), 0.6 if sound else 0.1
    for m in _PHONE.finditer(text):
        digits, marks = re.sub(r"\D", "", m.group()), sum(map(m.group().count, "+()"))
        if 9 <= len(digits) <= 15:
            cut = len(re.findall(r"[ .()-]+", m.group()))
            yield "phone", m.start(), m.end(), 0.7 if m.group()[0] == "+" and cut else 0.55 if marks >= 2 or _LOCAL_PHONE.fullmatch(m.group()) else 0.4 if cut >= 2 else 0.2
    for m in _E164.finditer(text):
        yield "phone", m.start(), m.end(), 0.55 if m.end() - m.start() > 10 else 0.4
    for m in _SECRET.finditer(text):
        yield "secret", m.start(), m.end(), 0.7 if _PREFIXED.match(m.group()) else 0.45


def find_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """Confirmed spans in order: kind, start, end, score. Of overlapping ones the best-scored, longest, first."""
    found = []
    for kind, start, end, score in _proposed(text):
        near = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
        score += 0.2 * bool(_CONTEXT[kind].search(near)) - 0.2 * bool(_AGAINST.search(near) and kind not in ("email", "card", "iban"))
        if score >= threshold - 1e-9:
            found.append((kind, start, end, round(min(1.0, score), 2)))
    found.sort(key=lambda s: (-s[3], s[1] - s[2], s[1], KINDS.index(s[0])))
    kept: list[tuple[str, int, int, float]] = []
    edges: list[tuple[int, int]] = []
    import bisect

    for s in found:
        k = bisect.bisect_left(edges, (s[1], s[1]))
        if (k == len(edges) or edges[k][0] >= s[2]) and (k == 0 or edges[k - 1][1] <= s[1]):
            edges.insert(k, (s[1], s[2]))
            kept.append(s)
    return sorted(kept, key=lambda s: s[1])


def redacted(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    out, at = [], 0
    for kind, start, end, _ in spans:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join(out) + text[at:]


_FOUND = "text string, spans array<struct<kind:string,start:int,end:int,score:double>>"


def _finder(threshold: float):
    @F.pandas_udf(_FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        clean, spans = [], []
        for t in texts:
            s = find_spans(t, threshold) if t else []
            clean.append(redacted(t, s) if s else None)
            spans.append([dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in s])
        return pd.DataFrame({"text": clean, "spans": spans})

    return find.asNondeterministic()


def redact(docs: DataFrame, text_col: str = "text", spans_col: str | None = None, threshold: float = THRESHOLD, only_found: bool = False) -> DataFrame:
    """``docs`` with confirmed personal data and secrets replaced by their kinds, as in "<EMAIL>".

    spans_col: added column of the spans (kind, start and end in characters of the old text,
    score), in place of one of that name. only_found: only rows with a span. Null texts
    stay null with no spans, empty ones stay empty; texts of any length are searched whole.
    Repeated rows are treated alike. Other columns are kept. An empty table stays empty.
    spans_col must not be text_col.
    """
    if spans_col and spans_col.lower() == text_col.lower():
        raise ValueError("the spans need a column of their own")
    (made,) = spare(docs, "found")
    text = column(docs, text_col)
    # Null where no pattern can match, so that such texts aren't sent to Python.
    out = docs.withColumn(made, _finder(threshold)(F.when(text.rlike(_ANY), text)))
    if only_found:
        out = out.filter(F.size(F.col(made)["spans"]) > 0)
    clean = F.coalesce(F.col(made)["text"], column(out, text_col)).alias(text_col)
    columns = [clean if c == text_col else column(out, c) for c in docs.columns if not spans_col or c.lower() != spans_col.lower()]
    return out.select(*columns, *([F.col(made)["spans"].alias(spans_col)] if spans_col else []))


def op5_pii(spark, sf_dir):
    """All documents that hold personal data or secrets: the spans, and the text without them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return redact(docs, spans_col="spans", only_found=True)


QUERIES = {"op5_pii": op5_pii}
ORACLE: dict[str, str] = {}
