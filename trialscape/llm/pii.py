"""Personal data by anchor expansion: an automaton finds cues, local parsers find the boundaries."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from trialscape.llm.arrays import add_columns

# Characters and shapes of the base kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "iban", "account")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DIGITS = "0123456789"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"://([^\s/?#@:]+:[^\s/?#@]+)@")
IBAN = re.compile(r"[\x20:#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})\b")
ACCOUNT = re.compile(r"(?i:\x20(?:number|no\.?|nr\.?))?[\x20:#]{1,3}([0-9](?:-?[0-9]){5,16})(?![0-9-])")
CUES = {"@": "email", "+": "phone", "://": "login"}
CUES |= dict.fromkeys(DIGITS, "card") | {f"{d}.": "ip" for d in DIGITS}
CUES |= dict.fromkeys(("iban", "Iban", "IBAN"), "iban")
CUES |= dict.fromkeys(("account", "Account", "ACCOUNT", "acct", "Acct", "ACCT"), "account")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def iban_holds(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int | None:
    """Where the longest reading of ``text[start:end]``, cut at a space or at its end, whose check digits hold stops."""
    while end > start and len(text[start:end].replace(" ", "")) >= 15:
        if iban_holds(text[start:end]):
            return end
        end = text.rfind(" ", start, end)
    return None


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for cue, kind in CUES.items():
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def spans_of(text: str, cues: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the valid finds, by kind and start. What a kind has matched,
    valid or not, is not looked at again for that kind."""
    done = dict.fromkeys(KINDS, 0)
    found = []
    for last, (kind, size) in cues.iter(text):
        at, low = last - size + 1, done[kind]
        if at < low:
            continue
        if kind == "card":
            if (m := CARD.match(text, at)) is None:
                continue
            start, end = m.span()
            digits = m[0].replace(" ", "").replace("-", "")
            valid = 16 <= len(digits) <= 19 and luhn(digits)
        elif kind == "email":
            start = at
            while start > low and text[start - 1] in LOCAL:
                start -= 1
            if start == at or (m := DOMAIN.match(text, at + 1)) is None:
                continue
            end, valid = m.end(), True
        elif kind == "ip":
            start = at
            while start > low and text[start - 1] in DIGITS:
                start -= 1
            if (m := ADDRESS.match(text, start)) is None:
                continue
            end = m.end()
            valid = all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))
        elif kind == "phone":
            if (m := PHONE.match(text, at)) is None:
                continue
            start, end = m.span()
            valid = 8 <= sum(c in DIGITS for c in m[0]) <= 15
        elif kind == "login":
            if (m := LOGIN.match(text, at)) is None:
                continue
            (start, end), valid = m.span(1), True
        elif kind == "iban":
            if (m := IBAN.match(text, last + 1)) is None:
                continue
            start, end = m.span(1)
            valid = (stop := iban_end(text, start, end)) is not None
            end = stop if valid else start  # a cue in what didn't hold is looked at
        else:
            if (m := ACCOUNT.match(text, last + 1)) is None:
                continue
            (start, end), valid = m.span(1), True
        done[kind] = end
        if valid:
            found.append((KINDS.index(kind), start, end))
    return sorted(found)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each find replaced by its kind in angle brackets; where finds overlap, the
    one that starts first (then the longer) names the whole stretch."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: (kind, start, end) in code points, by kind as in ``KINDS``, then start.

    Base kinds: email, ip (parts up to 255), card (16 to 19 digits, check digit holds), phone (8 to
    15 digits). Beyond them: user and password in an address (login), account numbers after a
    cue, and IBANs after a cue whose check digits hold; capitals and digits may follow an IBAN after a space.

    Null or empty text has no spans; repeated rows each get theirs; an empty table stays empty; an
    input column named ``spans`` is replaced. Whole texts are read once, nothing is shuffled.
    """

    def fn(column: pa.Array) -> list[pa.Array]:
        cues, kinds, starts, ends, counts = automaton(), [], [], [], [0]
        for value in column:
            for kind, start, end in spans_of(value.as_py() or "", cues):
                kinds.append(KINDS[kind])
                starts.append(start)
                ends.append(end)
            counts.append(len(kinds))
        spans = pa.StructArray.from_arrays(
            [pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["kind", "start", "end"]
        )
        return [pa.ListArray.from_arrays(pa.array(counts, pa.int32()), spans)]

    return add_columns(docs, text, "spans array<struct<kind:string,start:bigint,end:bigint>>", fn)


def redact_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every find of ``find_personal_data`` replaced in ``text``; null stays null."""

    def fn(column: pa.Array) -> list[pa.Array]:
        cues = automaton()
        values = (v.as_py() for v in column)
        return [pa.array([v if v is None else redact(v, spans_of(v, cues)) for v in values], pa.string())]

    return add_columns(docs, text, f"`{text}` string", fn).select(*[f"`{c}`" for c in docs.columns])
