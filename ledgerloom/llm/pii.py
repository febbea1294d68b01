"""Personal data by anchor expansion: an automaton finds anchors, small parsers expand and check each."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
DIGIT = frozenset("0123456789")
WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
PHONE = frozenset("0123456789 ().-")
STOPS = frozenset(" \t\n\x0b\x0c\r\"'<>()[]{}|\\^`")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
# fixed values: how web addresses begin, words that a secret follows, and prefixes of keys with their least and most signs
SCHEMES = ("http://", "https://", "ftp://")
HOSTS = ("www.",)
SECRETS = (
    "password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "accesskey",
    "secret_key", "secretkey", "private_key", "auth_key", "authkey", "credential", "credentials", "bearer",
)
KEYS = {
    "AKIA": (20, 20), "ASIA": (20, 20), "AIza": (39, 39), "ghp_": (40, 40), "gho_": (40, 40), "ghu_": (40, 40), "ghs_": (40, 40),
    "ghr_": (40, 80), "github_pat_": (40, 120), "glpat-": (26, 80), "xoxb-": (24, 120), "xoxp-": (24, 120), "xoxa-": (24, 120),
    "sk_live_": (24, 140), "rk_live_": (24, 140), "npm_": (40, 40), "hf_": (37, 37),
}
BLOCK = "-----BEGIN "  # of a private key
TOKEN = "eyJ"  # a signed token: three parts joined by dots
KEY_SIGNS = LOCAL - frozenset("%+.")
LEAST_SECRET = 6  # signs of a value
BARE = 16  # signs of a value after a word that nothing but a blank follows
Span = tuple[int, int]
Found = tuple[Span | None, int]  # the match, and where the next one may begin


def email(text: str, at: int, free: int) -> Found:
    """Around an at-sign: local part to the left as far as ``free``, labels joined by dots to the right."""
    start = at
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    end, labels = at + 1, 0
    while True:
        stop = end
        while stop < len(text) and text[stop] in LABEL:
            stop += 1
        if stop == end:
            end -= labels > 0  # the dot before a missing label is not part of it
            break
        labels, end = labels + 1, stop
        if end >= len(text) or text[end] != ".":
            break
        end += 1
    if start == at or labels < 2:
        return None, free
    return (start, end), end


def _digits(text: str, at: int) -> int:
    while at < len(text) and text[at] in DIGIT:
        at += 1
    return at


def ip(text: str, at: int, free: int) -> Found:
    """From the first digit of a number: four numbers joined by dots."""
    end = _digits(text, at)
    parts = [text[at:end]]
    while len(parts) < 4:
        stop = _digits(text, end + 1) if text[end : end + 1] == "." else end + 1
        if stop == end + 1:
            return None, free
        parts.append(text[end + 1 : stop])
        end = stop
    fits = all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts)
    return ((at, end) if fits else None), end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def card(text: str, at: int, free: int) -> Found:
    """From a digit: digits with at most one blank or hyphen between two of them."""
    end = at + 1
    while end < len(text):
        if text[end] in DIGIT:
            end += 1
        elif text[end] in " -" and end + 1 < len(text) and text[end + 1] in DIGIT:
            end += 2
        else:
            break
    if end == at + 1:
        return None, free
    digits = text[at:end].replace(" ", "").replace("-", "")
    return ((at, end) if 13 <= len(digits) <= 19 and luhn(digits) else None), end


def phone(text: str, at: int, free: int) -> Found:
    """From a plus sign: a digit, one or more of digits, blanks, brackets, dots and hyphens, a digit."""
    if text[at + 1 : at + 2] not in DIGIT:
        return None, free
    end = at + 2
    while end < len(text) and text[end] in PHONE:
        end += 1
    while end > at + 3 and text[end - 1] not in DIGIT:
        end -= 1
    if end <= at + 3 or text[end - 1] not in DIGIT:
        return None, free
    n = sum(c in DIGIT for c in text[at:end])
    return ((at, end) if 9 <= n <= 15 else None), end


def url(text: str, at: int, free: int) -> Found:
    """From a scheme or ``www.``: up to the next blank, quote or bracket, without closing punctuation."""
    if text[at : at + 4].lower() == "www.":
        if at and text[at - 1] in WORD or text[at + 4 : at + 5] not in LABEL - {"-"} or not text[at + 4 : at + 5]:
            return None, free
        first = end = at + 4
    else:
        first = end = text.index("://", at) + 3
    while end < len(text) and text[end] not in STOPS and not text[end].isspace():
        end += 1
    while end > first and text[end - 1] in ".,;:!?":
        end -= 1
    return ((at, end), end) if end > first else (None, free)


def account(text: str, at: int, free: int) -> Found:
    """From two capitals and two digits: an account number of 15 to 34 signs that passes modulo 97."""
    if at and text[at - 1] in WORD:
        return None, free
    end, signs = at, []
    while end < len(text) and len(signs) <= 34:
        if text[end] in UPPER:
            signs.append(text[end])
            end += 1
        elif text[end] == " " and text[end + 1 : end + 2] in UPPER and len(signs) % 4 == 0:
            end += 1
        else:
            break
    if not 15 <= len(signs) <= 34 or text[end : end + 1] in WORD and end < len(text):
        return None, free
    number = int("".join(str(int(c, 36)) for c in signs[4:] + signs[:4]))
    return ((at, end), end) if number % 97 == 1 else (None, free)


def _word(text: str, at: int) -> str | None:
    """The word at a place that a secret may follow; the longest of those that fit."""
    fits = [cue for cue in SECRETS if text[at : at + len(cue)].lower() == cue]
    return max(fits, key=len) if fits else None


def _blanks(text: str, at: int) -> int:
    while at < len(text) and text[at] in " \t":
        at += 1
    return at


def _value(text: str, at: int) -> tuple[int, int, bool]:
    """(start, end, quoted) of a value: what a pair of quotes holds, or all up to the next blank, quote or bracket."""
    quote = text[at : at + 1]
    if quote and quote in "\"'`":
        end = at + 1
        while end < len(text) and text[end] not in (quote, "\n"):
            end += 1
        if text[end : end + 1] == quote:
            return at + 1, end, True
        at += 1
    end = at
    while end < len(text) and text[end] not in STOPS and not text[end].isspace():
        end += 1
    while end > at and text[end - 1] in ".,;:!?":
        end -= 1
    return at, end, False


def _assigned(text: str, at: int, cue: str) -> int | None:
    """The end of the value that a cue's word is given by an equals sign or a colon, or that follows ``bearer``."""
    end = at + len(cue)
    if text[end : end + 1] and text[end] in WORD | {"_"}:
        return None  # another word
    sign = end
    while sign < len(text) and sign < end + 2 and text[sign] in "\"'`]":  # what closes a quoted name
        sign += 1
    sign = _blanks(text, sign)
    first = sign
    while sign < len(text) and text[sign] in "=:>" and sign - first < 2:
        sign += 1
    start, stop, quoted = _value(text, _blanks(text, sign))
    value = text[start:stop]
    digit, letter = any(c in DIGIT for c in value), any(c.isalpha() for c in value)
    if first == sign:  # no sign between
        return stop if cue == "bearer" and len(value) >= BARE and digit and letter else None
    tight = text[first] == "=" and start == end + 1
    if len(value) < LEAST_SECRET or not (tight or digit or (quoted and not any(c.isspace() for c in value))):
        return None
    return stop


def secret(text: str, at: int, free: int) -> Found:
    """A secret from its cue: the value that a word such as ``token`` is given, whatever blanks and quotes
    stand around it; a key by its prefix; a signed token; a block with a private key."""
    if text.startswith(BLOCK, at):
        line = text.find("PRIVATE KEY-----", at, at + 60)
        if line < 0:
            return None, free
        end = text.find("-----END ", line)
        stop = text.find("KEY-----", end) if end >= 0 else -1
        return ((at, stop + 8), stop + 8) if stop >= 0 else ((at, line + 16), line + 16)
    alone = not (at and text[at - 1] in WORD)
    if text.startswith(TOKEN, at):
        end, parts = at, 1
        while end < len(text) and (text[end] in KEY_SIGNS or text[end] == "."):
            parts += text[end] == "."
            end += 1
        return ((at, end), end) if alone and parts == 3 and end - at >= 40 and text[end - 1] != "." else (None, free)
    for prefix, (least, most) in KEYS.items():
        if text.startswith(prefix, at):
            end = at
            while end < len(text) and text[end] in KEY_SIGNS:
                end += 1
            return ((at, end), end) if alone and least <= end - at <= most else (None, free)
    cue = _word(text, at)
    end = _assigned(text, at, cue) if cue else None
    return ((at, end), end) if end is not None else (None, free)


PARSERS: dict[str, Callable[[str, int, int], Found]] = {
    "email": email, "ip": ip, "card": card, "phone": phone, "url": url, "account": account, "secret": secret,
}


def anchors() -> ahocorasick.Automaton:
    """The automaton of all cues: at-signs, plus signs, digits, schemes, identifier cues."""
    found = ahocorasick.Automaton()
    cues = {"@": ("email",), "+": ("phone",), **{d: ("ip", "card") for d in sorted(DIGIT)}}
    cues |= {s: ("url",) for scheme in (*SCHEMES, *HOSTS) for s in (scheme, scheme.upper())}
    cues |= {s: ("secret",) for cue in SECRETS for s in (cue, cue.upper(), cue.capitalize())}
    cues |= {s: ("secret",) for s in (*KEYS, BLOCK, TOKEN)}
    for cue, kinds in cues.items():
        found.add_word(cue, (len(cue), kinds))
    found.make_automaton()
    return found


def spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text, by kind and then start; ends are exclusive code points."""
    free = dict.fromkeys(KINDS, 0)
    out: dict[str, list[Span]] = {kind: [] for kind in KINDS}

    def expand(kind: str, at: int) -> None:
        if at >= free[kind]:
            match, free[kind] = PARSERS[kind](text, at, free[kind])
            if match:
                out[kind].append(match)

    number = -1  # end of the digits whose first one was an anchor already
    for last, (length, kinds) in automaton.iter(text):
        at = last - length + 1
        for kind in kinds:
            if kind != "ip":
                expand(kind, at)
            elif at > number:
                number = _digits(text, at) - 1
                expand("ip", at)
                if number > at >= 2 and text[at - 1] in UPPER and text[at - 2] in UPPER:
                    expand("account", at - 2)
    return [(kind, *span) for kind in KINDS for span in out[kind]]


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def find_personal_data(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's personal data: counts per base kind, a digest of the base spans, all spans, n_sensitive.

    Base kinds are email, ip, card and phone; the method adds url, account and secret. ``n_sensitive``
    counts the spans of all kinds but url. Per kind,
    spans are leftmost and do not overlap; a number, card or phone that matches but fails its
    check is dropped and not tried again from a later sign. A null text is empty. Repeated rows,
    rows without id and other columns change nothing; an empty table gives no rows. Each row is
    looked at alone: nothing is shuffled or gathered.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            counts: dict[str, list[int]] = {kind: [] for kind in BASE}
            digests, joined, sensitive = [], [], []
            for value in batch.column("text").to_pylist():
                found = spans(value, automaton)
                base = [s for s in found if s[0] in BASE]
                for kind, own in counts.items():
                    own.append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(found))
                sensitive.append(sum(s[0] != "url" for s in found))
            columns = {"doc_id": batch.column("doc_id")}
            columns |= {f"n_{kind}": pa.array(own, pa.int64()) for kind, own in counts.items()}
            columns |= {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(joined, pa.string())}
            columns["n_sensitive"] = pa.array(sensitive, pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    kind = df.schema[id].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_sensitive long"
    return df.select(df[id].alias("doc_id"), F.coalesce(df[text], F.lit("")).alias("text")).mapInArrow(look, schema)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span in ``text`` replaced by its kind in brackets; overlapping spans become one."""

    @F.pandas_udf("string")
    def masked(values: pd.Series) -> pd.Series:
        automaton = anchors()

        def mask(value: str | None) -> str | None:
            if value is None:
                return None
            parts, done = [], 0
            for kind, start, end in sorted(spans(value, automaton), key=lambda s: (s[1], -s[2])):
                if start >= done:
                    parts += [value[done:start], f"[{kind}]"]
                done = max(done, end)
            return "".join([*parts, value[done:]])

        return values.map(mask)

    return df.withColumn(text, masked(df[text]))
