"""Format-preserving pseudonyms by a keyed Feistel network.

A value is found by its form, validated (check digits, ranges, calendar), read
as a whole number below the count of valid values of its kind, permuted by a
keyed Feistel network on that range (walking on until the result lies in the
range) and written back in the form it had.  So equal values get equal
pseudonyms in every document, a card number stays a valid card number, a date a
date, and punctuation stays where it was.

Kinds: e-mail, IBAN, payment card, social security number, phone, IPv4 address,
calendar date.  What fails its validation is left alone: 16 digits with a wrong
check digit, ``300.1.2.3``, ``2024-02-31``.

Defined results
- null text: null, counts 0; an empty text stays empty
- very long texts are worked on whole
- overlapping finds: the leftmost, then the first kind above
- repeated rows get a row each; an empty table gives an empty result
- other columns are kept; one named like a count column is replaced by it, if counts are asked for
"""

from __future__ import annotations

import datetime
import hashlib
import re
import string
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
ROUNDS = 8
LOWER, DIGITS = string.ascii_lowercase, string.digits

PATTERN = re.compile(
    r"""
    (?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9]))
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
  | (?P<card>(?<![A-Za-z0-9.+-])(?:[2-6][0-9]{12,18}|[2-6][0-9]{3}(?:[\x20-][0-9]{4}){2}[\x20-][0-9]{1,7}|3[47][0-9]{2}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![A-Za-z0-9]))
  | (?P<ssn>(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9]))
  | (?P<ip>(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[A-Za-z0-9]))
  | (?P<date>(?<![A-Za-z0-9/.-])(?:[0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4})(?![A-Za-z0-9]|[/.-][0-9]))
  | (?P<phone>(?<![A-Za-z0-9.+(])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]?[0-9]{2,4}){2,4}(?![A-Za-z0-9]|[.-][0-9]))
    """,
    re.VERBOSE | re.ASCII,
)


class Cipher:
    """A keyed permutation of the whole numbers below ``n``, one for each (kind, n)."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.permute = lru_cache(1 << 16)(self._permute)

    def _round(self, i: int, tweak: str, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        out, block = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(f"{tweak}|{i}|{half}|{block}".encode(), key=self.key, digest_size=min(64, size)).digest()
            block += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _once(self, x: int, tweak: str, bits: int) -> int:
        left, right = x >> bits, x & ((1 << bits) - 1)
        for i in range(ROUNDS):
            left, right = right, left ^ self._round(i, tweak, right, bits)
        return left << bits | right

    def _permute(self, x: int, n: int, kind: str) -> int:
        if n < 2:
            return x
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        tweak, y = f"{kind}|{n}", self._once(x, f"{kind}|{n}", bits)
        while y >= n:  # back into the range; the walk is a permutation too
            y = self._once(y, tweak, bits)
        return y


def _characters(cipher: Cipher, text: str, kind: str) -> str:
    """Letters and digits of ``text`` permuted together; case and all else stay."""
    x, n = 0, 1
    for c in text:
        alphabet = DIGITS if c in DIGITS else LOWER if c.lower() in LOWER else ""
        if alphabet:
            x, n = x * len(alphabet) + alphabet.index(c.lower()), n * len(alphabet)
    y, out = cipher.permute(x, n, kind), []
    for c in reversed(text):
        alphabet = DIGITS if c in DIGITS else LOWER if c.lower() in LOWER else ""
        if alphabet:
            y, d = divmod(y, len(alphabet))
            c = alphabet[d] if c == c.lower() else alphabet[d].upper()
        out.append(c)
    return "".join(reversed(out))


def _fill(form: str, digits: str) -> str:
    """The digits of ``form`` replaced, in order, by ``digits``."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in form)


def luhn(digits: str) -> int:
    """The check digit that belongs behind ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _email(cipher: Cipher, s: str) -> str | None:
    local, _, domain = s.partition("@")
    rest, _, top = domain.rpartition(".")
    moved = _characters(cipher, f"{local}@{rest}", "email")
    return f"{moved}.{top}"


def _iban(cipher: Cipher, s: str) -> str | None:
    plain = s.replace(" ", "")
    value = lambda t: int("".join(str(int(c, 36)) for c in t))
    if not 15 <= len(plain) <= 34 or value(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _characters(cipher, plain[4:], "iban" + plain[:2]).upper()
    new = iter(plain[:2] + f"{98 - value(body + plain[:2] + '00') % 97:02d}" + body)
    return "".join(next(new) if c != " " else c for c in s)


def _card(cipher: Cipher, s: str) -> str | None:
    d = re.sub(r"[^0-9]", "", s)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]):
        return None
    lead = 2 if d[0] == "3" else 1  # 34 and 37 decide how 15 digits are grouped
    n = len(d) - lead - 1
    body = d[:lead] + f"{cipher.permute(int(d[lead:-1]), 10**n, 'card' + d[:lead]):0{n}d}"
    return _fill(s, body + str(luhn(body)))


def _ssn(cipher: Cipher, s: str) -> str | None:
    area, group, serial = map(int, s.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    y, serial = divmod(cipher.permute(x, 898 * 99 * 9999, "ssn"), 9999)
    area, group = divmod(y, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(cipher: Cipher, s: str) -> str | None:
    d = re.sub(r"[^0-9]", "", s)
    if s[0] == "+":
        lead = len(re.match(r"\+([0-9]{1,3})", s)[1])
        lead = 1 if d[0] in "17" else min(lead, 2 if d[:2] in {"20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "81", "82", "86", "91"} else 3)
    elif m := re.fullmatch(r"(1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", s):
        lead = 1 if m[1] else 0
    else:
        return None
    rest = d[lead:]
    if not 7 <= len(d) <= 15 or len(rest) < 6:
        return None
    if d[:lead] in ("", "1") and len(rest) == 10 and rest[0] > "1" and rest[3] > "1":  # area and exchange start with 2 to 9
        x = (int(rest[0]) - 2) * 8 + int(rest[3]) - 2
        y, tail = divmod(cipher.permute(x * 10**8 + int(rest[1:3] + rest[4:]), 64 * 10**8, "phone1"), 10**8)
        t = f"{tail:08d}"
        new = str(y // 8 + 2) + t[:2] + str(y % 8 + 2) + t[2:]
    else:
        new = f"{cipher.permute(int(rest), 10 ** len(rest), 'phone' + d[:lead]):0{len(rest)}d}"
    return _fill(s, d[:lead] + new)


def _ip(cipher: Cipher, s: str) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts) or parts[0] == "0":
        return None
    x = int.from_bytes(bytes(map(int, parts)), "big")
    low = 1 << 24  # the first part is never 0
    return ".".join(map(str, (cipher.permute(x - low, (1 << 32) - low, "ip") + low).to_bytes(4, "big")))


FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY


def _date(cipher: Cipher, s: str) -> str | None:
    a, mark, b, mark2, c = re.match(r"([0-9]+)([-/.])([0-9]+)([-/.])([0-9]+)", s).groups()
    if mark != mark2:
        return None
    # year first; else month first with a slash where that is a date, else day first
    orders = ["ymd"] if len(a) == 4 else ["mdy", "dmy"] if mark == "/" else ["dmy", "mdy"]
    for order in orders:
        part = dict(zip(order, (a, b, c), strict=True))
        try:
            x = datetime.date(int(part["y"]), int(part["m"]), int(part["d"])).toordinal() - FIRST_DAY
        except ValueError:
            continue
        if not 0 <= x < DAYS:
            return None
        day = datetime.date.fromordinal(FIRST_DAY + cipher.permute(x, DAYS, "date"))
        new = {"y": day.year, "m": day.month, "d": day.day}
        return mark.join(f"{new[k]:0{len(part[k])}d}" for k in order)
    return None


#: Rows of one result batch, so that a worker holds few texts twice.
ROWS = 1000

WRITERS: dict[str, Callable[[Cipher, str], str | None]] = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date}
_NEEDED = re.compile(r"[0-9@]")


def rewrite(cipher: Cipher, text: str | None) -> tuple[str | None, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind."""
    counts: dict[str, int] = {}
    if not text or not _NEEDED.search(text):
        return text, counts

    out, at, last = [], 0, 0
    while m := PATTERN.search(text, at):
        new = WRITERS[m.lastgroup](cipher, m[0])
        if new is None:  # the form fits but the value is none: a later kind may start inside it
            at = m.start() + 1
            for kind in KINDS[KINDS.index(m.lastgroup) + 1 :]:
                other = _ALONE[kind].match(text, m.start())
                if other and (new := WRITERS[kind](cipher, other[0])) is not None:
                    m = other
                    break
            else:
                continue
        counts[m.lastgroup] = counts.get(m.lastgroup, 0) + 1
        out += [text[last : m.start()], new]
        at = last = m.end()
    return "".join([*out, text[last:]]), counts


_ALONE = {k: re.compile(next(x for x in PATTERN.pattern.split("\n  | ") if f"(?P<{k}>" in x), re.VERBOSE | re.ASCII) for k in KINDS}


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counted: bool = True) -> DataFrame:
    """``docs`` with the text rewritten and, if ``counted``, n_<kind> for each kind, n_private in all.

    One pass without a shuffle; the order of columns stays.  Without counts the
    columns are those of ``docs``, whatever their names.
    """
    counts = [f"n_{k}" for k in KINDS] + ["n_private"] if counted else []
    kept = [c for c in docs.columns if c not in counts]
    d = docs.select(*[F.col(f"`{c}`") for c in kept])
    at, secret = kept.index(text), key.encode()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cipher = Cipher(secret)
        for b in (big.iloc[at : at + ROWS] for big in batches for at in range(0, len(big), ROWS)):
            done = [rewrite(cipher, t) for t in b["text"]]
            yield pd.DataFrame({"text": [t for t, _ in done], **{f"n_{k}": [c.get(k, 0) for _, c in done] for k in KINDS}, "row": list(b["row"])})

    # only what Python needs crosses over by name; the rest travels as one struct
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept) if i != at], F.lit(0).alias("none"))
    sent = d.select(F.col(f"`{text}`").alias("text"), rest.alias("row"))
    kind = sent.schema["row"].dataType.simpleString()
    got = sent.mapInPandas(run, f"text string, {', '.join(f'n_{k} long' for k in KINDS)}, row {kind}")
    columns = [F.col("text").alias(c) if i == at else F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(kept)]
    if not counted:
        return got.select(*columns)
    return got.select(*columns, *[f"n_{k}" for k in KINDS], sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)).cast("long").alias("n_private"))
