"""Personal data under format-preserving pseudonyms.

Candidates are found by pattern and validated (check digits, calendar,
ranges). A valid value is ranked within the set of all values of its format,
the rank is permuted by a keyed Feistel network over exactly that set, and
the new value is written back with the same layout. Equal values of a kind
get equal pseudonyms in every document, and with the key they can be undone.

Kinds: email (the part before @), phone, card (Luhn), iban (mod 97), ssn,
ipv4, date (1900 to 2099), and secret (hexadecimal values of keys and tokens).
Defined cases: null texts stay null; values that fail validation stay as they
are; repeated rows are treated alike. Every text is searched whole.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_texts, slices, text_bytes

KINDS = ("email", "phone", "card", "iban", "ssn", "ipv4", "date", "secret")
ROUNDS = 8
SHARD_BYTES = 1 << 20
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY

PATTERN = re.compile(
    r"""(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}))
    |(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z]))
    |(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))
    |(?P<ipv4>(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9]))
    |(?P<date>(?<![0-9A-Za-z./-])(?:[0-9]{4}(?P<s1>[-/.])[0-9]{2}(?P=s1)[0-9]{2}|[0-9]{1,2}(?P<s2>[-/.])[0-9]{1,2}(?P=s2)[0-9]{4})(?![0-9A-Za-z]|[/.-][0-9]))
    |(?P<ssn>(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9]))
    |(?P<phone>(?<![0-9A-Za-z+])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}
        |\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}
        |(?:\([0-9]{3}\)[ ]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z]))
    |(?P<card>(?<![0-9A-Za-z-])(?:[0-9]{13,19}|[0-9]{4}(?P<s3>[ -])[0-9]{4}(?P=s3)[0-9]{4}(?P=s3)[0-9]{4}|[0-9]{4}(?P<s4>[ -])[0-9]{6}(?P=s4)[0-9]{5})(?![0-9A-Za-z]|-[0-9]))
    """, re.VERBOSE)


class Permutation:
    """A keyed permutation of 0 .. n - 1, by Feistel rounds and cycle walking."""

    def __init__(self, key: bytes, kind: str, n: int):
        self.n = n
        self.a = max(1, math.isqrt(n - 1) + 1)
        self.b = max(1, -(-n // self.a))
        self.key = hashlib.blake2b(f"{kind}:{n}".encode(), key=key[:64], digest_size=32).digest()

    def _round(self, k: int, half: int) -> int:
        raw = half.to_bytes((half.bit_length() + 7) // 8 or 1, "big")
        wide = hashlib.blake2b(bytes([k]) + raw, key=self.key, digest_size=64).digest()
        return int.from_bytes(wide, "big")

    def _once(self, x: int) -> int:
        a, b = self.a, self.b
        for k in range(ROUNDS):
            # The halves swap sizes each round, so both are always mixed.
            right, left = divmod(x, a)
            x = (left + self._round(k, right)) % a * b + right
            a, b = b, a
        return x

    def _back(self, x: int) -> int:
        a, b = (self.a, self.b) if ROUNDS % 2 == 0 else (self.b, self.a)
        for k in reversed(range(ROUNDS)):
            a, b = b, a
            left, right = divmod(x, b)
            x = right * a + (left - self._round(k, right)) % a
        return x

    def apply(self, x: int) -> int:
        y = self._once(x)
        while y >= self.n:
            y = self._once(y)
        return y

    def undo(self, y: int) -> int:
        x = self._back(y)
        while x >= self.n:
            x = self._back(x)
        return x


def luhn(digits: str) -> int:
    """The check digit for ``digits``."""
    total = sum(sum(divmod(int(d) * (2 if k % 2 == 0 else 1), 10)) for k, d in enumerate(reversed(digits)))
    return -total % 10


def _radix(text: str) -> list[tuple[str, str]]:
    sets = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return [(c, next((s for s in sets if c in s), c)) for c in text]


class Pseudonyms:
    """Pseudonyms under one key; ``undo`` turns them back."""

    def __init__(self, key: bytes, undo: bool = False):
        self.key, self.undo = key, undo
        self.made: dict[tuple[str, int], Permutation] = {}

    def _move(self, kind: str, n: int, x: int) -> int:
        p = self.made.get((kind, n))
        if p is None:
            p = self.made[kind, n] = Permutation(self.key, kind, n)
        return p.undo(x) if self.undo else p.apply(x)

    def _mixed(self, kind: str, text: str) -> str:
        """Each letter and digit within its own alphabet, together as one number."""
        parts, x, n = _radix(text), 0, 1
        for c, s in parts:
            x, n = x * len(s) + s.index(c), n * len(s)
        # Layouts of equal size must not share a permutation by accident.
        y = self._move(f"{kind}:{','.join(str(len(s)) for _, s in parts)}", n, x)
        out = []
        for _, s in reversed(parts):
            y, k = divmod(y, len(s))
            out.append(s[k])
        return "".join(reversed(out))

    def _digits(self, text: str, fresh: str) -> str:
        it = iter(fresh)
        return "".join(next(it) if c.isdigit() else c for c in text)

    def email(self, v: str) -> str | None:
        return self._mixed("email", v)

    def secret(self, v: str) -> str | None:
        if not re.search("[0-9]", v) or not re.search("[A-Fa-f]", v):
            return None
        y = self._move("secret", 16 ** len(v), int(v, 16))
        out = f"{y:0{len(v)}x}"
        return out.upper() if v.upper() == v else out

    def phone(self, v: str) -> str | None:
        d = re.sub(r"\D", "", v)
        if not (8 <= len(d) <= 15):
            return None
        head = 1 if v.startswith("+") else 0
        n = len(d) - head
        fresh = d[:head] + f"{self._move('phone', 10**n, int(d[head:])):0{n}d}"
        return self._digits(v, fresh)

    def card(self, v: str) -> str | None:
        d = re.sub(r"\D", "", v)
        if luhn(d[:-1]) != int(d[-1]) or not d.strip("0"):
            return None
        n = len(d) - 1
        body = f"{self._move('card', 10**n, int(d[:-1])):0{n}d}"
        return self._digits(v, body + str(luhn(body)))

    def iban(self, v: str) -> str | None:
        s = v.replace(" ", "")

        def mod(x: str) -> int:
            return int("".join(str(int(c, 36)) for c in x)) % 97

        if not 15 <= len(s) <= 34 or mod(s[4:] + s[:4]) != 1:
            return None
        body = self._mixed(f"iban{s[:2]}", s[4:])
        fresh = iter(s[:2] + f"{98 - mod(body + s[:2] + '00'):02d}" + body)
        return "".join(c if c == " " else next(fresh) for c in v)

    def ssn(self, v: str) -> str | None:
        a, b, c = map(int, v.split("-"))
        if a in (0, 666) or a >= 900 or b == 0 or c == 0:
            return None
        x = ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1
        x, c = divmod(self._move("ssn", 898 * 99 * 9999, x), 9999)
        a, b = divmod(x, 99)
        a += 1
        return f"{a + (a >= 666):03d}-{b + 1:02d}-{c + 1:04d}"

    def ipv4(self, v: str) -> str | None:
        parts = [int(x) for x in v.split(".")]
        if max(parts) > 255:
            return None
        y = self._move("ipv4", 2**32, int.from_bytes(bytes(parts), "big"))
        return ".".join(str(x) for x in y.to_bytes(4, "big"))

    def date(self, v: str) -> str | None:
        parts = re.split(r"[-/.]", v)
        year_first = len(parts[0]) == 4
        orders = ((0, 1, 2),) if year_first else ((2, 1, 0), (2, 0, 1))
        for order in orders:  # day before month, where both would do
            try:
                day = datetime.date(*(int(parts[k]) for k in order)).toordinal() - _FIRST_DAY
            except ValueError:
                continue
            if not 0 <= day < _DAYS:
                return None
            new = datetime.date.fromordinal(self._move(f"date{order}", _DAYS, day) + _FIRST_DAY)
            fresh = dict(zip(order, (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"), strict=True))
            seps = [c for c in v if not c.isdigit()]
            return fresh[0] + seps[0] + fresh[1] + seps[1] + fresh[2]
        return None

    def rewrite(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with every valid value replaced, and how many of each kind."""
        seen: dict[str, int] = {}

        def swap(m: re.Match) -> str:
            kind = next(k for k in KINDS if m[k] is not None)
            new = getattr(self, kind)(m[kind])
            if new is None:
                return m[0]
            seen[kind] = seen.get(kind, 0) + 1
            return new

        return PATTERN.sub(swap, text), seen


ADDED = T.StructType([T.StructField("text", T.StringType()), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS]])


def _replacer(key: bytes, undo: bool) -> Callable[[pa.Array], list]:
    def replace(texts: pa.Array) -> list:
        names = Pseudonyms(key, undo)
        data, offsets = text_bytes(texts)
        # Only texts with a digit or an @ can hold anything.
        rows = []
        for i, j in slices(offsets, SHARD_BYTES):
            part = data[offsets[i] : offsets[j]]
            at = np.flatnonzero(((part >= 48) & (part <= 57)) | (part == 64)) + offsets[i]
            rows += np.unique(np.searchsorted(offsets, at, "right") - 1).tolist()
        mask, fresh = np.zeros(len(texts), bool), []
        counts = {k: np.zeros(len(texts), np.int64) for k in KINDS}
        for i in rows:
            new, seen = names.rewrite(data[offsets[i] : offsets[i + 1]].tobytes().decode())
            if seen:
                mask[i] = True
                fresh.append(new)
                for k, n in seen.items():
                    counts[k][i] = n
        out = pc.replace_with_mask(texts, pa.array(mask), pa.array(fresh, texts.type)) if fresh else texts
        return [out, *[pa.array(counts[k]) for k in KINDS]]

    return replace


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", keep: list[str] | None = None, undo: bool = False) -> DataFrame:
    """``_row`` with the kept columns, ``_new`` with the text and counts."""
    return map_texts(docs, [text], docs.columns if keep is None else keep, _replacer(key, undo), ADDED)


def replaced(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with the text under pseudonyms; columns and order unchanged."""
    rest = [c for c in docs.columns if c != text]
    out = pseudonymise(docs, key, text, rest)
    return out.select(*[F.col("_new.text").alias(text) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
