"""Format-preserving pseudonyms for personal data.

Values that pass their format's own validation are replaced by the image of a keyed permutation of that format's values,
so a pseudonym has the format of the original, equal values have equal pseudonyms in every document, different values
have different ones, and the key holder can go back (``reveal``). The permutation is a balanced Feistel network over the
values' numbers, its round function a keyed BLAKE2b of (kind, round, half), with cycle walking to stay in the format.

Kinds: payment cards (13 to 19 digits, Luhn; the check digit is made anew), IBANs (mod 97, likewise), phone numbers (North
American ones, and others with + and a country code, which stays), US social security numbers, IPv4 and IPv6 addresses,
calendar dates (ISO and day or month first), e-mail addresses (letters and digits of the local part; the domain stays)
and hexadecimal tokens of 32 to 64 digits. A number that fails validation isn't personal data of that kind and stays.

Separators and everything around a value stay as they are. Writings of one card, phone or IBAN number are linked, as are
those of one date in any order, and local parts that differ in the case of A-Z only. Dates keep whether their day is over
12, so that an order which the original shows is still shown. Letters of other scripts are permuted among those of the
same kind in their block of 128 code points. A long local part is permuted in runs of ``RUN`` characters.

The key is that of ``spark.turnlake.pii.key`` where set, or the one given; the default is public and for tests only.

Defined cases: a null text stays null; an empty one empty; values inside longer runs of word characters aren't values; an
address without a letter or digit before the @ stays and isn't counted; repeated rows get the same result; an empty table
gives an empty result; all other columns of ``pseudonymized`` pass.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import ipaddress
import re
import string
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = b"replace this key in production"
ROUNDS = 8
DIGIT = re.compile(r"[0-9]")
EMAIL = re.compile(r"(?<![\w.%+-])([\w.%+-]+)(@(?:[^\W_][\w-]*\.)+[^\W\d_]{2,})(?![\w-])")
RUN = 64
VALUES = re.compile(
    r"(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<token>(?<!\w)(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,64}(?!\w))"
    r"|(?P<phone>(?:(?<!\w)\+1[ .-]?|(?<![\w+-]))(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w]|-[0-9]))"
    r"|(?P<card>(?<![\w.+-])(?:[0-9]{4}([ -])[0-9]{4}\5[0-9]{4}\5[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\6[0-9]{5}|[0-9]{13,19})(?!\w|[.-][0-9]))"
    r"|(?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!\w|-[0-9]))"
    r"|(?P<date>(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{2}\10[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\11[0-9]{4})(?!\w|[./-][0-9]))"
    r"|(?P<intl>(?<![\w+])\+[2-9](?:[ .-]?[0-9]|[ .-]?\([0-9]{1,4}\)){7,14}(?!\w|[.-][0-9]))"
    r"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,39}(?![\w:]|\.[0-9]))"
)
COUNTED_AS = {"intl": "phone", "ip6": "ip"}
# Country calling codes of one and two digits; all others have three.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
KINDS = ("email", "iban", "token", "phone", "card", "ip", "ssn", "date")
LATIN = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)


@functools.cache
def alphabet_of(c: str) -> str:
    """The characters that one may become: digits, a-z (case is put back), Latin-1 letters, or those of the same kind in a
    block of another script; itself where nothing else is."""
    if c in string.digits:
        return string.digits
    if c in string.ascii_letters:
        return string.ascii_lowercase
    if c in LATIN:
        return LATIN
    if not c.isalnum() or c.isascii():
        return c
    kind, block = unicodedata.category(c), ord(c) & ~127
    return "".join(x for x in map(chr, range(block, block + 128)) if unicodedata.category(x) == kind and x not in LATIN)


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Permutation:
    """A keyed permutation of range(n) for each kind and n."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = hashlib.blake2b(key, digest_size=32).digest(), back

    def _round(self, kind: str, i: int, half: int, bits: int) -> int:
        size, name, made = (bits + 7) // 8 + 8, f"{kind}/{bits}/{i}/{half}".encode(), b""
        while len(made) < size:  # one digest but for very wide halves
            made += hashlib.blake2b(name + b"/%d" % len(made) if made else name, key=self.key, digest_size=min(64, size - len(made))).digest()
        return int.from_bytes(made, "big") & ((1 << bits) - 1)

    def _network(self, kind: str, value: int, bits: int) -> int:
        left, right = value >> bits, value & ((1 << bits) - 1)
        if self.back:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ self._round(kind, i, left, bits), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ self._round(kind, i, right, bits)
        return (left << bits) | right

    def of(self, kind: str, value: int, n: int, fits: Callable[[int], bool] = lambda _: True) -> int:
        """The image of a value that fits among those of range(n) that fit."""
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            value = self._network(f"{kind}/{n}", value, bits)
            if value < n and fits(value):
                return value


def luhn_digit(payload: str) -> str:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def refilled(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if "0" <= c <= "9" else c for c in shape)


def by_class(p: Permutation, kind: str, text: str) -> str:
    """Each character permuted within its alphabet, those of a run as one number; others, and the case of A-Z, stay."""
    if len(text) > RUN:
        return "".join(by_class(p, f"{kind}/{i}" if i else kind, text[i : i + RUN]) for i in range(0, len(text), RUN))
    alphabets = [alphabet_of(c) for c in text]
    folded = [c.lower() if c.isascii() else c for c in text]
    n, value = 1, 0
    for c, a in zip(folded, alphabets, strict=True):
        if len(a) > 1:
            value, n = value * len(a) + a.index(c), n * len(a)
    if n == 1:
        return text
    shape = "".join(a[0] if len(a) > 1 else "-" for a in alphabets)
    value = p.of(f"{kind}/{shape}", value, n)
    out = []
    for c, a in zip(reversed(text), reversed(alphabets), strict=True):
        if len(a) > 1:
            value, at = divmod(value, len(a))
            c = a[at].upper() if c.isascii() and c.isupper() else a[at]
        out.append(c)
    return "".join(reversed(out))


def email(p: Permutation, local: str, domain: str) -> str | None:
    return by_class(p, "email", local) + domain if any(len(alphabet_of(c)) > 1 for c in local) else None


def card(p: Permutation, text: str) -> str | None:
    digits = re.sub("[ -]", "", text)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    odd = lambda v: len(set(f"{v:0{n}d}" + luhn_digit(f"{v:0{n}d}"))) > 1  # noqa: E731  not one digit all through
    payload = f"{p.of('card', int(digits[:-1]), 10**n, odd):0{n}d}"
    return refilled(text, payload + luhn_digit(payload))


def iban(p: Permutation, text: str) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = by_class(p, f"iban/{plain[:2]}", plain[4:])
    whole = plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body
    left = iter(whole)
    return "".join(c if c == " " else next(left) for c in text)


def phone(p: Permutation, text: str) -> str | None:
    prefix = "+1" if text.startswith("+1") else ""
    digits = re.sub("[^0-9]", "", text[len(prefix) :])
    real = lambda v: f"{v:010d}"[0] > "1" and f"{v:010d}"[3] > "1"
    good = real(int(digits))
    if not good and not prefix:
        return None
    made = p.of("phone", int(digits), 10**10, real if good else lambda v: not real(v))
    return prefix + refilled(text[len(prefix) :], f"{made:010d}")


def intl(p: Permutation, text: str) -> str | None:
    digits = re.sub("[^0-9]", "", text)
    code = digits[: 1 if digits[0] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3]
    rest = digits[len(code) :]
    if not 8 <= len(digits) <= 15:
        return None
    n, least = 10 ** len(rest), 10 ** (len(rest) - 1)
    made = p.of(f"phone/{code}", int(rest), n, (lambda v: v >= least) if rest[0] != "0" else (lambda v: v < least))
    return refilled(text, code + f"{made:0{len(rest)}d}")


def ip6(p: Permutation, text: str) -> str | None:
    try:
        value = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    if value >> 112 == 0:  # unspecified, loopback and the like
        return None
    made = ipaddress.IPv6Address(p.of("ip6", value, 1 << 128, lambda v: v >> 112 != 0))
    return made.exploded if len(text) == 39 else made.compressed


def ip(p: Permutation, text: str) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    value = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, p.of("ip", value, 1 << 32).to_bytes(4, "big")))


def ssn(p: Permutation, text: str) -> str | None:
    def real(v: int) -> bool:
        area, rest = divmod(v, 10**6)
        return area not in (0, 666) and area < 900 and rest // 10**4 > 0 and rest % 10**4 > 0

    value = int(text.replace("-", ""))
    return refilled(text, f"{p.of('ssn', value, 10**9, real):09d}") if real(value) else None


def date(p: Permutation, text: str) -> str | None:
    a, b, c = re.split("[-/.]", text)
    as_day = lambda y, m, d: datetime.date(int(y), int(m), int(d)).toordinal()
    orders = (("iso", a, b, c),) if len(a) == 4 else (("day", c, b, a), ("month", c, a, b))
    for order, y, m, d in orders:
        try:
            value = as_day(y, m, d)
        except ValueError:
            continue
        usual = FIRST_DAY <= value <= LAST_DAY
        low, high = (FIRST_DAY, LAST_DAY) if usual else (1, datetime.date.max.toordinal())
        late = datetime.date.fromordinal(value).day > 12
        # A year like the original's, and a day that leaves as open as it was which number is the month.
        fits = lambda v: (datetime.date.fromordinal(v + low).day > 12) == late and (usual or not FIRST_DAY <= v + low <= LAST_DAY)
        made = datetime.date.fromordinal(p.of(f"date/{usual}", value - low, high - low + 1, fits) + low)
        shown = {"iso": f"{made.year:04d}{made.month:02d}{made.day:02d}", "day": f"{made.day:02d}{made.month:02d}{made.year:04d}", "month": f"{made.month:02d}{made.day:02d}{made.year:04d}"}
        return refilled(text, shown[order])
    return None


def token(p: Permutation, text: str) -> str | None:
    n = len(text)
    mixed = lambda v: not (s := f"{v:0{n}x}").isdigit() and not s.isalpha()
    return f"{p.of('token', int(text, 16), 16**n, mixed):0{n}x}"


MAKERS = {"card": card, "iban": iban, "phone": phone, "ip": ip, "ssn": ssn, "date": date, "token": token, "intl": intl, "ip6": ip6}


class Pseudonyms:
    """Replaces values in texts and counts them by kind."""

    def __init__(self, key: bytes = KEY, back: bool = False, keep: int = 100_000):
        self.p, self.keep, self.made = Permutation(key, back), keep, {}

    def replaced(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        counts: dict[str, int] = {}
        if not text or not DIGIT.search(text) and "@" not in text and ":" not in text:
            return text, counts

        def once(kind: str, value: str, make: Callable[[], str | None]) -> str:
            if (kind, value) not in self.made:
                if len(self.made) > self.keep:
                    self.made.clear()
                self.made[kind, value] = make()
            image = self.made[kind, value]
            if image is None:
                return value
            kind = COUNTED_AS.get(kind, kind)
            counts[kind] = counts.get(kind, 0) + 1
            return image

        out, last = [], 0
        pieces: list[tuple[int, int, str]] = []
        if "@" in text:
            for m in EMAIL.finditer(text):
                pieces.append((m.start(1), m.end(), once("email", m[0], lambda m=m: email(self.p, m[1], m[2]))))
        for start, stop, image in [*pieces, (len(text), len(text), "")]:
            between = text[last:start]
            out.append(VALUES.sub(lambda m: once(m.lastgroup if m.lastgroup in MAKERS else next(k for k in MAKERS if m[k]), m[0], lambda: MAKERS[next(k for k in MAKERS if m[k])](self.p, m[0])), between) if DIGIT.search(between) or ":" in between else between)
            out.append(image)
            last = stop
        return "".join(out), counts


def key_of(docs: DataFrame, key: bytes | None) -> bytes:
    return key or (docs.sparkSession.conf.get("spark.turnlake.pii.key", None) or "").encode() or KEY


def pseudonymized(docs: DataFrame, text_col: str = "text", key: bytes | None = None, back: bool = False) -> DataFrame:
    """``docs`` with the values in its texts replaced; all other columns as they are."""
    key = key_of(docs, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Pseudonyms(key, back)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = pa.array([work.replaced(t)[0] for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def reveal(docs: DataFrame, text_col: str = "text", key: bytes | None = None) -> DataFrame:
    """The originals again, for the holder of the key."""
    return pseudonymized(docs, text_col, key, back=True)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes | None = None) -> DataFrame:
    """Per row: doc_id, text (with pseudonyms), n_values and how many of each kind."""
    key = key_of(docs, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Pseudonyms(key)
        for batch in batches:
            found = [work.replaced(t) for t in batch.column(1).to_pylist()]
            by_kind = [pa.array([c.get(k, 0) for _, c in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([sum(c.values()) for _, c in found], pa.int64()), *by_kind], names=["doc_id", "text", "n_values", *[f"n_{k}" for k in KINDS]])

    schema = "doc_id long, text string, n_values long, " + ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
