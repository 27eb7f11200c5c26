"""Personal data in free text: found by form, replaced by typed placeholders with format-preserving pseudonyms."""

from __future__ import annotations

import functools
import hashlib
import hmac
import re
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "phone", "id_number", "address", "person")

# ---- names: known parts, and words composed of a head and a tail of known parts


class Names:
    """Given and family names: the known parts, and what shares both its head and its tail with known parts.

    A list of names is never complete. Each known part is cut at every place; a head counts if it is followed by
    several different tails in the list, a tail if it follows several heads. A word is a name of a kind if it is known
    as such, or if some cut of it gives a head and a tail that count for that kind.
    """

    def __init__(self, parts: list[tuple[str, str]], several: int = 2):
        self.known = {k: {p.lower() for p, kind in parts if p and kind == k} for k in ("given", "family")}
        self.heads, self.tails = {}, {}
        for kind, words in self.known.items():
            heads: dict[str, set] = {}
            tails: dict[str, set] = {}
            for w in words:
                for i in range(2, len(w) - 1):
                    heads.setdefault(w[:i], set()).add(w[i:])
                    tails.setdefault(w[i:], set()).add(w[:i])
            self.heads[kind] = {h for h, t in heads.items() if len(t) >= several}
            self.tails[kind] = {t for t, h in tails.items() if len(h) >= several}
        self._seen: dict[str, tuple[bool, bool]] = {}
        self._ends: dict[str, tuple[bool, bool]] = {}

    def kinds(self, word: str) -> tuple[bool, bool]:
        """(is a given name, is a family name)."""
        w = word.lower()
        got = self._seen.get(w)
        if got is None:
            got = tuple(w in self.known[k] or any(w[:i] in self.heads[k] and w[i:] in self.tails[k] for i in range(2, len(w) - 1)) for k in ("given", "family"))
            if len(self._seen) < 1_000_000:
                self._seen[w] = got
        return got


    def ends(self, word: str) -> tuple[bool, bool]:
        """(ends like a given name, ends like a family name): enough only beside a sure name of the other kind."""
        w = word.lower()
        got = self._ends.get(w)
        if got is None:
            got = tuple(any(w[-n:] in self.tails[k] for n in range(least, len(w) - 1)) for k, least in (("given", 3), ("family", 4)))
            if len(self._ends) < 1_000_000:
                self._ends[w] = got
        return got


# ---- patterns

_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]*"
_AT = r"(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?)"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)"
_HOST = rf"[A-Za-z][A-Za-z0-9\-]*(?:{_DOT}[A-Za-z][A-Za-z0-9\-]*)*?"
_END = r"(?![A-Za-z0-9\-]|:[A-Za-z0-9])"
_START = r"(?<![A-Za-z0-9._%+\-])"
EMAIL = re.compile(rf"{_START}{_LOCAL}{_AT}[A-Za-z][A-Za-z0-9\-]*(?:{_DOT}[A-Za-z][A-Za-z0-9\-]*)+{_END}", re.I)
#: "local at host dot tld", all in words
SPOKEN = re.compile(rf"{_START}{_LOCAL}\sat\s{_HOST}\sdot\s[A-Za-z]+(?:\sdot\s[A-Za-z]+)*{_END}", re.I)

_S = r"[\s.\-‐‑–]"
PHONE = re.compile(
    r"(?<![\w@/.,+#\-])(?:"
    rf"\+\d{{1,3}}(?:{_S}?\(?\d{{1,5}}\)?){{1,6}}"  # international
    rf"|00{_S}\d{{1,3}}(?:{_S}\d{{1,5}}){{2,5}}"
    rf"|\(\d{{3,5}}\)\s?\d{{3,5}}{_S}\d{{3,4}}"  # area in parentheses
    r"|\d{3}([.\-‐‑–])\d{3}\1\d{4}"  # 3-3-4
    rf"|0\d{{3}}(?:{_S}\d{{2}}){{3}}"  # 4-2-2-2
    rf"|0\d{{4}}{_S}?\d{{6}}"  # 5-6
    r")(?:\s?(?:x|ext\.?)\s?\d{1,5})?(?![\w]|[.\-/]\d)",
    re.I,
)

ID_NUMBER = re.compile(
    r"(?<![\w@/.,+#\-])(?:"
    r"[A-Z]{2}\d{2}(?:\s\d{4}){3,7}(?:\s\d{1,4})?"  # account number in groups
    r"|[A-Z]{2}\d{14,30}"  # account number
    r"|[A-Z]{2}(?:\s\d{2}){3}\s[A-Z]"  # two letters, six digits, a letter
    r"|[A-Z]{2}\d{6}[A-Z]"
    r"|\d{8}-[A-Z]"  # eight digits and a check letter
    r"|[A-Z]\d{8}"  # passport
    r"|\d{3}-\d{2}-\d{4}|\d{3}\s\d{2}\s\d{4}"  # 3-2-4
    r"|\d{2}/\d{3}/\d{5}"  # tax office / district / number
    r"|\d\s\d{2}\s\d{2}\s\d{2}\s\d{3}\s\d{3}(?:\s\d{2})?"  # 1-2-2-2-3-3
    r")(?![\w]|[.\-/]\d)",
    re.I,
)

_NAME = r"[^\W\d_][\w'’]*"
_WAY = r"(?:street|str|st|road|rd|lane|ln|avenue|ave|court|ct|drive|dr|way|close|square|sq|terrace|place|boulevard|blvd)\b\.?"
_UNIT = r"(?:apt|apartment|unit|suite|ste|flat|room|floor)\.?\s?#?\d+[a-z]?"
_TOWN = r"(?:,\s(?:\d{4,5}\s)?[^\W\d_][\w'’\-]{2,})"
ADDRESS = re.compile(
    r"(?<![\w@/.\-])(?:"
    rf"(?:{_UNIT},?\s)?\d{{1,5}}[a-z]?\s{_NAME}(?:\s{_NAME})?\s{_WAY}(?:,\s{_UNIT})?{_TOWN}?"
    rf"|(?:calle|avenida|plaza|paseo|via)\s{_NAME}(?:\s{_NAME})?,?\s\d{{1,5}}[a-z]?{_TOWN}?"
    rf"|\d{{1,5}}[a-z]?,?\s(?:rue|avenue|boulevard|place|chemin|impasse)\s{_NAME}(?:\s{_NAME})?{_TOWN}?"
    rf"|[^\W\d_]\w*(?:straße|strasse|weg|gasse|platz|allee|damm)\s\d{{1,5}}[a-z]?{_TOWN}?"
    rf"|(?:p\.?\s?o\.?\s?box|postfach|apartado|boîte\spostale)\s\d{{1,6}}{_TOWN}?"
    r")",
    re.I,
)
_WORDS = re.compile(r"[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]))*")


class Finder:
    """Finds items in a text: spans (start, end, kind) that don't overlap, in order."""

    def __init__(self, names: Names):
        self.names = names

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        found: list[tuple[int, int, str]] = []
        taken: list[tuple[int, int]] = []

        def add(start: int, end: int, kind: str) -> None:
            while start < end and not text[start].isalnum():
                start += 1
            if all(end <= s or start >= e for s, e in taken):
                taken.append((start, end))
                found.append((start, end, kind))

        low = text.lower()
        if "@" in text or "at]" in low or "at)" in low:
            for m in EMAIL.finditer(text):
                add(m.start(), m.end(), "email")
        if " dot " in low:
            for m in SPOKEN.finditer(text):
                add(m.start(), m.end(), "email")
        if any(c.isdigit() for c in text):
            for m in ID_NUMBER.finditer(text):
                add(m.start(), m.end(), "id_number")
            for m in PHONE.finditer(text):
                digits = sum(c.isdigit() for c in m.group())
                if 7 <= digits <= 20:
                    add(m.start(), m.end(), "phone")
            for m in ADDRESS.finditer(text):
                add(m.start(), m.end(), "address")
        for s, e in self._persons(text):
            add(s, e, "person")
        return sorted(found)

    def _persons(self, text: str):
        tokens = [(m.group(), m.start(), m.end()) for m in _WORDS.finditer(text)]
        kinds, ends = self.names.kinds, self.names.ends
        given = lambda x: kinds(x)[0] or ends(x)[0]
        i, n = 0, len(tokens)
        while i < n:
            w, s, e = tokens[i]
            sure = len(w) >= 4 and kinds(w)[1]
            if not sure:  # a word that ends like a family name, after a sure given name
                like = i > 0 and kinds(tokens[i - 1][0])[0] and len(w) >= 5 and ends(w)[1] and not kinds(w)[0] and text[tokens[i - 1][2] : s].isspace() and w[0].isupper() == tokens[i - 1][0][0].isupper()
                if not like:
                    i += 1
                    continue
            j = i  # a double family name
            while j + 1 < n and text[tokens[j][2] : tokens[j + 1][1]] == "-" and kinds(tokens[j + 1][0])[1]:
                j += 1
            end, start = tokens[j][2], None
            if i and not re.match(r"[\w@+]", text[end : end + 1] or " "):
                p, ps, pe = tokens[i - 1]
                gap = text[pe:s]
                if gap.isspace() and len(p) > 1 and given(p) and not kinds(p)[1] and not _inside(text, ps):
                    start = ps
                elif len(p) == 1 and (gap.strip() == "." or gap.isspace()) and not _inside(text, ps):
                    start = ps if "." in gap or p.isupper() and not re.search(r"\d\s$", text[max(0, ps - 2) : ps]) else None
                    if i > 1 and len(tokens[i - 2][0]) > 1 and given(tokens[i - 2][0]) and text[tokens[i - 2][2] : ps].isspace() and not _inside(text, tokens[i - 2][1]):
                        start = tokens[i - 2][1]
            if start is None and j + 1 < n and re.fullmatch(r",\s+", text[end : tokens[j + 1][1]]) and given(tokens[j + 1][0]) and not kinds(tokens[j + 1][0])[1] and not _inside(text, s) and not re.match(r"[\w@+.][\w@+]", text[tokens[j + 1][2] : tokens[j + 1][2] + 2]):
                start, end, j = s, tokens[j + 1][2], j + 1
                if j + 1 < n and len(tokens[j + 1][0]) == 1 and text[end : tokens[j + 1][1]].isspace() and text[tokens[j + 1][2] : tokens[j + 1][2] + 1] == ".":
                    end, j = tokens[j + 1][2], j + 1
            if start is not None:
                yield start, end
            i = j + 1


def _inside(text: str, at: int) -> bool:
    """True where a word goes on to the left: part of a name with dots, an address or a path."""
    return at > 0 and text[at - 1] in "@.+_/-\\" and at > 1 and text[at - 2].isalnum()


# ---- pseudonyms


def _halves(size: int) -> tuple[int, int]:
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    return half, (1 << half) - 1


def _round(key: bytes, size: int, r: int, right: int, tweak: bytes) -> int:
    return int.from_bytes(hmac.new(key, b"%d|%d|%d|" % (size, r, right) + tweak, hashlib.sha256).digest()[:16], "big")


def permute(value: int, size: int, key: bytes, tweak: bytes = b"", rounds: int = 8, back: bool = False) -> int:
    """A keyed permutation of 0..size-1, or its inverse: a balanced Feistel network over the next even power of two,
    walked in cycles."""
    half, mask = _halves(size)
    while True:
        left, right = value >> half, value & mask
        for r in range(rounds):
            if back:
                left, right = right ^ (_round(key, size, rounds - 1 - r, left, tweak) & mask), left
            else:
                left, right = right, left ^ (_round(key, size, r, right, tweak) & mask)
        value = left << half | right
        if value < size:
            return value


def _account_fits(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 and 2 <= int(s[2:4]) <= 98


#: Numbers with check digits, in capitals and without separators: pattern, letters that stay (a country), and the check.
CHECKED = [
    (re.compile(r"[A-Z]{2}\d{14,32}"), 2, _account_fits),  # account numbers: modulo 97 with the first four at the end
    (re.compile(r"\d{8}[A-Z]"), 0, lambda s: "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:8]) % 23] == s[8]),  # eight digits and a letter
    (re.compile(r"\d{15}"), 0, lambda s: 97 - int(s[:13]) % 97 == int(s[13:])),  # thirteen digits and two of check
]


def permuted(text: str, key: bytes, kind: str, back: bool = False) -> str:
    """A number in its format: digits become digits and letters letters, together permuted; everything else stays.

    A number with valid check digits becomes another valid one, one whose check digits fail another such (the permutation
    is walked on until it is of the same class), a country's letters stay. Letters keep their case at each place, which is
    not part of the value; letters of a phone number only mark its extension and stay.
    """
    compact = "".join(c for c in text.upper() if c.isascii() and c.isalnum())
    keep, fits = next(((k, f) for p, k, f in CHECKED if kind == "id_number" and p.fullmatch(compact)), (0, None))
    free = [i for i, c in enumerate(compact) if i >= keep and (c.isdigit() or kind != "phone")]
    if not free:
        return text
    tweak = f"{kind}|{compact[:keep]}|{''.join('9' if c.isdigit() else 'A' for c in compact)}".encode()
    bases = [10 if compact[i].isdigit() else 26 for i in free]
    value, size = 0, functools.reduce(int.__mul__, bases)
    for i, base in zip(free, bases):
        value = value * base + (int(compact[i]) if base == 10 else ord(compact[i]) - 65)

    def written(n: int) -> str:
        out = list(compact)
        for i, base in zip(reversed(free), reversed(bases)):
            n, k = divmod(n, base)
            out[i] = str(k) if base == 10 else chr(65 + k)
        return "".join(out)

    valid = fits is not None and fits(compact)
    while True:
        value = permute(value, size, key, tweak, back=back)
        new = written(value)
        if fits is None or fits(new) == valid:
            break
    chars = iter(new)
    return "".join((lambda x: x.lower() if c.islower() else x)(next(chars)) if c.isascii() and c.isalnum() else c for c in text)


#: Dates of these forms (and of the years 1900 to 2099) that stand alone, not as part of a time or a number.
DATE = re.compile(r"(?<![\w./:\-])(?:(\d{4})([-/.])(\d{2})\2(\d{2})|(\d{2})([-/.])(\d{2})\6(\d{4}))(?![\w/:\-]|\.\d|\s\d{1,2}:\d)")
_FIRST, _DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


def _day(m: re.Match) -> date | None:
    y, mo, d = (m[1], m[3], m[4]) if m[1] else (m[8], m[7], m[5])
    try:
        return date(int(y), int(mo), int(d)) if 1900 <= int(y) < 2100 else None
    except ValueError:
        return None


def permuted_date(text: str, key: bytes, back: bool = False) -> str:
    """A date as another date in the same form; equal days in different forms stay equal. No date: unchanged."""
    m = DATE.fullmatch(text)
    day = _day(m) if m else None
    if day is None:
        return text
    to = date.fromordinal(_FIRST + permute(day.toordinal() - _FIRST, _DAYS, key, b"date", back=back))
    return f"{to.year:04}{m[2]}{to.month:02}{m[2]}{to.day:02}" if m[1] else f"{to.day:02}{m[6]}{to.month:02}{m[6]}{to.year:04}"


def placeholder(kind: str, value: str, key: bytes) -> str:
    """<KIND:...>. Numbers are permuted within their format; other values get a keyed tag. Equal values stay equal,
    whatever their case, spacing or punctuation (numbers keep their own separators)."""
    if kind in ("phone", "id_number"):
        return f"<{kind.upper()}:{permuted(value, key, kind)}>"
    if kind == "date":
        return f"<DATE:{permuted_date(value, key)}>"
    plain = value.lower()
    if kind == "email":
        plain = re.sub(r"\s?[\[(]?\s?\bdot\b\s?[\])]?\s?", ".", re.sub(_AT, "@", plain, count=1))
    plain = re.sub(r"[\W_]+", " " if kind != "email" else ".", plain).strip()
    return f"<{kind.upper()}:{hmac.new(key, f'{kind}|{plain}'.encode(), hashlib.sha256).hexdigest()[:8]}>"


def redacted(text: str, spans: list[tuple[int, int, str]], key: bytes) -> str:
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], placeholder(kind, text[s:e], key)]
        at = e
    return "".join([*out, text[at:]])


def restored(text: str, key: bytes) -> str:
    """A redacted text with its numbers and dates as they were; other placeholders can't be undone and stay."""
    back = lambda m: permuted_date(m[2], key, True) if m[1] == "DATE" else permuted(m[2], key, m[1].lower(), True)
    return re.sub(r"<(PHONE|ID_NUMBER|DATE):([^<>]*)>", back, text)


def with_dates(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """spans and those of dates that stand outside of them."""
    more = [(m.start(), m.end(), "date") for m in DATE.finditer(text) if _day(m)]
    return sorted(spans + [x for x in more if all(x[1] <= s or x[0] >= e for s, e, _ in spans)])


# ---- over tables


def _scan(batches, parts, key: bytes | None, dates: bool = False):
    finder = Finder(Names(parts))
    for b in batches:
        rows, kinds, starts, ends, texts = [], [], [], [], []
        for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
            spans = finder.spans(t) if t else []
            if key is not None:
                if dates and t:
                    spans = with_dates(t, spans)
                texts.append(redacted(t, spans, key) if spans else t)
                rows.append(len(spans))
                continue
            for s, e, k in spans:
                rows.append(i), kinds.append(k), starts.append(s), ends.append(e)
        if key is not None:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(rows, pa.int32())], names=[*b.schema.names[:-1], "text", "n_items"])
        elif rows:
            ix = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(ix) for c in b.columns[:-1]], pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[*b.schema.names[:-1], "kind", "start_at", "end_at"])


class PersonalData:
    """Items of personal data in the text column of a table, with known name parts as (part, kind) rows.

    Every text is scanned whole, once, where it is; nothing is shuffled. The name parts go to every task, so they are
    collected up to ``most`` rows, and more is an error: parts of a larger list are better learnt as heads and tails.
    Null and blank texts have no items. Positions count characters of the text as given.
    """

    def __init__(self, names: DataFrame, part: str, kind: str, most: int = 100_000):
        rows = names.select(part, kind).where(F.col(part).isNotNull()).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError("more name parts than are sent to each task")
        self.parts = [(r[0].strip(), (r[1] or "").strip().lower()) for r in rows]

    def found(self, table: DataFrame, keys: list[str], text: str) -> DataFrame:
        """keys, kind, start_at, end_at: one row per item."""
        parts, t = self.parts, table.select(*keys, F.col(text).alias("__text"))
        kinds = ", ".join(f"`{n}` {k}" for n, k in t.dtypes[:-1])
        return t.mapInArrow(lambda it: _scan(it, parts, None), f"{kinds}, kind string, start_at int, end_at int")

    def redacted(self, table: DataFrame, keys: list[str], text: str, key: bytes, dates: bool = False) -> DataFrame:
        """keys, text, n_items: each text with placeholders in place of its items, and of dates that stand alone if
        wanted; texts without any unchanged. The secret key decides the pseudonyms; it is shipped to the tasks."""
        parts, t = self.parts, table.select(*keys, F.col(text).alias("__text"))
        kinds = ", ".join(f"`{n}` {k}" for n, k in t.dtypes[:-1])
        return t.mapInArrow(lambda it: _scan(it, parts, key, dates), f"{kinds}, text string, n_items int")
