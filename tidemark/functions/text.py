"""Accent-insensitive text: normal form, length-preserving fold, marker search, redaction.

All are column expressions. The translation table is generated from the Unicode database, never
typed by hand.
"""

from __future__ import annotations

import os.path
import re
import unicodedata
from collections.abc import Collection, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _letters() -> tuple[dict[str, str], dict[str, str]]:
    """Characters of U+00AA to U+024F that fold to one character, and those that fold to more."""
    one, more = {}, {}
    for c in map(chr, range(0xAA, 0x250)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            one[c] = plain
        elif len(plain) > 1:
            more[c] = plain
    return one, more


_ONE, _MORE = _letters()
_ASCII = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _translate(col: Column, table: dict[str, str]) -> Column:
    return F.translate(col, "".join(table), "".join(table.values()))


def _ascii(col: Column) -> Column:
    """As many bytes as characters."""
    return F.octet_length(col) == F.length(col)


def fold(col: Column) -> Column:
    """Lower case without accents, of the same length as the input: an offset here is one there."""
    return let(col, lambda c: F.when(_ascii(c), F.lower(c)).otherwise(_translate(c, _ASCII | _ONE)))


def _unfolded(folded: Column) -> Column:
    """A fold that still holds letters beyond ASCII: those that fold to more than one, other scripts' capitals, marks."""
    many = folded
    for c, plain in _MORE.items():
        many = F.replace(many, F.lit(c), F.lit(plain))
    many = F.when(folded.rlike("[" + "".join(_MORE) + "]"), many).otherwise(folded)
    return F.regexp_replace(F.lower(many), r"\p{M}+", "")


def spaced(folded: Column) -> Column:
    """The normal form of a text from its fold. A fold of ASCII alone, as most are, needs no search for other letters."""
    out = let(folded, lambda f: F.when(_ascii(f), f).otherwise(_unfolded(f)))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def normalise(col: Column) -> Column:
    """Lower-case ASCII letters and digits, everything else one space, trimmed. Null stays null."""
    return spaced(fold(col))


def plain(text: str) -> str:
    """The normal form of a constant, on the driver."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    return " ".join(re.findall("[a-z0-9]+", bare))


def _any(normal: Column, markers: Collection[str]) -> Column:
    """Plain substring searches: far cheaper than one pattern of alternatives. A marker that holds another one needs none;
    those that begin alike are searched for where their beginning occurs."""
    alike: dict[str, list[str]] = {}
    for m in dict.fromkeys(markers):
        if not any(o != m and o in m for o in markers):
            alike.setdefault(m[:6], []).append(m)
    either = lambda ms: reduce(lambda x, y: x | y, [normal.contains(m) for m in ms])
    return reduce(lambda x, y: x | y, [normal.contains(os.path.commonprefix(ms)) & either(ms) if len(ms) > 1 else either(ms) for ms in alike.values()])


def has_any(normal: Column, markers: Collection[str]) -> Column:
    """Whether a normal form contains any marker as a substring."""
    return let(normal, lambda n: _any(n, markers))


def first_label(normal: Column, table: Iterable[tuple[str, tuple[str, ...]]], otherwise: str | None = None) -> Column:
    """The label of the first row, in order, whose markers occur."""

    def pick(n: Column) -> Column:
        out = F.lit(otherwise).cast("string")
        for label, markers in reversed(list(table)):
            out = F.when(_any(n, markers), F.lit(label)).otherwise(out)
        return out

    return let(normal, pick)


def all_labels(normal: Column, table: Iterable[tuple[str, tuple[str, ...]]]) -> Column:
    """Labels of all rows whose markers occur, in order, as an array."""
    return let(normal, lambda n: F.array_compact(F.array(*[F.when(_any(n, markers), F.lit(label)) for label, markers in table])))


def marker_pattern(marker: str) -> str:
    """A marker as a pattern over the fold: its words with anything but letters and digits between."""
    return "[^a-z0-9]+".join(re.escape(w) for w in marker.split())


def unfolded_pattern(word: str) -> str:
    """A pattern that occurs in every text whose fold holds the word, and seldom in others: letters with their accents of
    Latin-1, or anything of U+0100 to U+024F, as long lists of characters are slow to match."""
    forms = {p: "".join(c for c, x in (_ASCII | _ONE).items() if x == p and c < "\u0100") for p in word}
    return "".join(f"[{re.escape(p)}{forms[p]}\u0100-\u024f]" for p in word)


def locate(folded: Column, markers: Iterable[str]) -> Column:
    """1-based place of the first marker in list order that occurs in a fold; null if none does."""
    place = lambda f, m: let(F.regexp_instr(f, F.lit(marker_pattern(m))), lambda i: F.when(i > 0, i))
    return let(folded, lambda f: F.coalesce(*[place(f, m) for m in markers]))


def labelled(text: Column, markers: Iterable[str], window: int, folded: Column | None = None) -> Column:
    """The ``window`` characters from the first marker on; empty where there is none. ``folded``: the text's fold, if at hand."""
    at = locate(fold(text) if folded is None else folded, markers)
    return F.coalesce(F.substring(text, at, F.lit(window)), F.lit(""))


def one_line(col: Column) -> Column:
    """White space collapsed to single spaces, trimmed."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def tidy(col: Column, limit: int | None = 400_000) -> Column:
    """(text, truncated): line ends unified, blanks collapsed, at most one empty line, lines stripped;
    with ``limit`` None the whole text."""
    out = F.regexp_replace(F.coalesce(col, F.lit("")), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t\f\x0B ]+", " ")
    out = F.regexp_replace(out, r" *\n *", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.trim(F.regexp_replace(out, r"^\s+|\s+$", ""))
    if limit is None:
        return F.struct(out.alias("text"), F.lit(False).alias("truncated"))
    return F.struct(F.substring(out, 1, limit).alias("text"), (F.length(out) > limit).alias("truncated"))


def utf16_units(col: Column) -> Column:
    """Length in UTF-16 code units, as messaging services count."""
    return (F.octet_length(F.encode(col, "UTF-16LE")) / 2).cast("int")


#: The shapes of tokens and passwords that are masked.
SECRET_SHAPES = (
    (r"\b\d{8,12}:[A-Za-z0-9_-]{30,}\b", "[REDACTED]"),
    (r"\b(?:sk|rk|gh[pousr])[-_][A-Za-z0-9_-]{16,}\b", "[REDACTED]"),
    (r"(?i)(postgres(?:ql)?(?:\+\w+)?://[^:@\s]+:)[^@\s]+(@)", "$1[REDACTED]$2"),
    (r"(?i)\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "[REDACTED]"),
)


def redact(col: Column, secrets: Iterable[str] = ()) -> Column:
    """Known secrets of six characters or more, and anything of a secret's shape, masked."""
    for s in secrets:
        if len(s) >= 6:
            col = F.replace(col, F.lit(s), F.lit("[REDACTED]"))
    # a substring that every match holds is looked for first: it is far cheaper than the pattern
    low = F.lower(col)
    for (shape, mask), needed in zip(SECRET_SHAPES, (col.contains(":"), None, low.contains("postgres"), low.contains("eyj"))):
        masked = F.regexp_replace(col, shape, mask)
        col = masked if needed is None else F.when(needed, masked).otherwise(col)
    return col


def stable_digest(*parts: Column) -> Column:
    """SHA-256 over the JSON of the parts, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i:02d}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def idempotency_key(category: Column, *parts: Column) -> Column:
    """category:32 hex digits, equal for parts that differ only in accents, case and punctuation."""
    norm = [normalise(F.coalesce(p.cast("string"), F.lit("None"))) for p in parts]
    return F.concat(F.lower(category), F.lit(":"), F.substring(F.sha2(F.concat_ws("\u001f", category, *norm), 256), 1, 32))


def lock_key(name: Column) -> Column:
    """A non-negative 31-bit key of a name."""
    return F.crc32(name.cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF))
