"""The normal form of a text with the way back: where in the text each character of the form comes from.

The way back is run-length coded, as two arrays: the characters of the form from ``places[i]`` on, up to the next place,
come from as many characters of the text from ``origins[i]`` on; a character that folds to several (ß, ligatures) has
runs of its own, one for each. Marks of decomposed accents have none. All places count characters from 0.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidemark.functions.text import let, plain

FORM = StructType([StructField("text", StringType()), StructField("places", ArrayType(IntegerType())), StructField("origins", ArrayType(IntegerType()))])


@lru_cache(maxsize=65_536)
def _pieces(char: str) -> str:
    """What one character folds to; a space for what is neither a letter a to z nor a digit, empty for marks."""
    bare = (c for c in unicodedata.normalize("NFKD", char.casefold()) if not unicodedata.combining(c))
    return "".join(c if "a" <= c <= "z" or c.isdigit() else " " for c in bare)


def traced(text: str) -> tuple[str, np.ndarray]:
    """The form of a text and the origin of each of its characters, linear in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.flatnonzero(np.bincount(codes))
    number = np.zeros(int(kinds[-1]) + 1 if len(kinds) else 1, dtype=np.int64)
    number[kinds] = np.arange(len(kinds))
    which = number[codes]
    folded = [_pieces(chr(k)) for k in kinds]
    sizes = np.array([len(f) for f in folded], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer("".join(folded).encode("utf-32-le"), dtype=np.uint32)
    each = sizes[which]
    origin = np.repeat(np.arange(len(codes)), each)
    within = np.arange(len(origin)) - np.repeat(np.cumsum(each) - each, each)
    out = flat[np.repeat(starts[which], each) + within]
    blank = out == 32
    keep = ~(blank & np.concatenate(([True], blank[:-1])))   # one space of several, none at the beginning
    out, origin = out[keep], origin[keep]
    if len(out) and out[-1] == 32:
        out, origin = out[:-1], origin[:-1]
    return out.astype(np.uint32).tobytes().decode("utf-32-le"), origin


@F.pandas_udf(FORM)
def _form(texts: pd.Series) -> pd.DataFrame:
    out: dict[str, list] = {"text": [], "places": [], "origins": []}
    for t in texts:
        form, origin = (None, None) if t is None else traced(t)
        first = None if origin is None else np.flatnonzero(np.diff(origin, prepend=-2) != 1)
        out["text"].append(form)
        out["places"].append(None if first is None else first.astype(np.int32))
        out["origins"].append(None if first is None else origin[first].astype(np.int32))
    return pd.DataFrame({name: pd.Series(cells, dtype="object") for name, cells in out.items()})


def form(text: Column) -> Column:
    """(text, places, origins) of a text; all null for a null. Digits of other scripts are kept."""
    return _form(text)


def origin_of(form: Column, place: Column) -> Column:
    """Where in the text the character at ``place`` of its form comes from; null outside the form."""
    def of(at: Column) -> Column:
        before = F.filter(form["places"], lambda p: p <= at)
        return F.when((at >= 0) & (at < F.length(form["text"])), F.get(form["origins"], F.size(before) - 1) + (at - F.element_at(before, -1)))

    return let(place, of)


def located(form: Column, markers: tuple[str, ...]) -> Column:
    """(place, origin) of the first marker in list order that occurs in the form, in the form and in the text."""
    at = F.coalesce(*[F.nullif(F.instr(form["text"], F.lit(plain(m))), F.lit(0)) for m in markers]) - 1
    return let(at, lambda p: F.struct(p.alias("place"), origin_of(form, p).alias("origin")))


def window(text: Column, form: Column, markers: tuple[str, ...], size: int) -> Column:
    """``size`` characters of the text itself from the first marker on, whatever the fold did before it; empty
    where there is none."""
    return F.coalesce(F.substring(text, located(form, markers)["origin"] + 1, F.lit(size)), F.lit(""))
