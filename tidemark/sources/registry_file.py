"""The registry of sources as YAML files: a reader of the block form, and a writer.

Read are block mappings and sequences by indentation, flow sequences, plain and quoted scalars over several lines, and
comments; anchors, tags, flow mappings and literal blocks are refused. A file is one row of text, parsed by itself;
its entries become typed columns in Spark. What the writer makes is again such a form, entry by entry, so it can be
written in parts, each of which reads alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: The columns of an entry, and what holds where a file does not name them.
COLUMNS = (
    "id string, name string, institution string, base_url string, official boolean, trust_level int, priority int, adapter string, discovery_method string, "
    "enabled boolean, trust_status string, allowed_hosts array<string>, seed_urls array<string>, link_pattern string, max_documents int, max_depth int, "
    "expected_min_links int, render boolean, validation_url string, validated_at string, limitations string")
DEFAULTS = {"official": True, "trust_level": 1, "priority": 10, "adapter": "generic", "discovery_method": "html", "enabled": True, "trust_status": "TRUSTED",
            "link_pattern": r"concurso|seletiv|edital|retifica|prorroga|\.pdf(?:\?|$)", "max_documents": 10, "max_depth": 2, "expected_min_links": 0, "render": False,
            "validation_url": "", "limitations": ""}
#: Escapes of double quotes, and plain words that mean nothing.
ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\",
           "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
NULLS = ("", "~", "null", "Null", "NULL")

_QUOTED = r'"(?:[^"\\]|\\[\s\S])*"|\'(?:[^\']|\'\')*\''
_WHOLE_QUOTED = re.compile(rf"({_QUOTED})\s*(?:#.*)?$")
_WHOLE_FLOW = re.compile(rf"(\[(?:{_QUOTED}|[^\"'])*\])\s*(?:#.*)?$")
_FLOW_PART = re.compile(rf"\s*({_QUOTED}|[\[\],]|[^\[\],\"'][^\[\],]*)")
_PAIR = re.compile(rf"({_QUOTED}|[^\s\"'\[{{#&*!|>%@`-][^:#]*?|-[^\s:#][^:#]*?)\s*:(?:\s+(.*))?$")
_COMMENT = re.compile(r"(?:^|\s)#.*$")
_ESCAPE = re.compile(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[\s\S])")
_PAIRED = re.compile(r"[\ud800-\udbff][\udc00-\udfff]")


def _unquoted(text: str) -> str:
    if text[0] == "'":
        return text[1:-1].replace("''", "'")

    def meant(m: re.Match) -> str:
        code = m[1]
        return chr(int(code[1:], 16)) if code[0] in "xuU" and len(code) > 1 else ESCAPES.get(code, code)

    said = _ESCAPE.sub(meant, text[1:-1])
    return _PAIRED.sub(lambda m: m[0].encode("utf-16", "surrogatepass").decode("utf-16"), said)


def _flow(text: str) -> list:
    """A flow sequence, sequences in it included."""
    stack: list[list] = [[]]
    for m in _FLOW_PART.finditer(text):
        part = m[1].strip()
        if part == "[":
            stack.append([])
        elif part == "]":
            done = stack.pop()
            stack[-1].append(done)
        elif part and part != ",":
            stack[-1].append(_value(part))
    return stack[0][0]


def _value(text: str):
    """What a finished scalar or flow sequence says: a text, a list, or None."""
    if text[:1] in ('"', "'"):
        return _unquoted(_WHOLE_QUOTED.match(text)[1])
    if text[:1] == "[":
        return _flow(_WHOLE_FLOW.match(text)[1])
    plain = _COMMENT.sub("", text).strip()
    if plain[:1] in ("{", "&", "*", "!", "|", ">", "%", "@", "`"):
        raise ValueError(f"not in the block form that is read: {plain[:60]}")
    return None if plain in NULLS else plain


def _unfinished(text: str) -> bool:
    return text[:1] in ('"', "'") and not _WHOLE_QUOTED.match(text) or text[:1] == "[" and not _WHOLE_FLOW.match(text)


def _tokens(text: str) -> list[list]:
    """[kind, indent, key, text]: items, pairs and scalars, texts over several lines folded."""
    out: list[list] = []
    gap, above = 0, 0   # empty lines since, and the indentation that a continued plain scalar must exceed
    for raw in text.splitlines():
        body = raw.strip(" \t\r")
        last = out[-1] if out else None
        if last and last[3] is not None and _unfinished(last[3]):
            if body == "" and last[3][0] != "[":
                gap += 1
                continue
            said = last[3]
            slashes = len(said) - len(said.rstrip("\\"))
            escaped = said[0] == '"' and slashes % 2 == 1
            last[3] = (said[:-1] if escaped else said) + ("\n" * gap if gap else "" if escaped else " ") + body
            gap = 0
            continue
        gap = 0
        if body == "" or body[0] == "#" or body in ("---", "..."):
            continue
        indent = len(raw) - len(raw.lstrip(" "))
        continued = last and last[3] is not None and last[3] != "" and last[3][0] not in "\"'[" and indent > above
        if continued:
            last[3] = f"{_COMMENT.sub('', last[3]).rstrip()} {body}"
            continue
        above = indent
        while body == "-" or body.startswith("- "):
            out.append(["item", indent, None, None])
            above = indent
            rest = body[1:].lstrip(" ")
            indent += len(body) - len(rest)
            body = rest
        pair = _PAIR.match(body)
        if pair:
            out.append(["pair", indent, _value(pair[1]), pair[2] or ""])
            above = indent
        elif body:
            out.append(["scalar", indent, None, body])
    return out


def _built(tokens: list[list], i: int):
    """The value that begins at token ``i``, and the token after it."""
    kind, indent = tokens[i][:2]
    if kind == "scalar":
        return _value(tokens[i][3]), i + 1
    out: list | dict = [] if kind == "item" else {}
    while i < len(tokens) and tokens[i][0] == kind and tokens[i][1] == indent:
        key, said = tokens[i][2], tokens[i][3]
        value = _value(said) if said else None
        i += 1
        inside = i < len(tokens) and (tokens[i][1] > indent or kind == "pair" and tokens[i][0] == "item" and tokens[i][1] == indent)
        if inside and (kind == "item" or not _COMMENT.sub("", said or "").strip()):
            value, i = _built(tokens, i)
        if kind == "item":
            out.append(value)
        else:
            out[key] = value
    return out, i


def entries(text: str) -> list[dict]:
    """The entries of a registry: those under ``sources``, or of a part of it that begins with an entry."""
    tokens = _tokens(text)
    if not tokens:
        return []
    whole, end = _built(tokens, 0)
    if end < len(tokens):
        raise ValueError(f"indentation of: {tokens[end]}")
    found = whole.get("sources") if isinstance(whole, dict) else whole
    return found or []


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for text in batch["value"]:
            yield pd.DataFrame({"line": [json.dumps(e, ensure_ascii=False) for e in entries(text or "")]}, dtype="object")


def _typed(name: str, kind) -> Column:
    """A column by its type; what cannot be read as it is null, what is absent has its default."""
    read = F.col(f"e.{name}")
    if isinstance(kind, ArrayType):
        return F.coalesce(read, F.array().cast(kind)).alias(name)
    if not isinstance(kind, StringType):
        said = F.lower(read)
        read = F.when(said == "on", "true").when(said == "off", "false").otherwise(said).try_cast(kind) if kind.simpleString() == "boolean" else read.try_cast(kind)
    if name in DEFAULTS:
        absent = ~F.array_contains(F.coalesce(F.json_object_keys("line"), F.array().cast("array<string>")), name)
        read = F.when(absent, DEFAULTS[name]).otherwise(read)
    return read.alias(name)


def read(spark: SparkSession, path: str, columns: str = COLUMNS) -> DataFrame:
    """Entries of the files at ``path``, each column by its type; keys that are no column are left out."""
    wanted = StructType.fromDDL(columns)
    texts = ", ".join(f"`{f.name}` {'array<string>' if isinstance(f.dataType, ArrayType) else 'string'}" for f in wanted)
    lines = spark.read.text(path, wholetext=True).mapInPandas(_parsed, "line string")
    return lines.select("line", F.from_json("line", texts).alias("e")).select(*[_typed(f.name, f.dataType) for f in wanted])


def _scalar(df: DataFrame, name: str) -> Column:
    """A value as YAML: lists and texts in the quotes of JSON, which YAML reads."""
    kind, value = df.schema[name].dataType, F.col(name)
    if isinstance(kind, ArrayType):
        return F.coalesce(F.to_json(value), F.lit("null"))
    if kind.simpleString() in ("boolean", "tinyint", "smallint", "int", "bigint"):
        return F.coalesce(value.cast("string"), F.lit("null"))
    quoted = F.to_json(F.array(value.cast("string")))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def blocks(sources: DataFrame) -> DataFrame:
    """(priority, id, text): every source as an entry, its columns in their order."""
    pairs = [F.concat(F.lit(f"{n}: "), _scalar(sources, n)) for n in sources.columns]
    return sources.select("priority", "id", F.concat(F.lit("  - "), F.concat_ws("\n    ", *pairs)).alias("text"))


def write(sources: DataFrame, path: str) -> None:
    """The registry at ``path``, by priority and id, in as many parts as there is text."""
    head = sources.sparkSession.range(1).select(F.lit(0).alias("n"), F.lit(None).cast(sources.schema["priority"].dataType).alias("priority"), F.lit("").alias("id"), F.lit("sources:").alias("text"))
    rows = blocks(sources).select(F.lit(1).alias("n"), "priority", "id", "text").union(head)
    rows.orderBy("n", "priority", "id").select("text").write.text(path)
