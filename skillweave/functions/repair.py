"""JSON repair, which SQL functions do not express, in Arrow batches; rows that cannot be read go to quarantine with a reason."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
_WORDS = {"True": "true", "False": "false", "None": "null"}


def _block(text: str) -> str:
    """The first balanced object or array, strings aside; what is missing at the end is closed."""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return text
    stack, quoted, escaped = [], False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            escaped = not escaped and c == "\\"
            if c == '"' and not (escaped or text[i - 1] == "\\"):
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            if not stack:
                return text[start : i + 1]
    return text[start:] + ('"' if quoted else "") + "".join(reversed(stack))


def _in_order(text: str) -> str:
    """Outside strings: Python's words to JSON's, commas between values, none before a bracket; inside: breaks escaped."""
    out: list[str] = []
    for i, part in enumerate(re.split(r'("(?:[^"\\]|\\.)*")', text, flags=re.S)):
        if i % 2:
            out.append(part.replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t"))
            continue
        part = re.sub(r"\b(True|False|None)\b", lambda m: _WORDS[m[1]], part)
        part = re.sub(r"'([^'\\\n]*)'", lambda m: json.dumps(m[1]), part)
        part = re.sub(r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", r'\1"\2"\3', part)
        out.append(re.sub(r",(\s*[}\]])", r"\1", part))
    joined = re.sub(r'([}\]"0-9el])(\s*\n\s*)(["{\[])', r"\1,\2\3", "".join(out))
    return re.sub(r",(\s*[}\]])", r"\1", joined)


#: How a text was read, and why another one was not.
STEPS = ("whole", "block", "repaired")
REASONS = ("null", "empty", "no_bracket", "cut", "malformed")


def repair_step(text: str | None) -> tuple[str | None, str]:
    """Valid JSON text made of near-JSON and the step that read it, or null and the reason.

    whole: as it is, or what a fence holds; block: its first balanced value; repaired: words, quotes, commas and breaks put
    in order. Reasons: null; empty: nothing but white space; no_bracket: no object or array begins; cut: it ends inside a
    value and closing it does not help; malformed: anything else.
    """
    if text is None:
        return None, "null"
    if not text.strip():
        return None, "empty"
    fenced = _FENCE.search(text)
    inner = fenced[1] if fenced else text
    for step, attempt in zip(STEPS, ((lambda t: t), _block, lambda t: _in_order(_block(t)))):
        try:
            return json.dumps(json.loads(attempt(inner).strip()), ensure_ascii=False), step
        except ValueError:
            continue
    begins = [i for i in (inner.find("{"), inner.find("[")) if i >= 0]
    if not begins:
        return None, "no_bracket"
    return None, "malformed" if inner[min(begins) :].startswith(_block(inner)) else "cut"


def repair(text: str | None) -> str | None:
    """Valid JSON text made of near-JSON, or null where that fails."""
    return repair_step(text)[0]


@pandas_udf(StringType())
def repaired_json(text: pd.Series) -> pd.Series:
    return text.map(repair)


@pandas_udf(StructType([StructField(c, StringType()) for c in ("fixed", "step", "reason")]))
def _read(text: pd.Series) -> pd.DataFrame:
    found = [repair_step(x) for x in text]
    return pd.DataFrame({"fixed": [f for f, _ in found], "step": [s if f is not None else None for f, s in found], "reason": [None if f is not None else s for f, s in found]})


def read_json(rows: DataFrame, column: str) -> DataFrame:
    """rows with fixed, step and reason: every row is read once, and is either repaired or rejected for a reason of REASONS."""
    return rows.withColumn("_read", _read(F.col(column))).select(*rows.columns, "_read.fixed", "_read.step", "_read.reason")


def repaired_and_rejected(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(repaired, rejected) of read_json: the rows with fixed and step, and the quarantined ones with reason."""
    read = read_json(rows, column)
    return read.filter("reason IS NULL").drop("reason"), read.filter("reason IS NOT NULL").drop("fixed", "step")
