"""JSON out of model answers, tolerant of prose, truncation and control characters."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

LENIENT = {"mode": "PERMISSIVE", "allowUnquotedControlChars": "true"}


def array_slice(raw: Column | str) -> Column:
    """From the first ``[`` to the last ``]``, NULL without one."""
    found = F.regexp_extract(raw, r"(?s)(\[.*\])", 1)
    return F.nullif(found, F.lit(""))


def object_slice(raw: Column | str) -> Column:
    found = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.nullif(found, F.lit(""))


def json_array(raw: Column | str, item_schema: str) -> Column:
    """array<item> or NULL when the slice is no JSON array; unknown keys are dropped."""
    return F.from_json(array_slice(raw), f"array<{item_schema}>", LENIENT)


def json_object(raw: Column | str, schema: str) -> Column:
    return F.from_json(object_slice(raw), schema, LENIENT)


_MARKS = re.compile(r'\\.|["{}]', re.DOTALL)


def salvage(raw: str | None) -> list[str]:
    """The complete top-level objects of a possibly cut answer, as JSON texts."""
    found: list[str] = []
    depth, start, quoted = 0, 0, False
    for mark in _MARKS.finditer(raw or ""):
        sign = mark.group()
        if sign == '"':
            quoted = not quoted
        elif quoted or len(sign) > 1:
            continue
        elif sign == "{":
            start = mark.start() if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                try:
                    value = json.loads(raw[start : mark.end()], strict=False)
                except json.JSONDecodeError:
                    continue
                found.append(json.dumps(value, ensure_ascii=False))
    return found


@pandas_udf(ArrayType(StringType()))
def balanced_objects(raw: pd.Series) -> pd.Series:
    return raw.map(salvage)
