"""JSON from free text: whole text, fenced block, first balanced region, else the raw text."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages a fence may name.
FENCE = re.compile(r"```(?:json|javascript|js|ts|python)?\s*(.*?)\s*```", re.I | re.S)
# What matters to bracket depth outside and inside strings.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[\[\]{}]', re.S)
CLOSER = {"{": "}", "[": "]"}


def _finite(value):
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_finite(v) for v in value]
    return value


def _loads(text: str):
    """(found, value): strict JSON, the last of equal keys wins, non-finite numbers are null."""
    try:
        return True, _finite(json.loads(text))
    except (ValueError, RecursionError):
        return False, None


def _balanced(text: str) -> str | None:
    """From the first bracket to the one that closes it, strings skipped."""
    start = re.search(r"[{\[]", text)
    if start is None:
        return None
    opener = start.group()
    depth = 0
    for token in TOKEN.finditer(text, start.start()):
        if token.group() == opener:
            depth += 1
        elif token.group() == CLOSER[opener]:
            depth -= 1
            if depth == 0:
                return text[start.start() : token.end()]
    return None


def _dump(value) -> str:
    text = json.dumps(value, ensure_ascii=False)
    try:
        text.encode()
    except UnicodeEncodeError:  # half of a surrogate pair
        text = json.dumps(value)
    return text


def extract_json(text: str | None) -> tuple[str | None, str | None]:
    """(JSON text, how it was found)."""
    if text is None:
        return None, None
    trimmed = text.strip()
    found, value = _loads(trimmed)
    if found:
        return _dump(value), "direct"
    for block in FENCE.findall(trimmed):
        found, value = _loads(block)
        if found and value is not None:
            return _dump(value), "fence"
        if found:
            break
    region = _balanced(trimmed)
    if region is not None:
        found, value = _loads(region)
        if found:
            return _dump(value), "balanced"
    return _dump({"raw_text": text}), "raw"


def lenient_json(text: Column) -> Column:
    """Struct of ``json`` and ``parse_path`` (direct, fence, balanced, raw)."""

    @F.pandas_udf("struct<json string, parse_path string>")
    def extract(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract_json(t) for t in texts], columns=["json", "parse_path"])

    return extract(text)


def field(value: Column, path: str, kind: str = "string") -> Column:
    """A typed field of a VARIANT, null when absent or of another type."""
    return F.try_variant_get(value, f"$.{path}", kind)
