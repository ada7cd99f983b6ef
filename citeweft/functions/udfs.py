"""The vectorised functions that Spark has no built-in for."""

from __future__ import annotations

import json
import unicodedata
from collections import deque

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(s: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        if x is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold()

    return s.map(one)


def fold(text: Column) -> Column:
    """Compatibility decomposition without marks, case folded. ASCII texts stay in the JVM; Python sees nulls there."""
    foreign = text.rlike(r"[^\x00-\x7F]")
    return F.when(foreign, F.pandas_udf(_fold, "string")(F.when(foreign, text))).otherwise(F.lower(text))


def jaro_winkler(a: str, b: str, weight: float = 0.1, longest: int = 4, boost: float = 0.7) -> float:
    """Jaro-Winkler similarity; the common prefix counts only above ``boost``."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    # the places of each letter in b that are neither taken nor out of reach: a place too far back stays so
    free: dict[str, deque[int]] = {}
    for j, c in enumerate(b):
        free.setdefault(c, deque()).append(j)
    left, taken = [], []
    for i, c in enumerate(a):
        places = free.get(c)
        while places and places[0] < i - reach:
            places.popleft()
        if places and places[0] <= i + reach:
            taken.append(places.popleft())
            left.append(c)
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in sorted(taken)]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= boost:
        return jaro
    prefix = 0
    for x, y in zip(a[:longest], b[:longest], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * weight * (1 - jaro)


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity of two columns; null where either is."""
    return F.pandas_udf(_similar, "double")(a, b)


#: Fields of a response body that hold identifiers, and containers that are searched for more.
ID_FIELDS = ("id", "paperId", "DOI")
ID_CONTAINERS = ("results", "data", "items", "message", "citedPaper", "citingPaper", "referenced_works")


def _ids(value: object, out: set[str]) -> set[str]:
    if isinstance(value, dict):
        for k in ID_FIELDS:
            if value.get(k):
                out.add(str(value[k]))
        for k in ID_CONTAINERS:
            if k in value:
                _ids(value[k], out)
    elif isinstance(value, list):
        for x in value:
            if isinstance(x, str):
                out.add(x)
            else:
                _ids(x, out)
    return out


def _collect(body: pd.Series) -> pd.Series:
    def one(x: str | None) -> list[str]:
        try:
            return sorted(_ids(json.loads(x), set())) if x else []
        except ValueError:
            return []

    return body.map(one)


def collect_ids(body: Column | str) -> Column:
    """The sorted identifiers in a JSON body; none where it cannot be parsed."""
    return F.pandas_udf(_collect, "array<string>")(body)


def canonical(value: object) -> str:
    """JSON with sorted keys and no white space; other scripts stay as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _canonical(text: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        try:
            return None if x is None else canonical(json.loads(x))
        except ValueError:
            return x

    return text.map(one)


def canonical_json(text: Column | str) -> Column:
    """JSON texts in canonical form; what is no JSON stays as it is."""
    return F.pandas_udf(_canonical, "string")(text)
