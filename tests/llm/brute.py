"""Plain versions of what the operators compute, a text or a table at a time."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_quality(text: str | None) -> dict[str, int | bool]:
    t = text or ""
    ws = WORD.findall(t)
    seen: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(ws) - 2):
        seen.setdefault(tuple(ws[i : i + 3]), []).append(i)
    inside = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {
        "n_words": len(ws),
        "word_chars": sum(map(len, ws)),
        "n_symbols": sum(c in "#*$%&|<>" for c in t),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(inside),
        "base_failed": len(ws) < 50 or 100 * len(inside) > 50 * len(ws),
    }


def lower(text: str | None) -> str:
    """A-Z alone in lower case."""
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def shingle_set(text: str | None, width: int = 5) -> set[tuple[str, ...]]:
    ws = WORD.findall(lower(text))
    if not ws:
        return set()
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))}


def near_duplicates(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id); all pairs that share a shingle are compared."""
    sets = [shingle_set(t) for _, t in rows]
    at: dict[tuple[str, ...], list[int]] = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in at[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return {doc: (len(sets[i]), least[root(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows)}


def base_scores(rows: list[tuple[int, str | None]], modulus: int = 7, remainder: int = 2) -> dict[int, tuple[bool, int, int, int, float]]:
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)."""
    from collections import Counter
    from math import log10
    from zlib import crc32

    counts: Counter = Counter()
    tokens = {doc: [*WORD.findall(lower(t)), "\n"] for doc, t in rows}
    out = {doc: crc32(str(doc).encode()) % modulus == remainder for doc, _ in rows}
    for doc, ws in tokens.items():
        if not out[doc]:
            counts.update(ws)
    n, v = sum(counts.values()), len(counts)
    return {doc: (out[doc], len(ws), sum(counts[w] > 0 for w in ws), n, sum(log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for doc, ws in tokens.items()}
