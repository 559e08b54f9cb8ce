"""Plain single-process versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def components(rows, percent, size):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {}
    for i, text in rows:
        w = WORD.findall(low(text or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [*sets]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def line_key(line: str) -> str:
    return low(line.strip(" \t\n\x0b\x0c\r"))


def without_lines(rows, min_docs, keep="none"):
    """{doc_id: (text, n_lines, n_dropped)}"""
    owners: dict[str, list] = {}
    for i, text in rows:
        for k in {line_key(x) for x in (text or "").split("\n")} - {""}:
            owners.setdefault(k, []).append(i)
    out = {}
    for i, text in rows:
        lines, stay, seen = (text or "").split("\n"), [], set()
        for x in lines:
            k = line_key(x)
            drop = len(owners.get(k, [])) >= min_docs
            if drop and keep == "first" and min(owners[k]) == i and k not in seen:
                drop = False
            seen.add(k)
            if not drop:
                stay.append(x)
        out[i] = ("\n".join(stay), len(lines), len(lines) - len(stay))
    return out


def without_repeats(rows, length=400):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in raw for p in range(len(b) - length + 1))
    out = {}
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {p for k, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[t] > 1 for p in (k, k + 1, k + 2)}
    n = len(w)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len({*lines}), len(covered), failed


def overlapping(rows, items, span=20, share=0.8):
    """{(doc_id, item_id)}: every alignment with enough equal words is tried."""
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = set()
    for i, text in rows:
        d = plain(text)
        for j, item in items:
            w = plain(item)
            if len(w) < 10:
                continue
            n = min(span, len(w))
            at: dict[str, list[int]] = {}
            for k, x in enumerate(w):
                at.setdefault(x, []).append(k)
            starts = Counter(p - k for p, x in enumerate(d) for k in at.get(x, ()))
            for start, equal in starts.items():
                if equal < share * n:
                    continue
                same = [int(0 <= start + k < len(d) and d[start + k] == w[k]) for k in range(len(w))]
                if any(sum(same[p : p + n]) >= share * n for p in range(len(w) - n + 1)):
                    found.add((i, j))
                    break
    return found
