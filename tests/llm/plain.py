"""The text operators' results by plain Python, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near_groups(rows, percent=85):
    """doc_id -> (shingles, smallest linked doc_id)."""
    sets = {}
    for doc, text in rows:
        words = WORD.findall(lowered(text or ""))
        whole = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []
        sets[doc] = frozenset(whole)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for doc in sorted(sets):
        common = defaultdict(int)
        for shingle in sets[doc]:
            for other in holders[shingle]:
                common[other] += 1
            holders[shingle].append(doc)
        for other, n in common.items():
            if 100 * n >= percent * (len(sets[doc]) + len(sets[other]) - n):
                a, b = root(doc), root(other)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def without_repeats(rows, window=50):
    """doc_id -> (words, removed words, sha256 of the kept ones)."""
    words = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for doc in sorted(words):
        for i in range(len(words[doc]) - window + 1):
            first.setdefault(tuple(words[doc][i : i + window]), doc)
    out = {}
    for doc, own in words.items():
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            if first[tuple(own[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(own, gone) if not g)
        out[doc] = (len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def best_path(word: bytes, pieces: dict[bytes, tuple[int, float]], unknown: float) -> float:
    """The highest total score of a segmentation of ``word``."""
    best = [0.0] + [float("-inf")] * len(word)
    for i in range(len(word)):
        if best[i] == float("-inf"):
            continue
        length = 1 if word[i] < 0x80 else 2 if word[i] < 0xE0 else 3 if word[i] < 0xF0 else 4
        if word[i : i + length] not in pieces:
            best[i + length] = max(best[i + length], best[i] + unknown)
        for j in range(i + 1, min(len(word), i + 64) + 1):
            if word[i:j] in pieces:
                best[j] = max(best[j], best[i] + pieces[word[i:j]][1])
    return best[-1]
