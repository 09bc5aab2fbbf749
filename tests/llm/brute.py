"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LETTER_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(nodes, links):
    """Smallest node reachable from each node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def shingles(text, n=3):
    words = SPACE_WORDS.findall((text or "").translate(UPPER))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def jaccard_links(sets, percent=90):
    """Pairs of row numbers whose sets are similar."""
    inverted = defaultdict(list)
    for k, grams in enumerate(sets):
        for gram in grams:
            inverted[gram].append(k)
    both = Counter(pair for rows in inverted.values() for pair in combinations(rows, 2))
    return [
        (a, b)
        for (a, b), n in both.items()
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)
    ]


def removed_words(texts, window=35):
    """``(words, removed, kept)`` of each text."""
    cut = [SPACE_WORDS.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in cut for i in range(len(w) - window + 1))
    out = []
    for words in cut:
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((len(words), len(gone), " ".join(kept)))
    return out
