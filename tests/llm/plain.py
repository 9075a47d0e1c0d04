"""Plain Python versions that the tests compare with."""

import collections
import re

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def lower_words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, width=5):
    w = lower_words(text)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[k:k + width]) for k in range(len(w) - width + 1)}


def jaccard_components(sets, percent=75):
    """id -> smallest id reachable by links."""
    inside = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inside[g].append(i)
    shared = collections.Counter()
    for ids in inside.values():
        for a in ids:
            for b in ids:
                if a < b:
                    shared[a, b] += 1
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), c in shared.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}
