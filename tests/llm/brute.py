"""Plain versions of the corpus operators, for small tables."""

import re
from collections import Counter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW) if lower else text)


def shingles(text, size):
    w = words(text, True)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def components(sets, percent=80):
    """{key: set} to {key: least key reachable}."""
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for k, s in sets.items():
        shared = Counter(j for x in s for j in where.get(x, ()))
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            where.setdefault(x, []).append(k)
    return {k: find(k) for k in sets}


def without_repeats(texts, window):
    """[text] to [(n_words, kept words)]."""
    lists = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), [x for x, g in zip(w, gone, strict=True) if not g]))
    return out


def tokens(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate(LOW))


def overlapping(text, items, window=12, substitutions=2, shortest=8):
    """Ids of the items that overlap a text."""
    w, found = tokens(text), set()
    for ident, item in items:
        t = tokens(item)
        size, most = (window, substitutions) if len(t) >= window else (len(t), 0)
        if len(t) < shortest:
            continue
        for shift in range(-len(t) + 1, len(w)):
            low, high = max(0, shift), min(len(w), shift + len(t))
            same = [w[k] == t[k - shift] for k in range(low, high)]
            if any(sum(same[k : k + size]) >= size - most for k in range(len(same) - size + 1)):
                found.add(ident)
                break
    return found


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0
