"""Plain Python versions that several tests share."""

import collections
import re

WORD = r"[^\x20\x09-\x0D]+"


def shingles(text):
    w = text.encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute_components(docs, percent=80):
    sets, parent = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a]:
                k = len(sets[a] & sets[b])
                if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}, sets


def template_keys(line):
    w = ["<*>" if re.search("[0-9]", x) else x for x in re.findall(WORD, line)]
    n = len(w)
    keys = [(n, 0, tuple(w))] if n else []
    if n - 2 >= 3:
        cut = [2 + (n - 2) * j // 3 for j in range(4)]
        keys += [(n, j + 1, tuple(w[: cut[j]]), tuple(w[cut[j + 1] :])) for j in range(3)]
    return keys


def brute_lines(docs, min_docs=3, long_line=20):
    holders = collections.defaultdict(set)
    for d, t in docs:
        for line in t.split("\n"):
            for k in template_keys(line):
                holders[k].add(d)
    first = {k: min(v) for k, v in holders.items() if len(v) >= (min(2, min_docs) if k[0] >= long_line else min_docs)}
    return {d: "\n".join(x for x in t.split("\n") if all(first.get(k, d) == d for k in template_keys(x))) for d, t in docs}


def words(text):
    """Lower-case words without ASCII punctuation."""
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", (text or "").lower()).split()


def sequence(w, size=5):
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
