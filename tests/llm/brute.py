"""Plain Python versions of what the operators compute, for small tables."""

from collections import defaultdict


def words(text):
    return (text or "").encode().split()


def shingles(text):
    w = [x.lower() for x in words(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    """doc_id -> (number of shingles, smallest doc_id reachable) of (doc_id, text) rows with distinct ids; every pair is compared."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for d, s in sorted(sets.items()):
        common = defaultdict(int)
        for x in s:
            for other in holders[x]:
                common[other] += 1
            holders[x].append(d)
        for other, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[other]) - n):
                a, b = find(d), find(other)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}
