"""Documents that every operator has to live with, and plain versions of shared rules."""

import re

CLASHING = "h string, n int, key long, row long, hash string, seed int, node int, component string, text2 string, kind string"
EXTRA = ("x", 1, 2, 3, "y", 4, 5, "z", None, "k")
LONG = "the long word of tale number one and two " * 6000


def odd_documents(spark):
    rows = [
        (0, None),
        (1, ""),
        (2, "   \n\t "),
        (3, "one"),
        (4, "one"),
        (5, LONG),
        (6, "Ein Text mit Ümläuten, ß und émojis 😀 mail a@b.org"),
        (6, "Ein Text mit Ümläuten, ß und émojis 😀 mail a@b.org"),
        (None, "one"),
        (None, None),
        (7, "token = abcdef0123456789abcdef0123456789"),
    ]
    return spark.createDataFrame([r + EXTRA for r in rows], "doc_id long, text string, " + CLASHING)


def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, " + CLASHING)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def shingle_set(text, k):
    w = spaced_words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def groups_by_brute_force(sets, percent):
    """Component of every key by comparing all pairs of the given key -> set."""
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {k: root(k) for k in keys}
