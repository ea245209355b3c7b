"""Plain versions of the operators, and rows with all kinds of trouble in them."""

import collections
import random
import re

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def lower_words(text):
    return ALNUM.findall((text or "").translate(UPPER))


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def clashing(df):
    """More columns, with names that the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["key", "id", "row", "chunk", "part", "words", "n", "tag", "set", "start", "end", "window", "kept", "rank", "score", "v", "page", "node"]
    return df.withColumns({c: F.lit("x") for c in names if c not in df.columns})


def texts(seed=1, n=60, vocabulary=12):
    """(id, text) rows: copies, near copies, shared passages, short, empty and null texts, repeated rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary * 20)] + ["Über", "É", "the", "The", "x-y"]
    make = lambda k: [rng.choice(words) for _ in range(k)]
    shared = make(30)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not rows:
            own = make(rng.randint(40, 120))
        elif kind == 1:
            own = spaced_words(rng.choice(rows)[1]) or make(20)
        elif kind == 2:
            own = spaced_words(rng.choice(rows)[1]) or make(60)
            if own:
                own[rng.randrange(len(own))] = "changed"
        elif kind == 3:
            own = make(rng.randint(0, 30)) + shared[rng.randint(0, 8) :] + make(10)
        elif kind == 4:
            own = make(rng.randint(1, 6))
        else:
            own = [rng.choice(["a", "b"])] * rng.randint(10, 40)
        rows.append((i * 3, rng.choice([" ", "  ", "\n"]).join(own)))
    rows += [(1, None), (2, ""), (4, "  \n "), (5, "!!! ???"), (None, rows[0][1]), rows[3], rows[3], (7, rows[0][1].upper())]
    return rows


def decontaminated(rows, items, length=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = lower_words(text)
        size = min(len(w), length)
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for key, text in rows:
        w = lower_words(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (ids := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= ids
        out.append((key, len(w), len(hit), tuple(sorted(map(str, found))), bool(hit)))
    return out


def shingles(text, size=5):
    w = lower_words(text)
    if len(w) >= size:
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def classes(rows, similarity=0.8):
    """(class id, class size, links) of each row, and whether the row is the one that stays."""
    sets = [shingles(t) for _, t in rows]
    links = collections.defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and both >= similarity * len(sets[a] | sets[b]) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    out, seen = [None] * len(rows), set()
    for a in range(len(rows)):
        if a in seen:
            continue
        group, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        seen |= group
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            out[i] = (min(ids) if ids else None, len(group), len(links[i]))
    return out


def without_repeats(rows, length=13):
    first = {}
    for key, text in rows:
        w = spaced_words(text)
        for i in range(len(w) - length + 1 if key is not None else 0):
            window = tuple(w[i : i + length])
            first[window] = min(key, first.get(window, key))
    out = []
    for key, text in rows:
        w = spaced_words(text)
        gone = set()
        for i in range(len(w) - length + 1 if key is not None else 0):
            if first[tuple(w[i : i + length])] < key:
                gone |= set(range(i, i + length))
        out.append((key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)
