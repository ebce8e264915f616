"""Small tables with the awkward cases, and results by brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

#: Extra columns that have names the operators use themselves.
EXTRA = ["kept", "n_words", "row", "part", "label", "start", "component", "z", "length", "rank", "__part", "__seq", "__z",
         "__doc", "__no_id", "__kept", "__gone", "id", "spans", "hit_id", "hit_hash", "__spans"]
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in EXTRA)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["the", "of", "and"] + [a + b for a in ("ka", "lo", "mi", "Ter", "sé") for b in ("na", "ro", "stu", "ß", "ple")]
    return " ".join(rng.choice(words) + str(rng.randrange(40)) * rng.randrange(2) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    passage = prose(99, 60)
    edited = prose(1, 200).split(" ")
    edited[100] = "changed"
    rows = [(10, prose(1, 200)), (11, prose(1, 200)), (12, " ".join(edited)), (13, None), (14, ""), (15, " \n\t "),
            (16, "one"), (17, "Two  words"), (18, prose(3, 30) + "\n" + passage + "\n" + prose(4, 50)),
            (19, passage + "  " + prose(5, 20)), (20, prose(6, 9000)), (21, passage + "\n" + passage),
            (22, "naïve straße " * 40), (None, prose(1, 200)), (None, None), (23, prose(7, 80)), (23, prose(7, 80)),
            (24, "A" * 400), (25, "\x00 nul \x1f" * 30), (9, prose(3, 30))]
    return rows


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", *(["x"] * len(EXTRA))) for i, t in rows], SCHEMA)


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def benchmark_words(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def decontaminated(docs, items, n=10):
    wins = {}
    for item, text in items:
        w = benchmark_words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            wins.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = benchmark_words(text), set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in wins:
                    hit |= set(range(i, i + size))
                    found |= wins[tuple(w[i:i + size])]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def repeated_words(docs, n=35):
    count = Counter(tuple(w[i:i + n]) for _, t in docs for w in [words(t)] for i in range(len(w) - n + 1))
    out = []
    for doc, text in docs:
        w = words(text)
        gone = {p for i in range(len(w) - n + 1) if count[tuple(w[i:i + n])] > 1 for p in range(i, i + n)}
        out.append((doc, len(w), len(gone), sha(b" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def repeated_bytes(docs, n=50):
    first = {}
    for doc, text in docs:
        b = (text or "").encode()
        for i in range(len(b) - n + 1 if doc is not None else 0):
            first[b[i:i + n]] = min(doc, first.get(b[i:i + n], doc))
    out = []
    for doc, text in docs:
        b = (text or "").encode()
        gone = {p for i in range(len(b) - n + 1 if doc is not None else 0) if first[b[i:i + n]] < doc
                for p in range(i, i + n)}
        spans = sum(1 for p in gone if p - 1 not in gone)
        out.append((doc, len(b), len(gone), spans, sha(bytes(x for p, x in enumerate(b) if p not in gone))))
    return out


def shingles(text: str | None) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(docs, similarity=85):
    sets = [(d, shingles(t)) for d, t in docs]
    known = {d: s for d, s in sets if d is not None}
    root = {d: d for d in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in known:
        for b in known:
            common = len(known[a] & known[b])
            if a < b and common and 100 * common >= similarity * len(known[a] | known[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets]


def rows_of(df, *columns):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def backoff(rows, order, alpha):
    """(doc_id, words, sum of log scores) of each row by the n-grams of the other rows."""
    words = [re.findall("[^ \\t-\\r]+", text or "") for _, text in rows]
    grams = [[Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) for n in range(order + 1)] for w in words]
    out = []
    for k, (doc, _) in enumerate(rows):
        rest = [sum((g[n] for j, g in enumerate(grams) if j != k), Counter()) for n in range(order + 1)]
        elsewhere, total = sum(len(w) for j, w in enumerate(words) if j != k), 0.0
        for i in range(len(words[k])):
            longest = min(order - 1, i)
            for n in range(longest, -1, -1):
                context, gram = tuple(words[k][i - n:i]), tuple(words[k][i - n:i + 1])
                if rest[n + 1][gram]:
                    total += math.log(rest[n + 1][gram] / (rest[n][context] if n else elsewhere)) + (longest - n) * math.log(alpha)
                    break
            else:
                total += order * math.log(alpha) - math.log(elsewhere + 1)
        out.append((doc, len(words[k]), round(total, 6)))
    return out
