"""Inputs with awkward rows, and plain versions of what the operators compute."""

import hashlib
import random
import re

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, row string, k string, key string, fp string, h string, n string, `odd name` string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *"abcdefghi") for i, t in rows], SCHEMA)


def awkward():
    """Nulls in any column, empty and very long texts, repeated rows, ties."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "ÖL", "x", "1", "a-b", "<|endoftext|>"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = text(9000)
    shared = text(30)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one"), (6, "one"), (None, "one"), (None, None), (7, long), (8, long.upper()), (9, long[:-5] + "x")]
    rows += [(10 + i, text(5) + " " + shared + "\n" + text(rng.randint(1, 40))) for i in range(12)]
    rows += [(40 + i, " ".join(["tick", "tock", "tuck"][: 1 + i % 3] * 40)) for i in range(4)]
    rows += [(50, "word " * 25 + "\r\nend"), (51, "word " * 60), (52, "Σ Σς ﬁ   á ​ 한국 " * 9)]
    return rows


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def order(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def fingerprint(text):
    words = space_words(lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(rows):
    """(doc_id, fingerprint, component_id) of each row."""
    fps = [fingerprint(t) for _, t in rows]
    u = Union()
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                u.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = u.find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, f"{f:016x}", least.get(u.find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))]


def repeated_words(rows, size=20):
    """(doc_id, n_words, n_removed, kept) of each row."""
    first = {}
    cut = [(order(d), d, space_words(t)) for d, t in rows]
    for o, _, w in cut:
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            first[g] = min(first.get(g, (o, i)), (o, i))
    out = []
    for o, d, w in cut:
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (o, i):
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def contaminated(rows, items):
    """(doc_id, n_words, n_hit, item ids, contaminated) of each row."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = {}
    for item, text in items:
        w = words(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(g) for g in grams}
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                g = grams.get(tuple(w[i : i + size]))
                if g:
                    hit.update(range(i, i + size))
                    found |= g
        found.discard(None)
        out.append((d, len(w), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
