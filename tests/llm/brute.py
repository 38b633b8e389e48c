"""Plain Python versions of the operators, for small inputs."""

import collections
import hashlib
import re
import zlib

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(words, size=5):
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def components(rows, pct=80):
    """{row number: (n_shingles, least doc_id)} of (doc_id, text) rows."""
    sets = [frozenset(shingles(WORDS.findall(lower(t)))) for _, t in rows]
    having = collections.defaultdict(list)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in having[x]).items():
            if 100 * n >= pct * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for x in s:
            having[x].append(i)
    least = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return [(len(s), least.get(find(i))) for i, s in enumerate(sets)]


def repeated_bytes(texts, n, keep="none"):
    """The removed runs of each text (bytes); with keep="first" the first place in the given order stays."""
    places = collections.defaultdict(list)
    for k, t in enumerate(texts):
        for s in range(len(t) - n + 1):
            places[t[s : s + n]].append((k, s))
    flags = [bytearray(len(t)) for t in texts]
    for at in places.values():
        for k, s in at if keep == "none" else at[1:]:
            if len(at) > 1:
                flags[k][s : s + n] = b"\1" * n
    return [[(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(f))] for f in flags]


def digest(t, runs):
    kept, at = b"", 0
    for b, e in runs:
        kept, at = kept + t[at:b], e
    return len(t), sum(e - b for b, e in runs), len(runs), hashlib.sha256(kept + t[at:]).hexdigest()


def base_places(text, phrases):
    w = ALNUM.findall(lower(text))
    at, labels = [], set()
    for p, label in phrases.items():
        p = p.split()
        found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
        at += found
        if found:
            labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def leaks(docs, items, least=0.8):
    """{(doc_id, item_id): similarity} over windows of the item's size."""
    bags = {i: shingles(ALNUM.findall(lower(t))) for i, t in items if len(ALNUM.findall(lower(t))) >= 5}
    count = collections.Counter(x for s in bags.values() for x in set(s))
    weight = lambda x: 1 / count[x] if x in count else 1.0
    out = {}
    for d, t in docs:
        w = ALNUM.findall(lower(t))
        s = shingles(w) if len(w) >= 5 else []
        for i, bag in bags.items():
            if not set(bag) & set(s):
                continue
            width, own = min(len(bag), len(s)), collections.Counter(bag)
            for a in range(len(s) - width + 1):
                c = collections.Counter(s[a : a + width])
                both = sum(weight(x) * min(n, c[x]) for x, n in own.items())
                share = both / (sum(weight(x) * n for x, n in own.items()) + sum(weight(x) * n for x, n in c.items()) - both)
                if share >= least - 1e-9:
                    out[d, i] = max(out.get((d, i), 0), round(share, 6))
    return out


def crc(text):
    return zlib.crc32((text or "").encode())


def crc_remainder(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n
