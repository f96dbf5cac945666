"""Plain models of the operators, straight from their contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0d]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(_LOW)


def quality(text):
    text = text or ""
    w = SPACE_WORDS.findall(text)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if SPACE_WORDS.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated),
            len(w) < 10 or 100 * len(repeated) > 20 * len(w))


def secrets(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def license_base(text):
    w = WORDS.findall(lower(text))
    places, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def windows(items, size=10):
    out = defaultdict(set)
    for item, text in items:
        w = WORDS.findall(lower(text))
        for s in range(max(1, len(w) - size + 1) if w else 0):
            out[tuple(w[s:s + size])].add(str(item))
    return out


def contamination(text, found):
    w, hit, items = WORDS.findall(lower(text)), set(), set()
    for n in {len(k) for k in found}:
        for s in range(len(w) - n + 1):
            got = found.get(tuple(w[s:s + n]))
            if got:
                hit.update(range(s, s + n))
                items |= got
    return len(w), len(hit), sorted(items)


def shingle_set(text, size):
    w = SPACE_WORDS.findall(lower(text))
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def components(docs, size, percent):
    """doc_id -> (set size, smallest id reachable); docs: [(id, text)] with distinct ids."""
    sets = {i: shingle_set(t, size) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def cut(texts, length=200):
    """For each text: (bytes, removed, spans, kept bytes)."""
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[p:p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if n[b[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def pieces(tokenizer, doc_id, text, capacity=2048):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    return [(doc_id, k, s, len(ids[s:s + capacity]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[s:s + capacity])))
            for k, s in enumerate(range(0, len(ids), capacity))]


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# Vector codes

def vector_codes(rows, parts=16, entries=64, rounds=2):
    """[(vec_id, codes, error)] and codebooks by full rescans in plain integers; rows are (vec_id, label, vector)."""
    import math

    kept = [(i, label, v) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    if not kept:
        return [], []
    width = -(-len(kept[0][2]) // parts)
    whole = [[math.floor(256 * x) for x in v] + [0] * (parts * width - len(v)) for _, _, v in kept]
    cut = [[w[p * width:(p + 1) * width] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    for turn in range(rounds + 1):
        codes, errors = [], []
        for c in cut:
            best = [min((sum((a - b) ** 2 for a, b in zip(c[p], e)), i) for i, e in enumerate(books[p])) for p in range(parts)]
            codes.append([i for _, i in best])
            errors.append(sum(d for d, _ in best))
        if turn < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [c[p] for c, k in zip(cut, codes) if k[p] == e]
                    if own:
                        books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    return [(r[0], r[1], k, d) for r, k, d in zip(kept, codes, errors)], books


# Spelling variants

def edit_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    return any(a[:i] + a[i + (len(a) == len(b)):] == b[:i] + b[i + 1:] for i in range(len(b)))


def variants(rows, shortest=7, least=2, factor=10):
    """{word: (form, root, n, n_near, form_n)}; rows are (doc_id, text)."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(_LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= shortest and c >= least}
    near = {w: [v for v in words if edit_apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


# Language models

def symbol_sequence(text, symbol):
    """The symbols of a text: letters, and one border for each run of anything else."""
    out = [0, 0, 0]
    for c in text:
        s = symbol(c)
        if s or out[-1]:
            out.append(s)
    return out


def kneser_ney(sequences, symbols=64, order=4):
    """Probability of a symbol after others by the interpolated definition, from the training sequences."""
    counts = [None] * (order + 1)
    counts[order] = Counter(tuple(s[i - order + 1:i + 1]) for s in sequences for i in range(order - 1, len(s)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k in range(1, order + 1):
        ones, twos = (sum(c == x for c in counts[k].values()) for x in (1, 2))
        discount[k] = ones / (ones + 2 * twos) if ones else 0.5

    def probability(gram):
        k = len(gram)
        if k == 0:
            return 1 / symbols
        after = [c for g, c in counts[k].items() if g[:-1] == gram[:-1]]
        lower = probability(gram[1:])
        if not after:
            return lower
        d = discount[k]
        return (max(counts[k].get(gram, 0) - d, 0) + d * len(after) * lower) / sum(after)

    return probability
