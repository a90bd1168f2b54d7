"""Plain Python versions of the operators' contracts."""

import collections
import hashlib
import math
import re

UPPER = {c: c + 32 for c in range(65, 91)}
PLACES = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"


def licenses(text, phrases, templates, threshold):
    text = (text or "").translate(UPPER)
    words, places, base = re.findall(PLACES, text), [], set()
    for phrase, label in phrases:
        phrase = phrase.split()
        for i in range(len(words) - len(phrase) + 1):
            if words[i : i + len(phrase)] == phrase:
                places.append(i)
                base.add(label)
    labels, score = set(base), 1.0 if places else 0.0
    for statement, label in templates:
        listed = re.findall("[a-z0-9]+", statement.lower())
        wanted, block = set(listed), math.ceil(len(listed) / threshold - 1e-9)
        held = max((len(wanted.intersection(words[k : k + block])) for k in range(len(words))), default=0)
        if held >= math.ceil(threshold * len(wanted) - 1e-9):
            labels.add(label)
            score = max(score, held / len(wanted))
    ends = (min(places), max(places)) if places else (None, None)
    return (len(words), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score)


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def secrets(text):
    """Base spans as (start, kind, end)."""
    text, out = text or "", []
    out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ("assign", "access", "hex")
    return sorted(out, key=lambda s: (s[0], order.index(s[1])))


def spans_digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, k, z in spans).encode()).hexdigest()


def without_repeats(rows, window):
    texts = [re.findall(SPACED, t or "") for _, t in rows]
    least = {}
    for (ident, _), words in zip(rows, texts, strict=True):
        for k in range(len(words) - window + 1) if ident is not None else ():
            key = tuple(words[k : k + window])
            least[key] = min(least.get(key, ident), ident)
    out = []
    for (ident, _), words in zip(rows, texts, strict=True):
        gone = set()
        for k in range(len(words) - window + 1) if ident is not None else ():
            if least[tuple(words[k : k + window])] < ident:
                gone.update(range(k, k + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((ident, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingle_set(text, k):
    words = re.findall(SPACED, (text or "").translate(UPPER))
    if 0 < len(words) < k:
        return {tuple(words)}
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def components(nodes, linked):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_duplicates(rows, percent=80, k=5):
    sets = {i: shingle_set(t, k) for i, t in rows}
    holders, linked = collections.defaultdict(list), []
    for i, s in sets.items():
        shared = collections.Counter(j for g in s for j in holders[g])
        for g in s:
            holders[g].append(i)
        linked += [(i, j) for j, c in shared.items() if 100 * c >= percent * (len(s) + len(sets[j]) - c)]
    found = components(sets, linked)
    return [(i, len(s), found[i]) for i, s in sets.items()]


def edit_distance(pattern, text):
    """Least edits from the pattern to any run of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for w in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != w), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def search(docs, items, k=10):
    """(item, rank, doc, score) of whole-number scores; rows are documents of their own."""
    words = lambda t: re.findall(TERMS, (t or "").translate(UPPER))
    held = [(i, collections.Counter(words(t))) for i, t in docs]
    n = sum(bool(c) for _, c in held)
    total = sum(sum(c.values()) for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    wanted = collections.defaultdict(collections.Counter)
    for i, t in items:
        wanted[i].update(words(t))
    out = []
    for item, terms in wanted.items():
        scores = []
        for doc, c in held:
            if c and doc is not None:
                m = 25 + 75 * sum(c.values()) * n // total
                s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w, q in terms.items() if w in c)
                scores.append((-s, doc))
        out += [(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scores)[:k]) if s < 0]
    return out


def quality_counts(text, window=8):
    text = text or ""
    words = re.findall(SPACED, text)
    places = collections.defaultdict(list)
    for i in range(len(words) - window + 1):
        places[tuple(words[i : i + window])].append(i)
    covered = {p for at in places.values() if len(at) > 1 for i in at for p in range(i, i + window)}
    lines = [x for x in text.split("\n") if re.search(SPACED, x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines),
            sum("A" <= c <= "Z" for c in text), text.count("!"))


def on_grid(vector):
    return tuple(math.floor(64 * c) + 1_000_000 for c in vector)


def whitened(vectors, components=16):
    """(distinct x as a matrix, eigenvalues, unit eigenvectors as rows, trace) by the covariance itself."""
    import numpy as np

    x = np.array(sorted({on_grid(v) for v in vectors}), float)
    y = x - x.mean(0)
    values, directions = np.linalg.eigh(y.T @ y / len(y))
    return x, values[::-1][:components], directions.T[::-1][:components], values.sum()


def binomial_tail(k, n, p):
    from fractions import Fraction

    p = Fraction(p)
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(k, n) + 1)))
