"""The operators restated over plain Python lists, for small tables."""

import re
from collections import Counter, defaultdict

BLANK = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def shingles(text, n=5):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def components(rows, percent=85):
    """rows: (id, text). Smallest linked id of each id."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(k)
    seen = set()
    for group in where.values():
        for a in range(len(group)):
            for b in range(a):
                seen.add((group[b], group[a]))
    for a, b in seen:
        (i, s), (j, t) = sets[a], sets[b]
        common = len(s & t)
        if 100 * common >= percent * (len(s) + len(t) - common):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def kept_lines(rows, min_docs=10, min_chars=1, keep="none"):
    """rows: (id, text). List of (id, text, n_lines, n_dropped, kept text), one per row."""
    docs = defaultdict(set)
    first = {}
    key = lambda line: lower(line).strip(BLANK)
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in order:
        for pos, line in enumerate(t.split("\n")):
            if len(key(line)) >= min_chars:
                docs[key(line)].add((i, t))
                first.setdefault(key(line), (i, t, pos))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(docs[key(x)]) >= min_docs and (keep == "none" or first[key(x)] != (i, t or "", p)) for p, x in enumerate(lines)]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, t, len(lines), sum(gone), kept))
    return out


def benchmark_hits(text, items, window=10):
    """items: (item id, text). (n_words, hit word positions, item ids as text)."""
    w = plain_words(text)
    hit, found = set(), set()
    for item, t in items:
        g = plain_words(t)
        n = min(len(g), window)
        for k in range(len(g) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == g[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(w), sorted(hit), sorted(found)


def statistics(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    dup = sum(n - 1 for n in Counter(lines).values())
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def detections(text, rules):
    """Labels of the rules' matches that no earlier, no less sure match contains."""
    norm = " " + " ".join(plain_words(text)) + " "
    present = set(plain_words(text))
    found = []
    for n, r in enumerate(rules):
        if all(present & set(one) for one in r.keywords):
            found += [(m.start(), -m.end(), r.priority, n, r) for m in re.finditer(r.pattern, norm)]
    out, earlier = [], []
    for start, end, priority, _, rule in sorted(found, key=lambda f: f[:4]):
        if not any(p <= priority and e >= -end for e, p in earlier):
            out.append(rule)
        earlier.append((-end, priority))
    return out
