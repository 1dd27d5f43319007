"""Plain single-process versions of the operators, for small inputs."""

import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def near_duplicates(docs, percent=85):
    """docs: (id, text), ids unique -> id: (n, root)."""
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(d for d in sets if sets[d])
    links = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[:i]
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    r = roots(sets, links)
    return {d: (len(sets[d]), r[d]) for d in sets}


def dedup_lines(docs, least=10):
    """docs: (id, text) -> list of (id, n_lines, n_dropped, text), in order."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    first, holders = {}, {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            k = key(x)
            if len(k) >= least:
                holders.setdefault(k, set()).add(d)
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or first[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def contamination(docs, items, window=10):
    """docs, items: (id, text) -> sorted list of (id, n_words, n_hit, sorted item ids)."""
    found = {}
    for item, text in items:
        w = bench_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            found.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for d, text in docs:
        w = bench_words(text)
        hit, ids = set(), set()
        for n in {len(k) for k in found}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in found:
                    hit |= set(range(i, i + n))
                    ids |= found[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), sorted(ids)))
    return out


def repeated(texts, length=200):
    """(n_removed, n_spans, kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def proximity(docs, items, slop, share=0.8):
    """{(doc_id, item_id): [(start, stop, n_terms)]}: every window of (1 + slop) * n words, those that overlap as one place."""
    out = {}
    for item_id, text in items:
        w = bench_words(text)
        span, need = len(w) * (1 + slop), -(-len(set(w)) * round(share * 100) // 100)
        for doc_id, body in docs:
            d = bench_words(body) if w else []
            at = [p for p, x in enumerate(d) if x in set(w)]
            places = []
            for p in at:
                inside = [q for q in at if p <= q < p + span]
                n = len({d[q] for q in inside})
                if n < need:
                    continue
                if places and p < places[-1][3] + span:
                    a, stop, m, _ = places[-1]
                    places[-1] = (a, max(stop, inside[-1] + 1), max(m, n), p)
                else:
                    places.append((p, inside[-1] + 1, n, p))
            if places:
                out[doc_id, item_id] = [x[:3] for x in places]
    return out
