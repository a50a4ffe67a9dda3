"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import collections
import re


def words(text):
    return (text or "").encode().lower().split()


def near_components(docs, percent=85):
    """doc_id -> (size of its last set, smallest reachable doc_id); an id may have several texts."""
    sets = []
    for i, t in docs:
        w = words(t)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[n + 1 :]:
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (len(x), find(i)) for i, x in sets}


def base_statistics(text):
    w = (text or "").encode().split()
    count = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = set()
    for k in range(len(w) - 2):
        if count[w[k], w[k + 1], w[k + 2]] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(map((text or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered)


def benchmark_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def contamination(docs, items, window=10):
    """doc_id -> (n_words, n_hit, item ids)."""
    grams = collections.defaultdict(set)
    for item, text in items:
        w = benchmark_words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[k : k + n])].add(str(item))
    sizes = {len(g) for g in grams}
    out = {}
    for i, text in docs:
        w, hit, found = benchmark_words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := grams.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out[i] = (len(w), len(hit), sorted(found))
    return out


def repeated_words(rows, window, least):
    """doc_id -> places in windows of so many words, the first and last being equal, of which ``least`` or more equal those of an earlier document, word
    for word, on one diagonal."""
    import numpy as np

    codes = {}
    texts = [(i, np.array([codes.setdefault(w, len(codes)) for w in words])) for i, words in sorted(rows)]
    out = {i: set() for i, _ in texts}
    for n, (i, a) in enumerate(texts):
        for _, b in texts[:n]:
            for shift in range(-len(b) + window, len(a) - window + 1):
                x, y = a[max(0, shift) :], b[max(0, -shift) :]
                m = min(len(x), len(y))
                same = x[:m] == y[:m]
                if same.sum() >= least:
                    run = np.concatenate([[0], np.cumsum(same)])
                    for s in np.flatnonzero((run[window:] - run[:-window] >= least) & same[: m - window + 1] & same[window - 1 :]):
                        out[i].update(range(max(0, shift) + int(s), max(0, shift) + int(s) + window))
    return out


def url_verdicts(pages, links, redirects, rules):
    """page id -> verdict; links (page url, link as written) and redirects (a, b) make aliases."""
    from urllib.parse import urljoin, urlsplit

    def node(u):
        p = urlsplit(urljoin(u, urlsplit(u).path or "/") if "/." in u else u)
        return f"{p.scheme.lower()}://{p.netloc.lower()}{p.path or '/'}" + (f"?{urlsplit(u).query}" if urlsplit(u).query else "")

    def rule(u):
        host, path = urlsplit(u).netloc.lower(), urlsplit(u).path
        fits = [(len(h + p), v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def link(a, b):
        x, y = sorted((find(a), find(b)))
        parent[y] = x

    for u, written in links:
        if "://" in urljoin(u, written):
            link(node(u), node(urljoin(u, written)))
    for a, b in redirects:
        link(node(a), node(b))
    blocked = {find(x) for x in list(parent) if rule(x) == "block"}
    out = {}
    for i, u, _ in pages:
        known = u and "://" in u
        out[i] = (known and rule(u)) or ("block" if known and node(u) in parent and find(node(u)) in blocked else "allow")
    return out


def good(text, rules):
    """Whether a text passes the base rules and a decision list of (terms, verdict)."""
    n, chars, symbols, dup, repeat = base_statistics(text)
    if n < 50 or 100 * repeat > 50 * n:
        return False
    n_lines = sum(1 for x in (text or "").split("\n") if x.encode().split())
    share = lambda a, b: int(100 * a / b) if b else 0
    row = {"n_words": n, "mean_word_100": share(chars, n), "symbols_100": share(symbols, n), "dup_lines_100": share(dup, n_lines), "repeat_100": share(repeat, n)}
    for rule in rules:
        if all(row[t.feature] <= t.value if t.op == "<=" else row[t.feature] > t.value for t in rule.terms):
            return rule.verdict
    return True


def without_boilerplate(docs, ratio, least):
    """doc_id -> text without the lines on more than ``ratio`` of their host's pages, and at least ``least``."""
    pages, lines = collections.Counter(), collections.Counter()
    for _, host, text in docs:
        pages[host] += 1
        lines.update({(host, x.strip(" ")) for x in (text or "").split("\n") if x.strip(" ")})
    bad = {k for k, n in lines.items() if n >= least and n > ratio * pages[k[0]]}
    return {i: text if text is None else "\n".join(x for x in text.split("\n") if (host, x.strip(" ")) not in bad) for i, host, text in docs}
