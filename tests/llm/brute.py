"""Plain single-threaded versions to compare against."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(8)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": dup, "n_repeat_words": len(covered)}


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k=3):
    words = WORD.findall(lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def jaccard(texts: dict, k=3, least=90):
    """As the query of operator 7 has it; the pipeline's stage takes 5 words and 80 percent."""
    sets = {d: shingles(t, k) for d, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    part = components(sets, links)
    return {d: (len(sets[d]), part[d]) for d in sets}


def repeats(texts: dict):
    first, out = {}, {}
    split = {d: WORD.findall(t or "") for d, t in texts.items()}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    for d, w in split.items():
        cut = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                cut.update(range(i, i + 50))
        out[d] = (len(w), len(cut), sha(" ".join(x for i, x in enumerate(w) if i not in cut)))
    return out
