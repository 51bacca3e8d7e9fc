"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def grams(text, k=5):
    words = WORD.findall(lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def linked_components(nodes, links):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def ngram(rows):
    sets = {i: grams(t) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    pairs = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    found = linked_components(sets, links)
    return sorted((i, len(s), found[i]) for i, s in sets.items())


def lines(rows):
    first, count = {}, defaultdict(set)
    key = lambda x: lower(x.strip(BLANKS))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(k := key(x)) >= 10:
                first[k] = min(first.get(k, i), i)
                count[k].add(i)
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not (len(k := key(x)) >= 10 and len(count[k]) > 1 and first[k] != i)]
        out.append((i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)
