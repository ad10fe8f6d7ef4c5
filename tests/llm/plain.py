"""Plain versions of the operators' rules, for comparison."""

import hashlib
import re
from collections import Counter, defaultdict


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def shingles(tokens, k=5):
    return Counter(tuple(tokens[i : i + k]) for i in range(max(1, len(tokens) - k + 1))) if tokens else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def near_classes(rows, similar=0.8):
    """doc_id to class_id: equal texts and links of weighted shingle similarity, all pairs compared that share a shingle."""
    bags = {d: shingles(words(t)) for d, t in rows}
    parent = {d: d for d in bags}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)

    same, holders = {}, defaultdict(set)
    for d, t in rows:
        join(d, same.setdefault(t or "", d))
        for s in bags[d]:
            holders[s].add(d)
    for d in bags:
        for e in {e for s in bags[d] for e in holders[s] if e > d}:
            if similarity(bags[d], bags[e]) >= similar:
                join(d, e)
    return {d: top(d) for d in bags}


def leaks(rows, items, similar=0.8):
    """(doc_id, item_id) to the best similarity of any window of the item's size."""
    out = {}
    for item_id, text in items:
        item = words(text)
        if not item:
            continue
        bag = shingles(item)
        for d, t in rows:
            tokens = words(t)
            if not tokens or not (shingles(tokens).keys() & bag.keys() if len(item) >= 5 else set(item) & set(tokens)):
                continue
            n = len(item)
            best = max(similarity(shingles(tokens[i : i + n]), bag) for i in range(max(1, len(tokens) - n + 1)))
            if best >= similar:
                out[d, item_id] = best
    return out


_RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text):
    found = []
    for rank, (kind, rule) in enumerate(_RULES.items()):
        for m in rule.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and _luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), rank, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(found)]


def edited(rows):
    """doc_id to the sha256 of its edited text, rows in ascending doc_id."""
    out = {}
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(t) // 4
        out[d] = hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()
    return out
