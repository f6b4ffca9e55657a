"""What the operators must give, computed row by row in plain Python."""

from __future__ import annotations

import re

SPACE = re.compile("[^\x20\x09-\x0d]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return SPACE.findall((text or "").translate(UPPER))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def least(ids, linked):
    """Smallest id that links reach, by id; linked(a, b) for a before b."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(root)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def jaccard(texts):
    sets = {i: shingles(t) for i, t in texts.items()}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)
    return {i: len(s) for i, s in sets.items()}, least(sets, linked)


def repeats(texts, span=50):
    """(bytes, bytes removed, spans, bytes kept) by id."""
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone, new = bytearray(len(b)), []
        for at in range(len(b) - span + 1):
            w = b[at:at + span]
            if w in seen:
                gone[at:at + span] = b"\1" * span
            new.append(w)
        seen.update(new)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])),
                  bytes(x for x, g in zip(b, gone) if not g))
    return out
