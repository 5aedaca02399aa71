"""Plain single-machine versions to compare with."""

import hashlib
import re
from collections import Counter

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def repeats(texts, length):
    """(kept bytes, removed runs) of each text: bytes covered by a string that starts at two places or more."""
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone])), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, width=5):
    words = re.findall(rb"[^\x20\x09-\x0d]+", lower(text))
    return {tuple(words)} if 0 < len(words) < width else {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def groups(docs):
    """{doc_id: smallest identifier reachable by links} of (doc_id, text) rows."""
    sets = [(i, shingles(t)) for i, t in docs]
    label = {i: i for i, _ in docs}
    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def contamination(text, items, window=13):
    """(words, hit words, items that occur) of a text."""
    ws = WORD.findall(lower(text))
    hit, found = set(), set()
    for name, item in items:
        iw = WORD.findall(lower(item))
        k = min(window, len(iw))
        wins = {tuple(iw[i:i + k]) for i in range(len(iw) - k + 1)} if k else set()
        for j in range(len(ws) - k + 1) if k else ():
            if tuple(ws[j:j + k]) in wins:
                hit |= set(range(j, j + k))
                found.add(str(name))
    return len(ws), len(hit), sorted(found)
