"""Brute-force versions of the operators, in plain Python."""

from __future__ import annotations

import base64
import collections
import hashlib
import re

import public_tokenizers
import tiktoken

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_TO_Z = {i: i + 32 for i in range(65, 91)}


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def alnum(text):
    return ALNUM.findall((text or "").translate(A_TO_Z))


def spaced(text):
    return (text or "").encode().split()


def tokenizer():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def contamination(docs, items, size=10):
    """(doc_id, n_words, n_hit, sorted item ids) of each document."""
    windows = collections.defaultdict(set)
    for item, text in items:
        w = alnum(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[i:i + size])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = alnum(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc_id, len(w), len(hit), sorted(i for i in found if i is not None)))
    return out


def repeated_words(docs, size=35):
    """(doc_id, n_words, n_removed, kept words) of each document."""
    words = [spaced(t) for _, t in docs]
    seen = collections.Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (doc_id, _), w in zip(docs, words):
        covered = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                covered[i:i + size] = [True] * size
        kept = [x for x, c in zip(w, covered) if not c]
        out.append((doc_id, len(w), len(w) - len(kept), b" ".join(kept).decode()))
    return out


def shingles(text, width=4):
    w = spaced((text or "").translate(A_TO_Z))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def link_components(docs, width=4, percent=85):
    """(doc_id, n_shingles, component_id) of each document."""
    sets = [shingles(t, width) for _, t in docs]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    both = collections.Counter((a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k])
    parent = list(range(len(sets)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[top(b)] = top(a)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return [(doc_id, len(sets[i]), least.get(top(i))) for i, (doc_id, _) in enumerate(docs)]
