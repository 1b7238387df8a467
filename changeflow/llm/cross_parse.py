"""Cross-parsing many texts at once against a suffix automaton.

The automaton of a training text is a flat table: an entry for each state and
byte holds the row of the next state and, in its lowest bit, whether a phrase
starts with that byte.  A byte without a transition starts a phrase at the
root, so a parse is one look-up a byte.

Texts are cut into lanes that are parsed side by side.  A lane does not know
where the phrase that crosses its start began, so it begins one of its own;
the lane before it parses on until one of its phrases starts where the other
has one too.  From there both are the same, as a phrase depends on its first
place alone.  Adding up the lanes up to where they meet gives exactly the
phrases of the uncut text.
"""

from __future__ import annotations

import numpy as np

LANE = 1024
PAD, UNKNOWN = 0, 1       # columns of the table


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``codes``, by state; 0 is the
    root, from which all its substrings can be read."""
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


class Automaton:
    """The flat suffix automaton of ``train`` (bytes without a NUL)."""

    def __init__(self, train: bytes):
        used = np.unique(np.frombuffer(train, np.uint8))
        self.code = np.full(256, UNKNOWN, np.uint8)
        self.code[used] = np.arange(2, 2 + len(used))
        self.code[0] = PAD
        go = suffix_automaton(self.code[np.frombuffer(train, np.uint8)].tolist())
        width = 2 + len(used)
        sizes = np.fromiter(map(len, go), np.int64, len(go))
        n = int(sizes.sum())
        state = np.repeat(np.arange(len(go)), sizes)
        symbol = np.fromiter((c for t in go for c in t), np.int64, n)
        target = np.fromiter((s for t in go for s in t.values()), np.int64, n)
        if len(go) * width >= 1 << 30:
            raise ValueError("the training text is too long for one table")
        fresh = np.ones(width, np.int32)                  # a byte at the start of a phrase
        fresh[symbol[state == 0]] = (target[state == 0] * width << 1) | 1
        fresh[PAD] = 0
        table = np.tile(fresh, (len(go), 1))
        inner = state != 0
        table[state[inner], symbol[inner]] = target[inner] * width << 1
        self.table = table.ravel()

    def phrases(self, lanes: Lanes) -> np.ndarray:
        """The number of phrases of each text."""
        rows, last = self.code[lanes.data], lanes.last
        at = np.zeros(rows.shape[1], np.int32)
        starts = np.empty(rows.shape, np.uint8)
        for i in range(len(rows)):
            at = self.table.take((at >> 1) + rows[i])
            np.bitwise_and(at, 1, out=starts[i], casting="unsafe")
        total = starts.sum(0, dtype=np.int64)
        # lanes that go on in the next: further starts, the lane met, its starts before
        n = len(total)
        more, met, before = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
        open_, to = np.flatnonzero(~last), np.flatnonzero(~last) + 1
        at = at[open_]
        while len(open_):
            skipped = np.zeros(len(open_), np.int64)
            for i in range(len(rows)):
                at = self.table.take((at >> 1) + rows[i, to])
                start, theirs = (at & 1).astype(bool), starts[i, to].astype(bool)
                meets = start & theirs
                if meets.any():
                    met[open_[meets]], before[open_[meets]] = to[meets], skipped[meets]
                    left = ~meets
                    open_, to, at, skipped, start, theirs = (x[left] for x in (open_, to, at, skipped, start, theirs))
                    if not len(open_):
                        break
                more[open_] += start
                skipped += theirs
            goes_on = ~last[to]
            open_, to, at = open_[goes_on], to[goes_on] + 1, at[goes_on]
        # follow the lanes of each text from its first
        own = total + more
        out = np.zeros(lanes.n_texts, np.int64)
        lane = lanes.first
        text = np.flatnonzero(lane >= 0)
        lane = lane[text]
        skipped = np.zeros(len(lane), np.int64)
        while len(lane):
            out[text] += own[lane] - skipped
            to = met[lane]
            skipped, text, lane = before[lane][to >= 0], text[to >= 0], to[to >= 0]
        return out


class Lanes:
    """Texts (bytes without a NUL) cut into lanes: ``data`` has a column a
    lane, padded with 0; ``first`` is the first lane of each text or -1."""

    def __init__(self, texts: list[bytes], lane: int = LANE):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        n = -(-sizes // lane)
        self.n_texts = len(texts)
        ends = np.cumsum(n)
        self.first = np.where(n > 0, ends - n, -1)
        total = int(ends[-1]) if len(ends) else 0
        self.last = np.zeros(total, bool)
        self.last[ends[n > 0] - 1] = True
        flat = np.zeros(total * lane, np.uint8)
        places = np.repeat((ends - n) * lane - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        flat[places] = np.frombuffer(b"".join(texts), np.uint8)
        self.data = np.ascontiguousarray(flat.reshape(total, lane).T)
