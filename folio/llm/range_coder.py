"""Adaptive context-mixing range coder for token ids, many blocks in lockstep.

The blocks of a call share one model, which starts empty. The next id is predicted by order 2 and order 1 (each context
keeps one candidate and how often it came) and by order 0 (frequencies of whole ids). Of the two candidates the one that
came more often is tried; how far it is trusted is mixed by adaptive counts for each pair of the two contexts' shares. An
id that isn't the candidate is coded by order 0; one that order 0 doesn't know yet by an escape and a fixed prior that
falls with the id, since tokenizers number pieces by merge rank. All blocks advance by one id per step, as numpy vectors
over the blocks. The model stands still within a round of steps (1, 1, 2, 4, ... then REFRESH) and then learns all its ids
at once, so it is small, stays in the processor's cache, and the encoder looks up a whole round together.

The range coder keeps 48 bits; it puts out 24 bits at a time, at most once per coded symbol. A put-out digit may hold
a carry (25 bits), which is passed on at the end.
"""

from __future__ import annotations

import numpy as np

MOST_IDS = 1 << 16
CONTEXTS2 = 1 << 18
#: a block has at most half as many ids as this
LONGEST = 1 << 14
#: a context's share of hits, in this many steps; 0 is no candidate
SHARES = 16
#: slots of the order-0 table, and steps of a round in the end
SLOT_BITS, REFRESH = 17, 256
SLOTS = 1 << SLOT_BITS
#: of 1 << HIT_BITS, what a candidate gets at most
HIT_BITS, MOST_HIT = 12, (1 << 12) - (1 << 6)
_TOP = 1 << 24
_FIRST = np.int64(1 << 48)
#: the prior of ids that the model hasn't seen, out of 1 << _PRIOR_BITS: falling as 1 / (id + 16)
_PRIOR_BITS = 20
_prior = 1 + (((1 << _PRIOR_BITS) - MOST_IDS) * (1 / (np.arange(MOST_IDS) + 16)) / (1 / (np.arange(MOST_IDS) + 16)).sum()).astype(np.int64)
_prior[0] += (1 << _PRIOR_BITS) - _prior.sum()
_PRIOR_START = np.cumsum(_prior) - _prior


def _rounds(steps: int) -> list[tuple[int, int]]:
    ends = [0, *(1 << k for k in range(REFRESH.bit_length())), *range(2 * REFRESH, steps + REFRESH, REFRESH)]
    return [(a, min(b, steps)) for a, b in zip(ends, ends[1:], strict=False) if a < steps]


class _Order:
    """One candidate for each of n contexts: `best` is its share of hits << 16 | id."""

    def __init__(self, n: int) -> None:
        self.best = np.zeros(n, np.int32)
        self.hits, self.tries = np.zeros(n, np.int32), np.zeros(n, np.int32)

    def learn(self, context: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.best)
        self.tries += np.bincount(context, minlength=n).astype(np.int32)
        named = self.best & (MOST_IDS - 1)
        named[self.best == 0] = -1
        self.hits += np.bincount(context[named[context] == ids], minlength=n).astype(np.int32)
        # a candidate that came less than once in eight times gives way to the context's latest id
        latest = np.full(n, -1, np.int32)
        latest[context] = ids
        weak = (latest >= 0) & (self.hits < self.tries / 8)
        self.hits[weak], self.tries[weak] = 0, 0
        named[weak] = latest[weak]
        share = 1 + (SHARES - 2) * (2 * self.hits.astype(np.int64) + 1) // (2 * self.tries.astype(np.int64) + 4)
        self.best = np.where(named >= 0, share << 16 | named, 0).astype(np.int32)


class _Model:
    def __init__(self) -> None:
        self.order1, self.order2 = _Order(MOST_IDS), _Order(CONTEXTS2)
        self.mix = np.tile(np.array([[1], [4]], np.int64), SHARES * SHARES)
        self.count = np.zeros(MOST_IDS, np.int64)
        self._deal()

    def _deal(self) -> None:
        """Deal SLOTS among the known ids by their counts: one at least to each, and to the escape what those seen once
        would get."""
        known, total = np.count_nonzero(self.count), int(self.count.sum())
        escape = SLOTS
        if total:
            once = max(np.count_nonzero(self.count == 1), 1)
            escape = max(SLOTS >> 12, once * (SLOTS - known) // (total + once))
        self.size = self.count * max(SLOTS - escape - known, 0) // max(total, 1) + (self.count > 0)
        self.escape = SLOTS - int(self.size.sum())
        self.start = self.escape + np.cumsum(self.size) - self.size
        hits, tries = self.mix
        self.hit = np.minimum((hits << HIT_BITS) // tries, MOST_HIT)
        self.hit.reshape(SHARES, SHARES)[0, 0] = 0

    def symbols(self) -> np.ndarray:
        """By slot, its id (0 in the escape's slots): what a decoder needs beside the table."""
        return np.repeat(np.arange(-1, MOST_IDS).clip(0).astype(np.uint16), np.append(self.escape, self.size))

    def learn(self, ids: np.ndarray, last: np.ndarray, context2: np.ndarray) -> None:
        """A round's ids, each with the id before it and its order-2 context."""
        candidate, trust = self.predict(self.order1.best[last], self.order2.best[context2])
        hit = (candidate == ids) & (trust > 0)
        n = SHARES * SHARES
        self.mix += np.stack([np.bincount(trust[hit], minlength=n), np.bincount(trust, minlength=n)])
        self.count += np.bincount(ids[~hit], minlength=MOST_IDS)
        self.order1.learn(last, ids)
        self.order2.learn(context2, ids)
        self._deal()

    @staticmethod
    def predict(best1: np.ndarray, best2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidate, and the pair of shares by which it is trusted."""
        return np.maximum(best1, best2) & (MOST_IDS - 1), (best1 >> 16) * SHARES + (best2 >> 16)


def _context2(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    # the sum stays below 2 ** 31
    return (last * 20251 + before * 12345 >> 3) & (CONTEXTS2 - 1)


def _sorted(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort([-s for s in sizes], kind="stable")
    return order, np.array([sizes[k] for k in order])


def _live(sizes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """How many blocks still go on at each step."""
    return np.searchsorted(-sizes, -steps, "left")


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded bytes of each block of ids below MOST_IDS (a block has at most LONGEST // 2 of them); results in the blocks' order."""
    if not len(blocks):
        return []
    order, sizes = _sorted([len(b) for b in blocks])
    if 2 * sizes[0] > LONGEST:
        raise ValueError(f"a block of {sizes[0]} ids is too long")
    n, steps = len(blocks), int(sizes[0])
    # two rows of zeros stand before the first ids
    ids = np.zeros((steps + 2, n), np.int32)
    for k, o in enumerate(order):
        ids[2 : 2 + sizes[k], k] = blocks[o]
    model, low, width = _Model(), np.zeros(n, np.int64), np.full(n, _FIRST)
    room = 2 * steps + 8
    digits = np.zeros(n * room, np.int32)
    cursor = np.arange(n) * room
    low_bits = _TOP - 1

    def carry_on(which: np.ndarray) -> None:
        at, old = cursor[which], low[which]
        digits[at] = old >> 24
        cursor[which] = at + 1
        low[which] = (old & low_bits) << 24
        width[which] <<= 24

    for a, b in _rounds(steps):
        live = _live(sizes, np.arange(a, b))
        m = int(live[0])
        x, last, context2 = ids[a + 2 : b + 2, :m], ids[a + 1 : b + 1, :m], _context2(ids[a + 1 : b + 1, :m], ids[a:b, :m])
        candidate, trust = model.predict(model.order1.best[last], model.order2.best[context2])
        part = model.hit[trust]
        hit = (candidate == x) & (part > 0)
        start, size = model.start[x], model.size[x]
        escaped = ~hit & (size == 0)
        any_escaped = escaped.any(1)
        start[escaped], size[escaped] = 0, model.escape
        for t, go in enumerate(live.tolist()):
            w, l = width[:go], low[:go]
            h = hit[t, :go]
            bound = (w >> HIT_BITS) * part[t, :go]
            r = w - bound >> SLOT_BITS
            l += np.where(h, 0, bound + r * start[t, :go])
            w[:] = np.where(h, bound, r * size[t, :go])
            carry_on(np.flatnonzero(w < _TOP))
            if any_escaped[t]:
                at = np.flatnonzero(escaped[t, :go])
                named = x[t, at]
                r = width[at] >> _PRIOR_BITS
                low[at] += r * _PRIOR_START[named]
                width[at] = r = r * _prior[named]
                carry_on(at[r < _TOP])
        if b < steps:
            if live[-1] < m:
                there = np.arange(m) < live[:, None]
                model.learn(x[there], last[there], context2[there])
            else:
                model.learn(x.ravel(), last.ravel(), context2.ravel())
    for _ in range(2):
        carry_on(np.arange(n))
    filled, digits = cursor - np.arange(n) * room, digits.reshape(n, room)[:, : int((cursor - np.arange(n) * room).max())]
    for j in range(digits.shape[1] - 1, 0, -1):
        digits[:, j - 1] += digits[:, j] >> 24
    out: list[bytes] = [b""] * n
    for k, o in enumerate(order):
        out[o] = digits[k, : filled[k]].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return out


def decode(coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each block, given how many it has: all blocks of one call of encode, in their order."""
    if not len(coded):
        return []
    order, many = _sorted(sizes)
    n, steps = len(coded), int(many[0])
    room = max(len(c) for c in coded) // 3 + 4
    words = np.zeros((n, room), np.int32)
    for k, o in enumerate(order):
        w = np.zeros((len(coded[o]) // 3, 4), np.uint8)
        w[:, :3] = np.frombuffer(coded[o], np.uint8, 3 * len(w)).reshape(-1, 3)
        words[k, : len(w)] = w.view("<u4").ravel()
    code = words[:, 0].astype(np.int64) << 24 | words[:, 1]
    words = words.ravel()
    model, width, cursor = _Model(), np.full(n, _FIRST), np.arange(n) * room + 2
    ids = np.zeros((steps + 2, n), np.int32)

    def carry_on(which: np.ndarray) -> None:
        at = cursor[which]
        code[which] = code[which] << 24 | words.take(at, mode="clip")
        cursor[which] = at + 1
        width[which] <<= 24

    for a, b in _rounds(steps):
        live = _live(many, np.arange(a, b))
        best1, best2, parts, starts, named_by, escape = model.order1.best, model.order2.best, model.hit, model.start, model.symbols(), model.escape
        slot_sizes = model.size
        for t, go in zip(range(a, b), live.tolist(), strict=True):
            w, c = width[:go], code[:go]
            last = ids[t + 1, :go]
            candidate, trust = model.predict(best1.take(last), best2.take(_context2(last, ids[t, :go])))
            bound = (w >> HIT_BITS) * parts.take(trust)
            hit = c < bound
            rest = c - bound
            r = w - bound >> SLOT_BITS
            # all below 2 ** 48, so a floating-point quotient is cut to the exact whole number
            slot = (rest / r).astype(np.int64)
            x = named_by.take(slot, mode="clip").astype(np.int32)
            start, size = starts.take(x), slot_sizes.take(x)
            out = np.flatnonzero((slot < escape) > hit)
            if out.size:
                start[out], size[out] = 0, escape
            c[:] = np.where(hit, c, rest - r * start)
            w[:] = np.where(hit, bound, r * size)
            carry_on(np.flatnonzero(w < _TOP))
            if out.size:
                r = width[out] >> _PRIOR_BITS
                named = np.searchsorted(_PRIOR_START, np.minimum(code[out] // r, (1 << _PRIOR_BITS) - 1), "right") - 1
                code[out] -= r * _PRIOR_START[named]
                width[out] = r = r * _prior[named]
                x[out] = named
                carry_on(out[r < _TOP])
            ids[t + 2, :go] = np.where(hit, candidate, x)
        if b < steps:
            x, last, before = (ids[a + k : b + k, : live[0]] for k in (2, 1, 0))
            if live[-1] < live[0]:
                there = np.arange(live[0]) < live[:, None]
                x, last, before = x[there], last[there], before[there]
            model.learn(x.ravel(), last.ravel(), _context2(last, before).ravel())
    out_ids: list[np.ndarray] = [np.empty(0, np.uint16)] * n
    for k, o in enumerate(order):
        out_ids[o] = ids[2 : 2 + many[k], k].astype(np.uint16)
    return out_ids
