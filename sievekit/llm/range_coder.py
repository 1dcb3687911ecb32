"""Adaptive context-mixing range coder for token ids, many blocks at a time.

A block is a fixed number of ids and starts from an empty model, so blocks
are independent. Blocks are coded in lock step: one numpy step codes the next
id of every block. An id is coded as

* which prediction is right: the order-2 id (what followed the last two ids
  the last time), the order-1 id (what followed the last one), or neither.
  The three frequencies adapt per confidence of the two predictions, which
  is how the predictions are mixed;
* if neither, the order-0 model: the high byte as two 4-bit digits with
  adaptive frequencies (the second in the context of the first); the low
  byte goes as it is to the block's end, last byte first.

The coder keeps 64-bit ``low`` and ``range`` without carries and gives 16-bit
words. Ids are below 65,536.
"""

from __future__ import annotations

import numpy as np

TOP, BOT = np.uint64(1 << 48), np.uint64(1 << 32)
_W16, _W48 = np.uint64(16), np.uint64(48)
SLOTS = 1024
CONTEXTS, GAIN = 1 + 16, 12
MAX_CONF = 3
#: Blocks coded together at most.
LANES = 2048


class _Model:
    """Predictions and frequencies of ``lanes`` blocks."""

    def __init__(self, lanes: int) -> None:
        self.n = lanes
        self.row = np.arange(lanes)
        self.id1 = np.zeros(lanes * SLOTS, np.uint16)
        self.id2 = np.zeros(lanes * SLOTS, np.uint16)
        self.conf1 = np.zeros(lanes * SLOTS, np.uint8)
        self.conf2 = np.zeros(lanes * SLOTS, np.uint8)
        self.pick = np.full((lanes * 2 * (MAX_CONF + 1) ** 2, 3), (2, 2, 8), np.int32)
        self.digit = np.ones((lanes * CONTEXTS, 16), np.uint16)
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)

    def predict(self) -> None:
        self.s1 = self.row * SLOTS + ((self.last * 40503) >> 4) % SLOTS
        self.s2 = self.row * SLOTS + ((self.last * 40503 + self.before * 30011) >> 3) % SLOTS
        self.p1, self.p2 = self.id1[self.s1].astype(np.int64), self.id2[self.s2].astype(np.int64)
        self.c1, self.c2 = self.conf1[self.s1], self.conf2[self.s2]
        mode = (self.c2.astype(np.int64) * (MAX_CONF + 1) + self.c1) * 2 + (self.p1 == self.p2)
        self.ctx = self.row * (2 * (MAX_CONF + 1) ** 2) + mode
        self.freq = self.pick[self.ctx]

    def learn(self, ids: np.ndarray, which: np.ndarray) -> None:
        self.pick[self.ctx, which] += GAIN
        for slot, table, conf, p, c in ((self.s1, self.id1, self.conf1, self.p1, self.c1),
                                        (self.s2, self.id2, self.conf2, self.p2, self.c2)):
            hit = p == ids
            conf[slot] = np.where(hit, np.minimum(c + 1, MAX_CONF), c >> 1)
            table[slot] = np.where(hit | (c > 1), p, ids)
        self.before, self.last = self.last, ids

    def choose(self, ids: np.ndarray) -> np.ndarray:
        return np.where(self.p2 == ids, 0, np.where(self.p1 == ids, 1, 2))


def _narrow(low: np.ndarray, span: np.ndarray, cum: np.ndarray, freq: np.ndarray, tot: np.ndarray) -> None:
    r = span // tot
    low += cum * r
    np.multiply(r, freq, out=span)


def _shift(low: np.ndarray, span: np.ndarray, go: np.ndarray) -> None:
    """Move one word out of ``low`` where ``span`` is short; a span across a word's edge ends there."""
    a, s = low[go], span[go]
    s = np.where((a ^ (a + s)) < TOP, s, (np.uint64(0) - a) & (BOT - np.uint64(1)))
    low[go], span[go] = a << _W16, s << _W16


class _Writer:
    def __init__(self, lanes: int, steps: int) -> None:
        self.low, self.span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        self.out, self.at = np.zeros((lanes, steps * 3 + 8), np.uint16), np.zeros(lanes, np.int64)
        self.raw, self.raw_at = np.zeros((lanes, steps), np.uint8), np.zeros(lanes, np.int64)

    def put(self, lanes: np.ndarray, cum: np.ndarray, freq: np.ndarray, tot: np.ndarray) -> None:
        low, span = self.low[lanes], self.span[lanes]
        _narrow(low, span, cum.astype(np.uint64), freq.astype(np.uint64), tot.astype(np.uint64))
        go = np.flatnonzero(span < BOT)
        while len(go):
            to = lanes[go]
            self.out[to, self.at[to]] = low[go] >> _W48
            self.at[to] += 1
            _shift(low, span, go)
            go = go[span[go] < BOT]
        self.low[lanes], self.span[lanes] = low, span

    def close(self) -> list[bytes]:
        for _ in range(4):
            self.out[np.arange(len(self.low)), self.at] = (self.low >> _W48).astype(np.uint16)
            self.at += 1
            self.low <<= _W16
        return [self.out[k, :n].tobytes() + self.raw[k, :r][::-1].tobytes()
                for k, (n, r) in enumerate(zip(self.at, self.raw_at, strict=True))]


def encode_blocks(blocks: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Code each row of ``blocks`` (its first ``sizes`` ids); rows are sorted by falling size."""
    lanes, steps = blocks.shape
    m, w = _Model(lanes), _Writer(lanes, steps)
    live = lanes
    for t in range(steps):
        while live and sizes[live - 1] <= t:
            live -= 1
        if live < m.n:
            _shrink(m, live)
        ids = blocks[:live, t].astype(np.int64)
        m.predict()
        which = m.choose(ids)
        f = m.freq
        cum = np.where(which == 0, 0, np.where(which == 1, f[:, 0], f[:, 0] + f[:, 1]))
        w.put(m.row, cum, f[m.row, which], f.sum(1))
        miss = np.flatnonzero(which == 2)
        if len(miss):
            value = ids[miss]
            k, high = np.arange(len(miss)), value >> 12
            for rows, d in ((miss * CONTEXTS, high), (miss * CONTEXTS + 1 + high, (value >> 8) & 15)):
                f = m.digit[rows]
                c = np.cumsum(f, axis=1, dtype=np.uint32)
                own = f[k, d]
                w.put(miss, c[k, d] - own, own, c[:, 15])
                m.digit[rows, d] = own + np.uint16(GAIN)
            w.raw[miss, w.raw_at[miss]] = value & 255
            w.raw_at[miss] += 1
        m.learn(ids, which)
    return w.close()


def decode_blocks(payloads: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The inverse of :func:`encode_blocks`: rows of ids, filled up with 0."""
    lanes, steps = len(payloads), int(sizes.max(initial=0))
    words = np.zeros((lanes, max((len(p) for p in payloads), default=0) // 2 + 8), np.uint64)
    raw, raw_at = np.zeros((lanes, steps), np.uint8), np.zeros(lanes, np.int64)
    for k, p in enumerate(payloads):
        words[k, :len(p) // 2] = np.frombuffer(p, np.uint16, len(p) // 2)
        tail = np.frombuffer(p, np.uint8)[::-1][:steps]
        raw[k, :len(tail)] = tail
    out = np.zeros((lanes, steps), np.uint16)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    code = np.zeros(lanes, np.uint64)
    for k in range(4):
        code = (code << _W16) | words[:, k]
    at = np.full(lanes, 4, np.int64)
    m = _Model(lanes)
    live = lanes

    def value_of(some: np.ndarray, tot: np.ndarray) -> np.ndarray:
        tot = tot.astype(np.uint64)
        return np.minimum((code[some] - low[some]) // (span[some] // tot), tot - np.uint64(1)).astype(np.int64)

    def take(some: np.ndarray, cum: np.ndarray, freq: np.ndarray, tot: np.ndarray) -> None:
        a, s, x = low[some], span[some], code[some]
        _narrow(a, s, cum.astype(np.uint64), freq.astype(np.uint64), tot.astype(np.uint64))
        go = np.flatnonzero(s < BOT)
        while len(go):
            to = some[go]
            x[go] = (x[go] << _W16) | words[to, at[to]]
            at[to] += 1
            _shift(a, s, go)
            go = go[s[go] < BOT]
        low[some], span[some], code[some] = a, s, x

    for t in range(steps):
        while live and sizes[live - 1] <= t:
            live -= 1
        if live < m.n:
            _shrink(m, live)
        m.predict()
        f, tot = m.freq, m.freq.sum(1)
        v = value_of(m.row, tot)
        which = (v >= f[:, 0]).astype(np.int64) + (v >= f[:, 0] + f[:, 1])
        take(m.row, np.where(which == 0, 0, np.where(which == 1, f[:, 0], f[:, 0] + f[:, 1])), f[m.row, which], tot)
        ids = np.where(which == 0, m.p2, m.p1)
        miss = np.flatnonzero(which == 2)
        if len(miss):
            k, seen, rows = np.arange(len(miss)), np.zeros(len(miss), np.int64), miss * CONTEXTS
            for level in range(2):
                rows = rows + level * (1 + seen)
                f = m.digit[rows]
                c = np.cumsum(f, axis=1, dtype=np.uint32)
                d = (c <= value_of(miss, c[:, 15])[:, None]).sum(1)
                own = f[k, d]
                take(miss, c[k, d] - own, own, c[:, 15])
                m.digit[rows, d] = own + np.uint16(GAIN)
                seen = (seen << 4) | d
            ids[miss] = (seen << 8) | raw[miss, raw_at[miss]]
            raw_at[miss] += 1
        out[:live, t] = ids
        m.learn(ids, which)
    return out


def _shrink(m: _Model, live: int) -> None:
    """Leave out the blocks that are done; the tables are laid out by block."""
    m.n, m.row, m.last, m.before = live, m.row[:live], m.last[:live], m.before[:live]
