"""An adaptive context-mixing range coder for token ids, in independent checksummed blocks.

Model.  For each id, an order-2 and an order-1 context (hashed tables of one block) each
predict one id with a confidence, and order 0 predicts every id by its share of the block's
ids so far, as they were at the last of the ``snapshots``; what none of them has is coded
evenly over the vocabulary.  The four are mixed with weights that adapt for each pair of
confidences: P(x) = w2 [x = p2] + w1 [x = p1] + w0 n(x) / t + we / vocabulary.  The first of
them that holds an id codes it.  Weights are renewed every ``RENEW`` ids from what held in
the block so far, of which older ids count less.  Everything starts anew in each block.

Coder.  48-bit range coder with carries, 16 bits out at a time.  Its state is kept in doubles,
which hold whole numbers below 2 ** 53 exactly, so quotients are exact too.  Blocks are
independent, so many are coded in step as lanes of numpy arrays, ``LANES`` at most; the bytes
do not depend on how many.  Words lie by place, then by lane, as lanes are at much the same place.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids in a block.
BLOCK = 2048
#: Blocks that are coded in step.
LANES = 4096
#: Ids after which the weights are renewed.
RENEW = 128
#: Ids that a range of 32 bits can be dealt to after the weights' share.
MOST_IDS = 1 << 20
_SLOTS2, _SLOTS1 = 256, 128
_TOP, _WORD, _FULL = 2.0**32, 65536.0, 2.0**48
#: What the four weights add up to, and the bits of a field that holds an end of their shares.
_ONE, _FIELD = 2048, 12
_MASK = (1 << _FIELD) - 1
#: A bit above each of the three inner ends, and a 1 in each of their fields.
_GUARD, _EACH = (sum(1 << i * _FIELD + at for i in (1, 2, 3)) for at in (_FIELD - 1, 0))
#: An id, the start of its share and the share's size in one number.
_ID, _START = 36, 12


def snapshots(block: int) -> list[int]:
    """Places in a block at which order 0 is renewed; they thin out as it grows."""
    found, t = [], 16
    while t < block:
        found.append(t)
        t *= 2
    return found


def _first_counts() -> np.ndarray:
    """What counts for each weight at first, by order-2 confidence and order-1 confidence (0: nothing, 1: seen, 3: held)."""
    rows = []
    for at in range(16):
        k2, k1 = at >> 2, at & 3
        rows.append([2 + 6 * k2 if k2 else 0, 2 + 4 * k1 if k1 else 0, 8, 8])
    return np.array(rows) / 4


class _Model:
    """Tables and weights of the lanes; arrays of one place have a lane in each column."""

    def __init__(self, lanes: int):
        self.rows = np.arange(lanes) * 16
        self.base = np.stack([np.arange(lanes) * _SLOTS1, lanes * _SLOTS1 + np.arange(lanes) * _SLOTS2])
        self.mask = np.array([[_SLOTS1 - 1], [_SLOTS2 - 1]], np.int32)
        self.table = np.full(lanes * (_SLOTS1 + _SLOTS2), -4, np.int32)  # id * 4 + confidence, first all of order 1, then all of order 2
        self.counts = np.zeros((lanes * 16, 4))
        self.first = np.tile(_first_counts(), (lanes, 1))
        self._weigh()

    def _weigh(self) -> None:
        """Ends of the four shares of ``_ONE`` in the fields of one number; each share is 1 at least."""
        ends = np.cumsum(self.first + self.counts, axis=1)
        ends *= (_ONE - 4) / ends[:, 3:]
        ends = ends.astype(np.int64) + np.array([1, 2, 3, 4])
        self.packed = (ends[:, 0] << _FIELD) + (ends[:, 1] << 2 * _FIELD) + (ends[:, 2] << 3 * _FIELD) + (_ONE << 4 * _FIELD)

    def renew(self, row: np.ndarray, outcome: np.ndarray) -> None:
        """Counts what held in the last places."""
        self.counts *= 0.75
        self.counts += np.bincount((row * 4 + outcome).ravel(), minlength=self.counts.size).reshape(self.counts.shape)
        self._weigh()

    def state(self, e: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows of the weights for entries of both tables (a first axis of two)."""
        k = e & 3
        return rows + ((k[1] << 2) + k[0])

    def learn(self, i: np.ndarray, e: np.ndarray, x: np.ndarray) -> None:
        x4 = x << 2
        self.table[i] = np.where(e & -4 == x4, e | 2, x4 | 1)


def _hashes(c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """Hashes of the order-1 and order-2 contexts (a first axis of two)."""
    found = np.empty((2, *c1.shape), np.int32)
    h = c1 * np.int32(40503)
    np.right_shift(h, 7, out=found[0])
    h += c2 * np.int32(30011)
    np.right_shift(h, 6, out=found[1])
    return found


class _Writer:
    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes), np.full(lanes, _FULL)
        self.lanes = lanes
        self.out = np.zeros(lanes * (2 * steps + 4), np.int32)  # words x lanes; carries are left above a word's 16 bits
        self.next = np.arange(lanes)

    def put(self, n: int, shares: np.ndarray) -> None:
        """``shares`` of the first ``n`` lanes: start and size in ``_ONE``, then start, size and total within that share."""
        start, size, start2, size2, total2 = shares[:, :n]
        low, rng, following = self.low[:n], self.range[:n], self.next[:n]
        r = np.floor(rng * (1 / _ONE))
        low += r * start
        r *= size
        r /= total2
        np.floor(r, out=r)
        low += r * start2
        np.multiply(r, size2, out=rng)
        full = rng < _TOP
        word = np.floor(low * (1 / _TOP))
        self.out[following] = word.astype(np.int32)  # where the range is still wide, the next word replaces it
        following += full * self.lanes
        by = full * (_WORD - 1) + 1
        word *= full * _TOP
        low -= word
        low *= by
        rng *= by
        (full,) = (rng < _TOP).nonzero()
        while len(full):
            part, at = low.take(full), following.take(full)
            word = np.floor(part * (1 / _TOP))
            self.out[at] = word
            following[full] = at + self.lanes
            low[full] = (part - word * _TOP) * _WORD
            left = rng.take(full) * _WORD
            rng[full] = left
            full = full[left < _TOP]

    def close(self) -> list[bytes]:
        """One more word fixes a point inside of the last range."""
        self.out[self.next] = np.floor((self.low + (_TOP - 1)) / _TOP)
        sizes = self.next // self.lanes + 1
        words = self.out.reshape(-1, self.lanes)[: int(sizes.max())]
        words[np.arange(len(words))[:, None] >= sizes] = 0
        while (over := words >> 16).any():
            words &= 0xFFFF
            words[:-1] += over[1:]
        raw = words.T.astype("<u2", order="C")
        return [w[:n].tobytes() for w, n in zip(raw, sizes.tolist(), strict=True)]


class _Reader:
    def __init__(self, payloads: list[bytes]):
        width = max(map(len, payloads)) // 2 + 4
        words = np.zeros((len(payloads), width), np.uint16)
        for i, p in enumerate(payloads):
            words[i, : len(p) // 2] = np.frombuffer(p, "<u2")
        self.words, w, self.lanes = words.T.ravel(), words[:, :3].astype(float), len(payloads)
        self.next = np.arange(3 * self.lanes, 4 * self.lanes)
        self.code = w[:, 0] * _TOP + w[:, 1] * _WORD + w[:, 2]
        self.range = np.full(len(payloads), _FULL)

    def get(self, n: int, total) -> np.ndarray:
        self.r = np.floor(self.range[:n] / total)
        v = self.code[:n] / self.r
        return np.minimum(v, total - 1, out=v).astype(np.int64)

    def take(self, n: int, start: np.ndarray, size: np.ndarray) -> None:
        self.code[:n] -= self.r * start
        np.multiply(self.r, size, out=self.range[:n])

    def fill(self, n: int) -> None:
        code, rng, following = self.code[:n], self.range[:n], self.next[:n]
        full = rng < _TOP
        by = full * (_WORD - 1) + 1
        code *= by
        code += self.words.take(following, mode="clip") * full
        rng *= by
        following += full * self.lanes
        (full,) = (rng < _TOP).nonzero()
        while len(full):
            at = following.take(full)
            code[full] = code.take(full) * _WORD + self.words.take(at, mode="clip")
            following[full] = at + self.lanes
            left = rng.take(full) * _WORD
            rng[full] = left
            full = full[left < _TOP]


def _steps(sizes: np.ndarray):
    """For each place in a block the number of lanes that reach it (sizes must not ascend)."""
    return [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]))]


def _dense(table: np.ndarray) -> np.ndarray:
    """The rank of each id among the different ones of its lane (table: lanes x places)."""
    order = np.argsort(table, axis=1, kind="stable")
    order += np.arange(len(table))[:, None] * table.shape[1]
    ascending = table.ravel().take(order)
    new = np.zeros(table.shape, bool)
    np.not_equal(ascending[:, 1:], ascending[:, :-1], out=new[:, 1:])
    rank = np.empty(table.size, np.int32)
    rank[order.ravel()] = np.cumsum(new, axis=1, dtype=np.int32).ravel()
    return rank.reshape(table.shape)


def _order0(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place (places x lanes): ids below the place's own among those of the last snapshot, and equal ones."""
    rank = _dense(table)
    lanes, block = rank.shape
    kinds = int(rank.max()) + 1
    flat = rank + np.arange(lanes)[:, None] * kinds
    counts = np.zeros(lanes * kinds, np.int32)
    below, equal = np.zeros((2, lanes, block), np.int32)
    marks = [0, *snapshots(block), block]
    for i in range(1, len(marks) - 1):
        counts += np.bincount(flat[:, marks[i - 1] : marks[i]].ravel(), minlength=lanes * kinds).astype(np.int32)
        upto = np.cumsum(counts.reshape(lanes, kinds), axis=1, dtype=np.int32).ravel()
        own = slice(marks[i], marks[i + 1])
        equal[:, own] = counts.take(flat[:, own])
        below[:, own] = upto.take(flat[:, own]) - equal[:, own]
    return np.ascontiguousarray(below.T), np.ascontiguousarray(equal.T)


def _totals(block: int) -> np.ndarray:
    """For each place the ids of the last snapshot (1 before the first)."""
    marks = [0, *snapshots(block), block]
    return np.repeat(np.maximum(marks[:-1], 1), np.diff(marks))


def _encode(table: np.ndarray, sizes: np.ndarray, vocab: int) -> list[bytes]:
    lanes, block = table.shape
    below, equal = _order0(table)
    table = np.ascontiguousarray(table.T, np.int32)
    model, out, totals, steps = _Model(lanes), _Writer(lanes, block), _totals(block), _steps(sizes)
    before = np.concatenate([np.zeros((2, lanes), np.int32), table])
    for t in range(0, block, RENEW):
        stop = min(t + RENEW, block)
        x, own = table[t:stop], slice(t, stop)
        i = model.base[:, None] + (_hashes(before[t + 1 : stop + 1], before[t:stop]) & model.mask[:, None])
        e = np.empty(i.shape, np.int32)
        for j in range(stop - t):
            e[:, j] = found = model.table.take(i[:, j], mode="clip")
            model.learn(i[:, j], found, x[j])
        row, hit = model.state(e, model.rows), e >> 2 == x
        outcome = np.where(hit[1], 0, np.where(hit[0], 1, 3 - (equal[own] > 0)))
        packed, shift = model.packed.take(row, mode="clip"), outcome * _FIELD
        shares = np.empty((stop - t, 5, lanes))
        start = packed >> shift & _MASK
        shares[:, 0] = start
        shares[:, 1] = (packed >> shift + _FIELD & _MASK) - start
        two, three = outcome == 2, outcome == 3
        shares[:, 2] = below[own] * two + x * three
        shares[:, 3] = np.where(two, equal[own], 1)
        shares[:, 4] = np.where(two, totals[own, None], np.where(three, vocab, 1))
        for j in range(stop - t):
            out.put(steps[t + j], shares[j])
        model.renew(row, outcome)
    return out.close()


def _groups(blocks: int) -> list[tuple[int, int]]:
    """``blocks`` in runs of much the same number, ``LANES`` at most."""
    marks = np.linspace(0, blocks, -(-blocks // LANES) + 1).astype(int).tolist()
    return list(zip(marks[:-1], marks[1:], strict=True))


def encode_blocks(ids: np.ndarray, vocab: int, block: int = BLOCK) -> list[bytes]:
    """One payload for each run of ``block`` ids (the last may be shorter)."""
    if vocab > MOST_IDS or block > BLOCK:
        raise ValueError(f"a vocabulary has at most {MOST_IDS} ids and a block {BLOCK}")
    found = []
    for first, stop in _groups(-(-len(ids) // block)):
        own = ids[first * block : stop * block]
        lanes = -(-len(own) // block)
        table = np.zeros(lanes * block, np.uint16 if vocab <= 1 << 16 else np.int32)
        table[: len(own)] = own
        sizes = np.full(lanes, block)
        sizes[-1] = len(own) - (lanes - 1) * block
        found += _encode(table.reshape(lanes, block)[:, : sizes[0]], sizes, vocab)
    return found


def _snapshot(table: np.ndarray) -> np.ndarray:
    """The ids of each lane in order, each with the place and size of its group of equal ones (places x lanes come in)."""
    ids = np.sort(np.ascontiguousarray(table.T), axis=1, kind="stable")
    lanes, t = ids.shape
    new = np.ones((lanes, t), bool)
    np.not_equal(ids[:, 1:], ids[:, :-1], out=new[:, 1:])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, lanes * t))
    return np.repeat((ids.ravel().take(first).astype(np.int64) << _ID) + (first % t << _START) + n, n)


def _decode(payloads: list[bytes], sizes: np.ndarray, vocab: int) -> np.ndarray:
    lanes, block = len(payloads), int(sizes[0])
    table = np.zeros((block, lanes), np.uint16 if vocab <= 1 << 16 else np.int32)
    model, code, totals, steps = _Model(lanes), _Reader(payloads), _totals(block).tolist(), _steps(sizes)
    ids, at = np.ones(lanes, np.int64), np.arange(lanes)
    rows, outcomes = np.tile(model.rows, (RENEW, 1)), np.zeros((RENEW, lanes), np.int64)  # a lane that has ended counts for itself
    c1, c2, t0 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32), 1
    for t, n in enumerate(steps):
        if totals[t] != t0:
            t0 = totals[t]
            ids, at = _snapshot(table[:t]), np.arange(lanes) * t0
        i = model.base[:, :n] + (_hashes(c1[:n], c2[:n]) & model.mask)
        e = model.table.take(i, mode="clip")
        row = model.state(e, model.rows[:n])
        packed = model.packed.take(row, mode="clip")
        outcome = np.bitwise_count(code.get(n, _ONE) * _EACH + _GUARD - packed & _GUARD).astype(np.int64)
        shift = outcome * _FIELD
        start = packed >> shift & _MASK
        code.take(n, start, (packed >> shift + _FIELD & _MASK) - start)
        total = np.array([1.0, 1.0, t0, vocab]).take(outcome)
        v = code.get(n, total)
        found = np.where(outcome == 2, ids.take(at[:n] + v, mode="clip"), v * (1 << _ID | 1 << _START) + 1)
        (hit,) = (outcome < 2).nonzero()
        found[hit] = (np.where(outcome[hit] == 0, e[1, hit], e[0, hit]).astype(np.int64) >> 2 << _ID) + 1
        code.take(n, found >> _START & (1 << _ID - _START) - 1, found & _MASK)
        code.fill(n)
        x = (found >> _ID).astype(np.int32)
        model.learn(i, e, x)
        table[t, :n] = x
        rows[t % RENEW, :n], outcomes[t % RENEW, :n] = row, outcome
        if t % RENEW == RENEW - 1:
            model.renew(rows, outcomes)
        c1, c2 = x, c1[:n]
    return table.T.reshape(-1)[: int(sizes.sum())]


def decode_blocks(payloads: list[bytes], sizes: np.ndarray, vocab: int) -> np.ndarray:
    """The ids of consecutive blocks; all but the last are equally long."""
    found = [_decode(payloads[at:stop], sizes[at:stop], vocab) for at, stop in _groups(len(payloads))]
    return np.concatenate(found) if found else np.zeros(0, np.uint16)


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
