"""An adaptive context-mixing range coder for token ids, run over many blocks at once.

A block is a run of ids that is coded from fresh models and carries a checksum, so
any block decodes without the others.  For each id three models predict:

* order 2: the id that follows the two ids before it, as this block has learnt,
* order 1: the id that follows the id before it,
* order 0: all ids of the group by their exact frequencies, scaled to `TOTAL`.

Orders 1 and 2 keep one id and a confidence of 0 to 3 for each context.  The three
predictions are mixed: the share of the code space that each gets adapts to how
often it was right, apart for every pair of confidences and for whether the two
ids agree.  The id is coded in the share of the highest order that predicts it,
and below order 0 by its frequency.

The coder keeps 64-bit bounds and sends 32 bits at a time; a carry is added to the
word before, and words are brought into range at the end.  All arithmetic is on
integers, so any machine decodes what any other wrote.  The blocks of a group
advance together, one id each per step, as numpy vectors.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Shares are kept in 16 bits and used in 12; frequencies add up to 20 bits.
SHARE, TOTAL = 12, 20
_SLOTS, _RATE = 4096, 5
_CONTEXTS = 32
_ONE = np.uint64(1 << SHARE)
_LEAST = np.uint64(1 << 32)
_WORD = np.uint64(32)
#: Least shares of order 2 and of both; what is added to an entry by its confidence, and by that plus 4 where it was right.
_FLOOR = np.array([64, 128], np.int32)
_STEP = np.array([0, -1, -1, -2, 1, 1, 1, 0], np.int32).view(np.uint32)
_SPAN = np.int32(64448)
_BY_LAST, _BY_BEFORE, _BY_BOTH, _HIGH, _TWO = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 20, 2))
_BYTE_TWO, _THREE = np.uint8(2), np.uint8(3)
#: Steps whose contexts and bounds are taken at once.
_STEPS = 32


class _Models:
    """The models of all blocks of a group; both directions use them alike.

    What orders 1 and 2 hold stands in one vector, order 1 first, so each operation serves both.
    """

    def __init__(self, blocks: int):
        self.blocks, both = blocks, 2 * blocks
        self.base = np.arange(both) * _SLOTS
        self.corner = np.arange(blocks) * _CONTEXTS
        self.after = np.zeros(both * _SLOTS, np.uint32)
        self.shares = np.tile(np.array([8192, 12288], np.int32), blocks * _CONTEXTS).view(np.int64)
        self.floor = np.tile(_FLOOR, blocks)
        self.slots, self.hash = np.zeros(both, np.int64), np.zeros(both, np.uint32)
        self.guess, self.fresh = np.zeros((2, both), np.uint32)
        self.one, self.deep = self.guess[:blocks], self.guess[blocks:]
        self.right, self.hits = np.zeros((2, both), bool)
        self.is_one, self.is_two = self.right[:blocks], self.right[blocks:]
        self.hit_two, self.known = self.hits[::2], self.hits[1::2]
        self.target = np.zeros(both, np.int32)

    def places(self, last: np.ndarray, before: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The places of the contexts of orders 1 and 2 after the ids `last` and, before them, `before`; `out` is of as many steps."""
        h = self.hash if out.ndim == 1 else np.empty(out.shape, np.uint32)
        one, deep = h[..., : self.blocks], h[..., self.blocks :]
        np.multiply(last, _BY_LAST, out=one)
        np.multiply(before, _BY_BEFORE, out=deep)
        deep += one
        deep *= _BY_BOTH
        h >>= _HIGH
        return np.add(self.base, h, out=out)

    def predict(self, slots: np.ndarray) -> None:
        """Sets the guesses of orders 1 and 2, and `pair`, the shares of order 2 and of both of each block."""
        self.at_slots = slots
        self.entries = self.after[slots]
        np.right_shift(self.entries, _TWO, out=self.guess)
        self.sure = self.entries.astype(np.uint8)
        self.sure &= _THREE
        state = self.sure[self.blocks :] << _BYTE_TWO
        state |= self.sure[: self.blocks]
        state += state
        state += self.one == self.deep
        self.at = self.corner + state
        self.share = self.shares[self.at]
        self.pair = self.share.view(np.int32)

    def learn(self, ids: np.ndarray) -> None:
        """`ids` are what came; sets `is_two` where order 2 was right, `known` where order 2 or 1 was."""
        np.equal(self.one, ids, out=self.is_one)
        np.equal(self.deep, ids, out=self.is_two)
        self.hit_two[:] = self.is_two
        np.logical_or(self.is_one, self.is_two, out=self.known)
        target = self.target
        np.multiply(self.hits, _SPAN, out=target)
        target += self.floor
        target -= self.pair
        target >>= _RATE
        self.pair += target
        self.shares[self.at] = self.share
        np.left_shift(ids, _TWO, out=self.fresh[: self.blocks])
        self.fresh[self.blocks :] = self.fresh[: self.blocks]
        sure = self.right.view(np.uint8) << _BYTE_TWO
        sure |= self.sure
        self.entries += _STEP.take(sure, mode="clip")
        self.after[self.at_slots] = np.where(sure, self.entries, self.fresh)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a group, and frequencies of at least one that add up to 2 ** TOTAL."""
    counts = np.bincount(ids)
    used = np.flatnonzero(counts)
    held = counts[used]
    scaled = np.maximum(held * ((1 << TOTAL) - len(used)) // held.sum(), 0) + 1
    scaled[np.argmax(held)] += (1 << TOTAL) - int(scaled.sum())
    return used.astype(np.uint32), scaled.astype(np.uint32)


def _shape(n: int, block: int) -> np.ndarray:
    """The sizes of the blocks of `n` ids: they differ by one at most, and none is above `block`."""
    blocks = max(1, -(-n // block))
    return np.full(blocks, n // blocks) + (np.arange(blocks) < n % blocks)


def encode(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, bytes]]]:
    """A group's distinct ids and frequencies, and (ids, crc32, code) of each of its blocks; `ids` is uint16 and not empty."""
    used, scaled = frequencies(ids)
    freq, start = np.zeros((2, int(used[-1]) + 1), np.uint64)
    freq[used], start[used] = scaled, np.cumsum(scaled) - scaled
    sizes = _shape(len(ids), block)
    blocks, steps = len(sizes), int(sizes.max())
    first = np.cumsum(sizes) - sizes
    grid = np.zeros((steps, blocks), np.uint32)
    for b, (a, n) in enumerate(zip(first.tolist(), sizes.tolist())):
        grid[:n, b] = ids[a : a + n]
    low, width = np.zeros(blocks, np.uint64), np.full(blocks, 0xFFFFFFFFFFFFFFFF, np.uint64)
    out, at = np.zeros((blocks, steps // 2 + 64), np.int64), np.ones(blocks, np.int64)
    models = _Models(blocks)
    short = int(sizes.min())
    unit, fine, add, size, more = (np.zeros(blocks, np.uint64) for _ in range(5))
    with np.errstate(over="ignore"):
        shift, total = np.uint64(SHARE), np.uint64(TOTAL)
        for begin in range(0, steps, _STEPS):
            now = grid[begin : begin + _STEPS]
            ago = np.concatenate([np.zeros((2, blocks), np.uint32), grid[max(begin - 2, 0) : begin + len(now) - 1]])[-len(now) - 1 :]
            slots = models.places(ago[1:], ago[:-1], np.empty((len(now), 2 * blocks), np.int64))
            is_two, known = np.zeros((2, *now.shape), bool)
            share = np.zeros((len(now), 2 * blocks), np.int32)
            for k in range(len(now)):
                models.predict(slots[k])
                share[k] = models.pair
                models.learn(now[k])
                is_two[k], known[k] = models.is_two, models.known
            share >>= 4
            upto_two, upto_both = share[:, ::2].astype(np.uint64), share[:, 1::2].astype(np.uint64)
            # A bound is so many units and so many fine ones, the latter for ids that neither order predicts.
            from_unit = np.where(known, np.where(is_two, np.uint64(0), upto_two), upto_both)
            units = np.where(known, np.where(is_two, upto_two, upto_both - upto_two), np.uint64(0))
            from_fine, fines = np.where(known, np.uint64(0), start[now]), np.where(known, np.uint64(0), freq[now])
            left = _ONE - upto_both
            for k in range(len(now)):
                np.right_shift(width, shift, out=unit)
                np.multiply(left[k], unit, out=fine)
                np.right_shift(fine, total, out=fine)
                np.multiply(from_unit[k], unit, out=add)
                np.multiply(from_fine[k], fine, out=more)
                np.add(add, more, out=add)
                np.multiply(units[k], unit, out=size)
                np.multiply(fines[k], fine, out=more)
                np.add(size, more, out=size)
                if begin + k >= short:
                    live = begin + k < sizes
                    add, size = np.where(live, add, np.uint64(0)), np.where(live, size, width)
                np.add(low, add, out=low)
                np.copyto(width, size)
                carried = np.flatnonzero(low < add)
                out[carried, at[carried] - 1] += 1
                who = np.flatnonzero(width < _LEAST)
                if len(who):
                    bound = low[who]
                    place = at[who]
                    if place.max() + 4 > out.shape[1]:
                        out = np.concatenate([out, np.zeros_like(out)], axis=1)
                    out[who, place] = (bound >> _WORD).astype(np.int64)
                    at[who] = place + 1
                    low[who] = bound << _WORD
                    width[who] <<= _WORD
    lane = np.arange(blocks)
    for word in (low >> _WORD, low & np.uint64(0xFFFFFFFF)):
        out[lane, at] = word.astype(np.int64)
        at += 1
    while (over := out >> 32).any():
        out &= 0xFFFFFFFF
        out[:, :-1] += over[:, 1:]
    whole = np.ascontiguousarray(ids, "<u2")
    return used, scaled, [(n, zlib.crc32(whole[a : a + n]), out[b, 1 : at[b]].astype("<u4").tobytes()) for b, (a, n) in enumerate(zip(first.tolist(), sizes.tolist()))]


def decode(used: np.ndarray, scaled: np.ndarray, blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The ids of a group; raises ValueError where a block's checksum differs."""
    if int(scaled.sum(dtype=np.int64)) != 1 << TOTAL:
        raise ValueError("a group's frequencies don't add up: the file is damaged")
    freq, start = np.zeros((2, int(used[-1]) + 1), np.uint64)
    freq[used], start[used] = scaled, np.cumsum(scaled, dtype=np.uint64) - scaled
    id_at = np.repeat(used.astype(np.uint16), scaled)
    sizes = np.array([n for n, _, _ in blocks], np.int64)
    steps, short, count = int(sizes.max()), int(sizes.min()), len(blocks)
    longest = max(len(x) for _, _, x in blocks) // 4
    words = np.zeros((count, longest + 2), np.uint64)
    for b, (_, _, code) in enumerate(blocks):
        words[b, : len(code) // 4] = np.frombuffer(code, "<u4", len(code) // 4)
    words = words.reshape(-1)
    at = np.arange(count) * (longest + 2)
    most = at + longest + 1
    code, width = (words[at] << _WORD) | words[at + 1], np.full(count, 0xFFFFFFFFFFFFFFFF, np.uint64)
    at += 2
    grid = np.zeros((steps, count), np.uint16)
    models = _Models(count)
    last = np.uint64((1 << TOTAL) - 1)
    now = before = np.zeros(count, np.uint32)
    with np.errstate(over="ignore"):
        shift, total, one = np.uint64(SHARE), np.uint64(TOTAL), np.uint64(1)
        for step in range(steps):
            models.predict(models.places(now, before, models.slots))
            upto = (models.pair >> 4).astype(np.uint64)
            upto_two, upto_both = upto[::2], upto[1::2]
            unit = width >> shift
            edge_two, edge_both = upto_two * unit, upto_both * unit
            is_two = code < edge_two
            add = np.where(is_two, np.uint64(0), edge_two)
            size = np.where(is_two, edge_two, edge_both - edge_two)
            before, now = now, np.where(is_two, models.deep, models.one)
            rare = np.flatnonzero(code >= edge_both)
            if len(rare):
                base = edge_both[rare]
                fine = np.maximum(((_ONE - upto_both[rare]) * unit[rare]) >> total, one)
                found = id_at[np.minimum((code[rare] - base) // fine, last).view(np.int64)]
                now[rare] = found
                add[rare], size[rare] = base + start[found] * fine, freq[found] * fine
            if step >= short:
                live = step < sizes
                add, size = np.where(live, add, np.uint64(0)), np.where(live, size, width)
            grid[step] = now
            code -= add
            width = size
            who = np.flatnonzero(width < _LEAST)
            if len(who):
                place = at[who]
                code[who] = (code[who] << _WORD) | words[np.minimum(place, most[who])]
                at[who] = place + 1
                width[who] <<= _WORD
            models.learn(now)
    parts = [grid[:n, b] for b, n in enumerate(sizes.tolist())]
    for part, (_, crc, _) in zip(parts, blocks):
        if zlib.crc32(np.ascontiguousarray(part, "<u2")) != crc:
            raise ValueError("a block's checksum differs: the file is damaged")
    return np.concatenate(parts)
