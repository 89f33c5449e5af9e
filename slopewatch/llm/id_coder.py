"""An adaptive context-mixing range coder for token ids, many blocks at a time.

Two contexts name a candidate for the next id: the id that last followed the two ids before (order 2), and the one
that last followed the id before (order 1). What comes is one of four outcomes: the first candidate, the second, another
id that the block has had (drawn by the block's own frequencies, order 0), or a new one (drawn by a fixed law that falls
with the id). The chances of the outcomes are a mixture of three predictions: by how often the order-2 candidate has just
been right, by how often the order-1 candidate has, and without any context; what foretold the last ids best weighs most.

Candidates change with every id; frequencies, chances and weights are refreshed at fixed places of the block, so that
they can be computed for all its contexts at once. Each block starts anew, so blocks can be read alone; they carry their
length and a checksum. All blocks of a segment are coded side by side with numpy, a lane each. Chances are computed by
integers and by the basic operations of floating point, which give the same on every machine.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Ids of a block, at most; small segments get shorter blocks, so that at least LANES are coded side by side.
BLOCK, LANES, LEAST = 16_384, 256, 256
#: Ids are below this.
ALPHABET = 1 << 16
#: Places of a lane in the tables of candidates (orders 2 and 1), as powers of two, and the states of a place.
PLACES, STATES = (12, 11), 8
#: Chances of outcomes and of ids in whole numbers of these totals, as powers of two; those of a lane's own ids are multiples of 1 << FINE.
OUTCOME_BITS, ID_BITS, FINE = 11, 17, 3
#: Refreshes: the first ones, their distance as a share of what has been read, and at most.
FIRST, GROWTH, FARTHEST = 32, 4, 1024
#: Ids that a lane numbers; what comes after so many different ones stays new.
NUMBERED = 8_000
MAGIC = b"CMR2"
_T, _UNITS, _U = 1 << ID_BITS, 1 << ID_BITS - FINE, np.uint64
_SHIFT, _WORD, _LOW = _U(OUTCOME_BITS + ID_BITS), _U(32), _U(31)
_LEAST_SPAN, _LOW_MASK, _32_MASK = _U(1 << 31), _U((1 << 31) - 1), _U((1 << 32) - 1)
_WHOLE = (1 << 63) - 1
_16, _ID = np.uint32(16), np.uint32(0xFFFF)
#: Sixteenths of a bit that a chance of x / 1024 costs.
_BITS = np.array([16 * 11] + [round(-16 * math.log2(x / 1024)) for x in range(1, 1025)], np.int64)
#: Multipliers of the hashes of contexts, their shift, and the masks of the two orders.
_ONE, _TWO, _DOWN = 40_503, 30_011, 4
_MASKS = np.array([[(1 << bits) - 1] for bits in PLACES])


def _new_ids() -> np.ndarray:
    """Bounds of the law of new ids: at least 1, and more for small ids."""
    more = 1_000_000 // (np.arange(ALPHABET) + 100)
    upto = np.concatenate([[0], np.cumsum(more)])
    return upto * (_T - ALPHABET) // upto[-1] + np.arange(ALPHABET + 1)


_NEW = _new_ids()
#: A place's next state by its present one, if the candidate was right; ONCE, if it was wrong. In place for the id beside it.
_RIGHT, _ONCE = np.array([1, *range(2, STATES), STATES - 1], np.uint32) << _16, np.uint32(1 << 16)


def refreshes(block: int) -> Iterator[tuple[int, int]]:
    """The stretches of a block between refreshes."""
    at = 0
    while at < block:
        to = min(block, at + max(FIRST, min(FARTHEST, at // GROWTH)))
        yield at, to
        at = to


class _Model:
    """What the lanes have learned so far. `learn` takes a whole stretch; the candidates are read and written id by id."""

    def __init__(self, lanes: int) -> None:
        self.lanes, self.lane = lanes, np.arange(lanes)
        self.places = np.full(sum(lanes << bits for bits in PLACES), ALPHABET - 1, np.uint32)  # a place not used yet names the last id
        starts = (0, lanes << PLACES[0])
        self.base = np.stack([(self.lane << bits) + start for bits, start in zip(PLACES, starts, strict=True)])
        self.slot = np.zeros(lanes << 16, np.uint16)  # of each lane's ids: 0 if not had yet, else their number
        self.had = np.zeros(lanes, np.int64)
        self.counts = np.zeros((lanes, 256), np.int32)
        self.names = np.zeros((lanes, 257), np.uint16)
        self.outcomes = np.zeros((lanes, STATES, STATES, 4), np.int32)
        self.cost = np.zeros((3, lanes), np.int64)
        self.mix()
        self.draw()

    def mix(self) -> None:
        """Chances of the four outcomes by order 2's state, by order 1's and without any, and bounds of their mixture for each pair of states."""
        self.chances = []
        for n in (self.outcomes.sum(axis=2), self.outcomes.sum(axis=1), self.outcomes.sum(axis=(1, 2))[:, None]):
            n = 8.0 * n + 1.0
            self.chances.append(n / n.sum(axis=-1, keepdims=True))
        w = (256 >> np.minimum((self.cost - self.cost.min(axis=0)) >> 7, 8)).astype(np.float64)
        two, one, none = (p * x[:, None, None] for p, x in zip(self.chances, w, strict=True))
        p = two[:, :, None] + (one + none)[:, None]
        bounds = np.zeros((self.lanes, STATES, STATES, 5))
        for k in range(4):
            np.add(bounds[..., k], p[..., k], out=bounds[..., k + 1])
        bounds *= (((1 << OUTCOME_BITS) - 4) / w.sum(axis=0))[:, None, None, None]
        bounds = bounds.astype(np.int64)
        bounds += np.arange(5)
        bounds[..., 4] = 1 << OUTCOME_BITS
        self.bounds = bounds.reshape(-1)

    def draw(self) -> None:
        """Bounds of the ids that each lane has had, after each other for all lanes."""
        upto = np.zeros((self.lanes, self.counts.shape[1] + 1))
        np.cumsum(self.counts, axis=1, out=upto[:, 1:])
        upto *= ((_UNITS - self.had) / np.maximum(upto[:, -1], 1))[:, None]
        number = np.arange(upto.shape[1])
        law = upto.astype(np.int64)
        law += number
        law[number >= self.had[:, None]] = _UNITS
        law[self.had == 0, 0] = 0
        self.units = law
        self.width, self.law = law.shape[1], (law << FINE).reshape(-1)

    def learn(self, ids: np.ndarray, states: np.ndarray, outcome: np.ndarray) -> None:
        """A stretch is over: its ids, pairs of states and outcomes, one row for each place of the block."""
        key = ids + (self.lane << 16)
        fresh = np.unique(key[outcome == 3])
        fresh = fresh[self.slot[fresh] == 0]
        of = fresh >> 16
        number = self.had[of] + np.arange(len(fresh)) - np.searchsorted(of, self.lane)[of]
        fits = number < NUMBERED
        fresh, of, number = fresh[fits], of[fits], number[fits]
        self.had += np.bincount(of, minlength=self.lanes)
        if (most := int(self.had.max())) > self.counts.shape[1]:
            size = most + most // 4
            for name, wide in (("counts", size), ("names", size + 1)):
                old = getattr(self, name)
                grown = np.zeros((self.lanes, wide), old.dtype)
                grown[:, : old.shape[1]] = old
                setattr(self, name, grown)
        self.slot[fresh] = number + 1
        self.names[of, number] = fresh & 0xFFFF
        wide = self.counts.shape[1] + 1
        slot = self.slot.take(key) + self.lane * wide
        self.counts += np.bincount(slot.ravel(), minlength=self.lanes * wide).reshape(self.lanes, wide)[:, 1:]
        states <<= 2
        states += outcome
        states += self.lane << 8
        new = np.bincount(states.ravel(), minlength=self.lanes * 256).reshape(self.outcomes.shape)
        for j, (p, n) in enumerate(zip(self.chances, (new.sum(axis=2), new.sum(axis=1), new.sum(axis=(1, 2))[:, None]), strict=True)):
            self.cost[j] += (_BITS[(p * 1024).astype(np.int64)] * n).sum(axis=(1, 2)) - (self.cost[j] >> 1)
        self.outcomes -= self.outcomes >> 3
        self.outcomes += new
        self.mix()
        self.draw()


def _laid_out(n: int) -> tuple[int, int]:
    """Lanes and ids of each, for a segment of n ids."""
    lanes = max(-(-n // BLOCK), min(LANES, -(-n // LEAST)))
    return lanes, -(-n // lanes) if n else 0


def encode(ids: np.ndarray) -> bytes:
    """A segment: its numbers of ids and blocks, the blocks' sizes and checksums, and the blocks.

    Raises ValueError for an id that isn't from 0 to ALPHABET - 1.
    """
    n = len(ids)
    if n and not 0 <= int(np.min(ids)) <= int(np.max(ids)) < ALPHABET:
        raise ValueError(f"ids must be from 0 to {ALPHABET - 1}")
    lanes, block = _laid_out(n)
    flat = np.zeros(block * lanes, np.uint16)  # the last lane is filled up with zeros
    flat[:n] = ids
    past = np.zeros((block + 2, lanes), np.uint16)
    if n:
        past[2:] = flat.reshape(lanes, block).T
    model = _Model(lanes)
    low, span = np.zeros(lanes, _U), np.full(lanes, _WHOLE, _U)
    words, heads = [], []
    e, nxt, right = np.empty((2, lanes), np.uint32), np.empty((2, lanes), np.uint32), np.empty((2, lanes), bool)
    row = model.lane << 6
    for start, stop in refreshes(block):
        known = past[start : stop + 2].astype(np.int64)
        now = known[2:]
        where = np.empty((len(now), 2, lanes), np.int64)
        np.multiply(known[1:-1], _ONE, out=where[:, 1])
        np.multiply(known[:-2], _TWO, out=where[:, 0])
        where[:, 0] += where[:, 1]
        where >>= _DOWN
        where &= _MASKS
        where += model.base
        guess, state = np.empty((len(now), 2, lanes), np.uint32), np.empty((len(now), 2, lanes), np.uint32)
        for at, g, s, x in zip(where, guess, state, now.astype(np.uint32), strict=True):
            model.places.take(at, out=e, mode="clip")
            np.bitwise_and(e, _ID, out=g)
            np.right_shift(e, _16, out=s)
            np.equal(g, x, out=right)
            nxt.fill(_ONCE)
            np.copyto(nxt, _RIGHT.take(s), where=right)
            nxt |= x
            model.places[at] = nxt
        slot = model.slot.take(now + (model.lane << 16))
        outcome = 3 - (slot > 0).astype(np.int64)
        outcome[guess[:, 1] == now] = 1
        outcome[guess[:, 0] == now] = 0
        states = (state[:, 0] * np.uint32(STATES) + state[:, 1] * (guess[:, 0] != guess[:, 1])).astype(np.int64)
        at = states + row
        at *= 5
        at += outcome
        under = model.bounds.take(at)
        at += 1
        size = model.bounds.take(at)
        size -= under
        at = model.lane * model.width - 1 + np.maximum(slot, 1)
        inside = model.law.take(at)
        at += 1
        part = model.law.take(at)
        part -= inside
        new = outcome == 3
        inside[new], part[new] = _NEW[now[new]], _NEW[now[new] + 1] - _NEW[now[new]]
        foreseen = outcome < 2
        inside[foreseen], part[foreseen] = 0, _T
        inside *= size
        under <<= ID_BITS
        under += inside
        part *= size
        for u, p in zip(under.view(_U), part.view(_U), strict=True):
            span >>= _SHIFT
            u *= span
            low += u
            span *= p
            at = np.flatnonzero(span < _LEAST_SPAN)
            if len(at):
                x = low[at]
                words.append(x >> _LOW)
                heads.append(at)
                x &= _LOW_MASK
                x <<= _WORD
                low[at] = x
                span[at] <<= _WORD
        model.learn(now, states, outcome)
    if n:
        words += [low >> _LOW, (low & _LOW_MASK) << _U(1)]
        heads += [model.lane, model.lane]
    head = np.concatenate(heads) if n else np.zeros(0, np.int64)
    order = np.argsort(head.astype(np.uint16 if lanes < 65_536 else np.int64), kind="stable")
    out = np.concatenate(words)[order] if n else np.zeros(0, _U)
    while (out > _32_MASK).any():  # carries go to the word before; none leaves a lane
        carry = out >> _WORD
        out &= _32_MASK
        out[:-1] += carry[1:]
    sizes = 4 * np.bincount(head, minlength=lanes).astype("<u4")
    rows = flat.astype("<u4").reshape(lanes, block) if n else []
    sums = np.array([zlib.crc32(x.tobytes()) for x in rows], "<u4")
    return MAGIC + struct.pack("<QII", n, block, lanes) + sizes[:lanes].tobytes() + sums.tobytes() + out.astype(">u4").tobytes()


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment. Raises ValueError if it is no segment, is cut short, or a block's checksum differs."""
    if data[:4] != MAGIC or len(data) < 20:
        raise ValueError("not a segment of ids")
    n, block, lanes = struct.unpack_from("<QII", data, 4)
    start = 20 + 8 * lanes
    if len(data) < start or (lanes, block) != _laid_out(n):
        raise ValueError("the segment is cut short")
    sizes, sums = np.frombuffer(data, "<u4", lanes, 20).astype(np.int64), np.frombuffer(data, "<u4", lanes, 20 + 4 * lanes)
    if len(data) - start != sizes.sum():
        raise ValueError("the segment is cut short")
    if not n:
        return np.zeros(0, np.int64)
    body = np.concatenate([np.frombuffer(data, ">u4", offset=start).astype(_U), np.zeros(4, _U)])
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // 4
    code = body[at] << _LOW | body[at + 1] >> _U(1)
    body = (body[:-1] & _U(1)) << _LOW | body[1:] >> _U(1)  # the 32 bits after the first 63
    at += 1
    span = np.full(lanes, _WHOLE, _U)
    model, grid = _Model(lanes), np.zeros((block, lanes), np.uint16)
    row, units = model.lane << 6, model.lane * _UNITS
    where, e, state, nxt, guess = np.empty((2, lanes), np.int64), *(np.empty((2, lanes), np.uint32) for _ in range(4))
    same, right, need = np.empty(lanes, bool), np.empty((2, lanes), bool), np.empty(lanes, bool)
    shift, x32 = np.empty(lanes, _U), np.empty(lanes, np.uint32)
    x = two = np.zeros(lanes, np.int64)
    for begin, stop in refreshes(block):
        all_ids, all_states, all_outcomes = (np.empty((stop - begin, lanes), np.int64) for _ in range(3))
        names = model.names[:, : model.width].astype(np.int64).reshape(-1)
        law = np.append(model.law, [0, _T])  # the last place: an id that a candidate names has no part of its own
        names = np.append(names, 0)
        number = np.repeat(np.arange(len(model.law), dtype=np.int32), np.diff(model.units, axis=1, append=_UNITS).ravel())
        bounds = model.bounds.reshape(-1, 5).T
        first, second, third = (np.ascontiguousarray(bounds[k]) << ID_BITS for k in (1, 2, 3))
        for states, outcome, out in zip(all_states, all_outcomes, all_ids, strict=True):
            np.multiply(x, _ONE, out=where[1])
            np.add(where[1], two, out=where[0])
            two = x * _TWO
            where >>= _DOWN
            where &= _MASKS
            where += model.base
            model.places.take(where, out=e, mode="clip")
            np.bitwise_and(e, _ID, out=guess)
            np.right_shift(e, _16, out=state)
            np.not_equal(guess[0], guess[1], out=same)
            np.multiply(state[0], STATES, out=x32)
            np.add(x32, state[1] * same, out=states)
            k = states + row
            span >>= _SHIFT
            v = (code // span).view(np.int64)
            np.less_equal(first.take(k, mode="clip"), v, out=outcome)
            outcome += second.take(k, mode="clip") <= v
            outcome += third.take(k, mode="clip") <= v
            k *= 5
            k += outcome
            under = model.bounds.take(k, mode="clip")
            k += 1
            size = model.bounds.take(k, mode="clip")
            size -= under
            under <<= ID_BITS
            v -= under
            v //= size
            i = v >> FINE
            i += units
            i = number.take(i, mode="clip")
            np.less(outcome, 2, out=same)
            np.copyto(i, len(law) - 2, where=same)
            names.take(i, out=out, mode="clip")
            inside = law.take(i)
            i += 1
            part = law.take(i)
            part -= inside
            x = out
            f = np.flatnonzero(same)
            x[f] = guess[outcome[f], f]
            f = np.flatnonzero(outcome == 3)
            if len(f):
                x[f] = j = np.minimum(_NEW.searchsorted(v[f], side="right") - 1, ALPHABET - 1)
                inside[f] = _NEW[j]
                part[f] = _NEW[j + 1] - _NEW[j]
            inside *= size
            inside += under
            part *= size
            code -= inside.view(_U) * span
            span *= part.view(_U)
            np.less(span, _LEAST_SPAN, out=need)
            np.multiply(need, _WORD, out=shift)
            code <<= shift
            span <<= shift
            code += body.take(at, mode="clip") * need
            at += need
            x32[:] = x
            np.equal(guess, x32, out=right)
            nxt.fill(_ONCE)
            np.copyto(nxt, _RIGHT.take(state, mode="clip"), where=right)
            nxt |= x32
            model.places[where] = nxt
        if not span.all():  # only damaged data come here
            raise ValueError("a block is damaged")
        grid[begin:stop] = all_ids
        model.learn(all_ids, all_states, all_outcomes)
    found = np.ascontiguousarray(grid.T)
    for x, s in zip(found.astype("<u4"), sums, strict=True):
        if zlib.crc32(x.tobytes()) != s:
            raise ValueError("a block's checksum differs")
    return found.ravel()[:n].astype(np.int64)
