"""An adaptive context-mixing range coder for token ids, in numpy.

A block is reset, coded and checksummed by itself. Its tokens are dealt to lanes, contiguous pieces that are coded in
step: each lane has a range coder of its own, all lanes share one model, and after every step the model learns what all
lanes have just coded (the decoder knows as much). A token is coded as "what order 2 predicts", "what order 1 predicts"
or neither, with mixed probabilities of several contexts, and in the last case by its order-0 frequency.

Only integer arithmetic is used, so that any machine decodes what another has coded.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, STEPS = 8192, 256
#: Tokens of a full block.
BLOCK = LANES * STEPS
MAGIC = b"PGT1"
_HEAD = struct.Struct("<4sIQIIIII")  # magic, documents, tokens, vocabulary, lanes, crc of ids, bytes of the index, crc of all else

_U = np.uint64
_TOP, _BOT = _U(1 << 48), _U(1 << 32)
#: A flag has 12 bits and an id 20, so that one step codes both.
_FLAGS, _ID_BITS, _BITS = 1 << 12, 20, _U(32)
_SLOTS = 18


class _Encoder:
    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
        self.out, self.size = np.zeros((lanes, 3 * steps + 4), np.uint16), np.zeros(lanes, np.int64)

    def put(self, cum: np.ndarray, freq: np.ndarray) -> None:
        """For the first lanes, ranges in 2 ** 32."""
        n = len(cum)
        low, rng = self.low[:n], self.range[:n]
        rng >>= _BITS
        low += rng * cum
        rng *= freq
        for who, low_, _ in _shifts(low, rng):
            self.out[who, self.size[who]] = (low_ >> _U(48)).astype(np.uint16)
            self.size[who] += 1

    def finish(self) -> tuple[np.ndarray, bytes]:
        value = (self.low + (_BOT - _U(1))) >> _U(32)
        who = np.arange(len(self.low))
        for part in (value >> _U(16), value & _U(0xFFFF)):
            self.out[who, self.size] = part.astype(np.uint16)
            self.size += 1
        inside = np.arange(self.out.shape[1]) < self.size[:, None]
        return self.size, self.out[inside].astype("<u2").tobytes()


def _shifts(low: np.ndarray, rng: np.ndarray):
    """Takes 16 bits off each lane whose first 16 bits are settled, or whose range has become too small (it is cut
    short, so that nothing carries), as often as need be. Yields the lanes, their low ends before, and nothing else to
    be done but moving the bits; ``low`` and ``rng`` change in place."""
    who = np.flatnonzero(((low ^ (low + rng)) < _TOP) | (rng < _BOT))
    while len(who):
        a, r = low[who], rng[who]
        cut = (a ^ (a + r)) >= _TOP
        if cut.any():
            r = np.where(cut, (~a + _U(1)) & (_BOT - _U(1)), r)
        yield who, a, r
        a, r = a << _U(16), r << _U(16)
        low[who], rng[who] = a, r
        who = who[((a ^ (a + r)) < _TOP) | (r < _BOT)]


class _Decoder:
    def __init__(self, sizes: np.ndarray, data: np.ndarray):
        lanes = len(sizes)
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
        self.data = np.concatenate([data, np.zeros(4, data.dtype)])
        self.next = np.cumsum(sizes) - sizes
        self.stop = self.next + sizes
        self.code = np.zeros(lanes, _U)
        for _ in range(4):
            self.code = (self.code << _U(16)) | self._word(np.arange(lanes))

    def _word(self, who: np.ndarray) -> np.ndarray:
        at = self.next[who]
        self.next[who] = at + 1
        return np.where(at < self.stop[who], self.data[np.minimum(at, len(self.data) - 1)], 0).astype(_U)

    def value(self, n: int) -> np.ndarray:
        got = (self.code[:n] - self.low[:n]) // (self.range[:n] >> _BITS)
        return np.minimum(got, _U((1 << 32) - 1)).astype(np.int64)

    def take(self, cum: np.ndarray, freq: np.ndarray) -> None:
        n = len(cum)
        low, rng = self.low[:n], self.range[:n]
        rng >>= _BITS
        low += rng * cum
        rng *= freq
        for who, _, _ in _shifts(low, rng):
            self.code[who] = (self.code[who] << _U(16)) | self._word(who)


class _Mixed:
    """The chance of a hit, mixed from two adaptive tables of counts; each weighs by how well it has done lately."""

    def __init__(self, sizes: tuple[int, int]):
        self.hits = [np.ones(n, np.int64) for n in sizes]
        self.all = [np.full(n, 3, np.int64) for n in sizes]
        self.score = [_FLAGS // 2, _FLAGS // 2]
        self._refresh()

    def _refresh(self) -> None:
        self.rate = [(h * _FLAGS // n).astype(np.int32) for h, n in zip(self.hits, self.all, strict=True)]
        self.w = min(240, max(16, 128 + (self.score[0] - self.score[1]) // 4))

    def chance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of _FLAGS."""
        return (self.w * self.rate[0].take(a) + (256 - self.w) * self.rate[1].take(b)) >> 8

    def learn(self, contexts: tuple[np.ndarray, np.ndarray], hit: np.ndarray) -> None:
        if not len(hit):
            return
        for k, c in enumerate(contexts):
            own = self.rate[k][c]
            self.score[k] += (int(np.where(hit, own, _FLAGS - own).sum()) // len(hit) - self.score[k]) // 8
            self.all[k] += np.bincount(c, minlength=len(self.all[k]))
            self.hits[k] += np.bincount(c[hit], minlength=len(self.hits[k]))
        self._refresh()


_MORE = (np.arange(16) < 15).astype(np.int32)
_LESS = ((np.arange(16) + 1) // 2).astype(np.int32)


class _Model:
    """A cell of a table of guesses is an id times 16 plus how far it is trusted."""

    def __init__(self, vocabulary: int, lanes: int, decoding: bool = False):
        self.v, self.decoding = vocabulary, decoding
        self.table1, self.table2 = np.zeros(vocabulary + 1, np.int32), np.zeros(1 << _SLOTS, np.int32)
        self.prev1, self.prev2 = np.full(lanes, vocabulary, np.int64), np.full(lanes, vocabulary, np.int64)
        self.first, self.second = _Mixed((512, 512)), _Mixed((256, 512))
        self.count = np.zeros(vocabulary, np.int64)
        self.step = 0
        self._table()

    def _table(self) -> None:
        total = int(self.count.sum())
        room = (1 << _ID_BITS) - self.v
        freq = 1 + (self.count * room // total if total else np.full(self.v, room // self.v))
        freq[int(freq.argmax())] += (1 << _ID_BITS) - int(freq.sum())
        self.freq, self.cum = freq, np.cumsum(freq) - freq
        if self.decoding:
            self.at = np.repeat(np.arange(self.v, dtype=np.int32), freq)
        self.level = np.minimum(15, np.searchsorted(1 << np.arange(15), self.count, "right")).astype(np.int32)

    def predict(self, n: int) -> None:
        """For the first ``n`` lanes: both guesses, and the ranges of their flags in _FLAGS."""
        p1, p2 = self.prev1[:n], self.prev2[:n]
        self.slot = ((p2 * 50021 + p1) * 2654435761 >> 12) & ((1 << _SLOTS) - 1)
        self.cell2, self.cell1 = self.table2.take(self.slot), self.table1.take(p1)
        self.g2, self.g1 = self.cell2 >> 4, self.cell1 >> 4
        self.t2, self.t1 = self.cell2 & 15, self.cell1 & 15
        self.same = self.g1 == self.g2
        both = (self.t2 << 5) | (self.same.view(np.int8).astype(np.int32) << 4)
        self.c2 = both | self.t1, both | self.level.take(self.g2)
        t1 = self.t1 << 4
        self.c1 = t1 | self.t2, t1 | self.level.take(self.g1)
        self.f2 = np.minimum(np.maximum(self.first.chance(*self.c2), 1), _FLAGS - 16)
        left = _FLAGS - self.f2
        self.f1 = np.minimum(np.maximum(left * self.second.chance(*self.c1) >> 12, 1), left - 8)
        self.f1[self.same] = 0
        self.f12 = self.f2 + self.f1

    def ranges(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f12, f2 = self.f12.astype(np.int64), self.f2.astype(np.int64)
        rest = _FLAGS - f12
        cum, freq = (f12 << _ID_BITS) + rest * self.cum.take(ids), rest * self.freq.take(ids)
        one, two = np.flatnonzero(hit1), np.flatnonzero(hit2)
        cum[one], freq[one] = f2[one] << _ID_BITS, (f12[one] - f2[one]) << _ID_BITS
        cum[two], freq[two] = 0, f2[two] << _ID_BITS
        return cum.view(_U), freq.view(_U)

    def learn(self, n: int, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """``hit1``: order 1 is right and order 2 isn't."""
        if self.step < 16 or self.step % 4 == 0:
            self.first.learn(self.c2, hit2)
            open_ = np.flatnonzero(~hit2 & ~self.same)
            self.second.learn((self.c1[0][open_], self.c1[1][open_]), hit1[open_])
        np.add.at(self.count, ids[~(hit2 | hit1)], 1)
        fresh = (ids.astype(np.int32) << 4) + 1
        for table, at, cell, trust, hit in ((self.table2, self.slot, self.cell2, self.t2, hit2), (self.table1, self.prev1[:n], self.cell1, self.t1, ids == self.g1)):
            # one more after a hit, half after a miss, another guess if there was hardly any trust
            table[at] = np.where(hit, cell + _MORE.take(trust), np.where(trust > 1, cell - _LESS.take(trust), fresh))
        self.prev2[:n] = self.prev1[:n]
        self.prev1[:n] = ids
        self.step += 1
        if self.step & (self.step - 1) == 0 or self.step % 16 == 0:
            self._table()


def _shape(tokens: int) -> tuple[int, int]:
    lanes = min(LANES, max(1, tokens // 128))
    return lanes, -(-tokens // lanes)


def encode_block(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    """A block: header, index of documents, then the lanes' streams. ``ids`` are those of all documents, ``counts`` long."""
    if len(ids) and (ids.min() < 0 or ids.max() >= vocabulary):
        raise ValueError("an id is outside the vocabulary")
    if vocabulary >= 1 << (_ID_BITS - 1):
        raise ValueError("the vocabulary is too large for the id ranges")
    index = zlib.compress(np.diff(doc_ids.astype("<i8"), prepend=0).astype("<i8").tobytes() + counts.astype("<u8").tobytes(), 6)
    check = zlib.crc32(ids.astype("<u4").tobytes())
    lanes, steps = _shape(len(ids)) if len(ids) else (0, 0)
    body = index
    if lanes:
        coder, model = _Encoder(lanes, steps), _Model(vocabulary, lanes)
        grid = np.zeros(lanes * steps, np.int32)
        grid[: len(ids)] = ids
        grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
        for s in range(steps):
            n = -(-(len(ids) - s) // steps)
            own = grid[s, :n].astype(np.int64)
            model.predict(n)
            hit2 = own == model.g2
            hit1 = ~hit2 & (own == model.g1)
            coder.put(*model.ranges(own, hit2, hit1))
            model.learn(n, own, hit2, hit1)
        sizes, data = coder.finish()
        body += sizes.astype("<u4").tobytes() + data
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), vocabulary, lanes, check, len(index), 0)[:-4]
    return head + zlib.crc32(body, zlib.crc32(head)).to_bytes(4, "little") + body


def decode_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids); ValueError if the block is damaged."""
    if len(block) < _HEAD.size:
        raise ValueError("the block is cut short")
    magic, docs, tokens, vocabulary, lanes, check, width, whole = _HEAD.unpack_from(block)
    body = block[_HEAD.size :]
    if magic != MAGIC or zlib.crc32(body, zlib.crc32(block[: _HEAD.size - 4])) != whole:
        raise ValueError("the block is damaged")
    index = zlib.decompress(body[:width])
    doc_ids, counts = np.cumsum(np.frombuffer(index[: 8 * docs], "<i8")), np.frombuffer(index[8 * docs :], "<u8").astype(np.int64)
    if not tokens:
        return doc_ids, counts, np.zeros(0, np.int32)
    sizes = np.frombuffer(body, "<u4", lanes, width).astype(np.int64)
    coder = _Decoder(sizes, np.frombuffer(body, "<u2", -1, width + 4 * lanes))
    model, steps = _Model(vocabulary, lanes, decoding=True), -(-tokens // lanes)
    grid = np.zeros((steps, lanes), np.int32)
    for s in range(steps):
        n = -(-(tokens - s) // steps)
        model.predict(n)
        v = coder.value(n)
        flag = v >> _ID_BITS
        hit2 = flag < model.f2
        hit1 = ~hit2 & (flag < model.f12)
        own = np.where(hit2, model.g2, model.g1).astype(np.int64)
        rest = np.flatnonzero(flag >= model.f12)
        f = model.f12[rest].astype(np.int64)
        own[rest] = model.at[(v[rest] - (f << _ID_BITS)) // (_FLAGS - f)]
        coder.take(*model.ranges(own, hit2, hit1))
        grid[s, :n] = own
        model.learn(n, own, hit2, hit1)
    ids = np.ascontiguousarray(grid.T).ravel()[:tokens]
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("the decoded ids fail their checksum")
    return doc_ids, counts, ids
