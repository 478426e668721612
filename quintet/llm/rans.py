"""Static range asymmetric numeral system over token ids, in independent interleaved blocks.

A file shares one table of frequencies. Its tokens are cut in blocks; a block
is coded by ``LANES`` interleaved states that take its tokens in turn, and
has its words, a CRC-32 of its tokens, and a checkpoint (states and place in its
words) every ``CHECK_STEPS`` steps, from which decoding can start. All blocks, and
all checkpoints on reading, go through one vectorised loop.

File: magic, fixed header, table (symbols, frequencies), documents (ids, null flags,
token counts), blocks (first word, CRC), checkpoints (states, words), words, and
a CRC-32 of all before the words. All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"QTRANS1\n"
LANES = 32
BLOCK_STEPS = 1024
CHECK_STEPS = 256
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<8sQIIIIIIII")
_32 = np.uint64(32)


def quantise(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies of at least 1 that add up to ``2 ** bits``, near in proportion to the counts."""
    total = 1 << bits
    f = np.maximum(1, (counts * (total / counts.sum())).astype(np.int64))
    order = np.argsort(-counts, kind="stable")
    while (off := total - int(f.sum())) != 0:
        for k in order:
            if off == 0:
                break
            step = off if off > 0 else -min(-off, int(f[k]) // 2)
            f[k] += step
            off -= step
    return f


def _alphabet(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens, the place of each token among them, and their counts."""
    if tokens.max() >= 1 << 22:
        return np.unique(tokens, return_inverse=True, return_counts=True)
    counts = np.bincount(tokens)
    symbols = np.flatnonzero(counts)
    return symbols, (np.cumsum(counts > 0) - 1).astype(np.int32)[tokens], counts[symbols]


def encode(tokens: np.ndarray, doc_ids: list[int | None], doc_tokens: list[int]) -> bytes:
    """A file with the tokens of documents laid end to end."""
    tokens = np.asarray(tokens, np.uint32)
    n = len(tokens)
    symbols, index, counts = _alphabet(tokens) if n else (np.zeros(1, np.uint32), np.zeros(0, np.int64), np.ones(1, np.int64))
    bits = max(12, int(len(symbols) - 1).bit_length() + 2)
    freq = quantise(counts, bits).astype(np.uint64)
    cum = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)

    per = LANES * BLOCK_STEPS
    blocks = -(-n // per)
    last_steps = -(-(n - (blocks - 1) * per) // LANES) if blocks else 0
    padded = np.full(blocks * per, int(np.argmax(counts)), np.int32)
    padded[:n] = index
    # step, block, lane
    grid = np.ascontiguousarray(padded.reshape(blocks, BLOCK_STEPS, LANES).transpose(1, 0, 2)).reshape(BLOCK_STEPS, blocks * LANES)
    words = np.zeros((BLOCK_STEPS, blocks * LANES), np.uint32)
    put = np.zeros((BLOCK_STEPS, blocks * LANES), bool)
    checks = BLOCK_STEPS // CHECK_STEPS
    states = np.zeros((checks, blocks * LANES), np.uint64)
    x = np.full(blocks * LANES, LOW, np.uint64)
    shift, top = np.uint64(bits), np.uint64(63 - bits)
    for t in range(BLOCK_STEPS - 1, -1, -1):
        m = blocks * LANES if t < last_steps else (blocks - 1) * LANES
        if m <= 0:
            continue
        s = grid[t, :m]
        f, c, now = freq[s], cum[s], x[:m]
        full = now >= (f << top)
        words[t, :m] = now.astype(np.uint32)
        put[t, :m] = full
        now = np.where(full, now >> _32, now)
        q = now // f
        x[:m] = (q << shift) + (now - q * f) + c
        if t % CHECK_STEPS == 0:
            states[t // CHECK_STEPS] = x
    by_block = put.reshape(BLOCK_STEPS, blocks, LANES).transpose(1, 0, 2)
    stream = words.reshape(BLOCK_STEPS, blocks, LANES).transpose(1, 0, 2)[by_block]
    per_check = by_block.reshape(blocks, checks, CHECK_STEPS * LANES).sum(2)
    first = np.concatenate(([0], np.cumsum(per_check.sum(1)))).astype("<u8")
    at_check = (np.cumsum(per_check, 1) - per_check).astype("<u4")
    crcs = np.array([zlib.crc32(tokens[a : a + per].astype("<u4").tobytes()) for a in range(0, n, per)], "<u4")
    states = states.reshape(checks, blocks, LANES).transpose(1, 0, 2)
    head = _HEAD.pack(MAGIC, n, len(doc_ids), len(symbols), bits, LANES, BLOCK_STEPS, CHECK_STEPS, blocks, 0) + b"".join(
        a.tobytes() for a in (symbols.astype("<u4"), freq.astype("<u4"), np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), np.array(doc_tokens, "<u8"), first, crcs, np.ascontiguousarray(states).astype("<u8"), at_check)
    )
    return head + struct.pack("<I", zlib.crc32(head)) + stream.astype("<u4").tobytes()


class File:
    """A file's tables; tokens are decoded on demand. Raises ValueError where a checksum differs."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, self.n, docs, symbols, self.bits, self.lanes, self.steps, self.check, self.blocks, _ = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(self.data, kind, count, at)
            at += a.nbytes
            return a

        checks = self.steps // self.check
        self.symbols, freq = take("<u4", symbols), take("<u4", symbols)
        ids, null, self.doc_tokens = take("<i8", docs), take("u1", docs), take("<u8", docs)
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self.first, self.crcs = take("<u8", self.blocks + 1), take("<u4", self.blocks)
        self.states, self.at_check = take("<u8", self.blocks * checks * self.lanes).reshape(self.blocks, checks, self.lanes), take("<u4", self.blocks * checks).reshape(self.blocks, checks)
        if zlib.crc32(self.data[:at]) != take("<u4", 1)[0]:
            raise ValueError("header checksum differs")
        self.words = np.frombuffer(self.data, "<u4", -1, at)
        if len(self.words) != int(self.first[-1]):
            raise ValueError("the file is cut short")
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.slots = np.repeat(np.arange(symbols, dtype=np.int32), freq)

    def decode(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Tokens begin..end; starts at the checkpoints before begin. Whole blocks are checked against their CRC."""
        end = self.n if end is None else min(end, self.n)
        per, own = self.lanes * self.steps, self.lanes * self.check
        if begin >= end:
            return np.zeros(0, np.uint32)
        k = np.arange(begin // own, (end - 1) // own + 1)  # a checkpoint each
        block, check = k // (per // own), k % (per // own)
        x = self.states[block, check].astype(np.uint64)
        at = (self.first[block] + self.at_check[block, check]).astype(np.int64)
        steps = np.minimum(self.check, -(-(self.n - k * own) // self.lanes))
        out = np.zeros((self.check, len(k), self.lanes), np.int32)
        mask, shift = np.uint64((1 << self.bits) - 1), np.uint64(self.bits)
        words = np.concatenate((self.words, [np.uint32(0)]))
        for t in range(self.check):
            m = len(k) if t < steps[-1] else len(k) - 1
            if not m:
                break
            now = x[:m]
            slot = now & mask
            s = self.slots[slot.astype(np.int64)]
            out[t, :m] = s
            now = self.freq[s] * (now >> shift) + slot - self.cum[s]
            need = now < LOW
            place = at[:m, None] + np.cumsum(need, 1) - need
            x[:m] = np.where(need, (now << _32) | words[np.where(need, place, -1)].astype(np.uint64), now)
            at[:m] += need.sum(1)
        tokens = self.symbols[out.transpose(1, 0, 2).ravel()]
        base = int(k[0]) * own
        tokens = tokens[: self.n - base]
        for b in range(-(-base // per), (base + len(tokens) - 1) // per + 1):
            whole = tokens[b * per - base : (b + 1) * per - base]
            if len(whole) == min(per, self.n - b * per) and zlib.crc32(whole.astype("<u4").tobytes()) != self.crcs[b]:
                raise ValueError(f"checksum of block {b} differs")
        return tokens[begin - base : end - base]
