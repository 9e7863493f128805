"""Static range asymmetric numeral system over interleaved lanes.

Token i of a block belongs to lane i mod ``lanes``; one step codes a token of every lane
with array operations.  Lane states lie between 2 ** 20 and 2 ** 52, so quotients of doubles
are exact once rounded down, and give out 32-bit words.  Coding goes
from the last step to the first, so reading goes forward through the tokens and
backward through the words.  The lane states before the first step and before every
``CHECK_STEPS``-th one are kept as checkpoints, from each of which a reader can start.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

BITS = 18
LANES = 2048
CHECK_STEPS = 128
_LOW = 1 << 20
_HIGH_BITS = 52
_WORD = 32


class DamagedBlock(ValueError):
    """A block whose checksum does not fit its contents."""


def shared_out(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that add up to 2 ** bits, at least 1 for each count above 0."""
    total = 1 << bits
    present = np.flatnonzero(counts)
    if len(present) > total:
        raise ValueError(f"{len(present)} symbols do not fit a table of {total}")
    found = np.zeros(len(counts), np.int64)
    if not len(present):
        return found
    spare = total - len(present)
    share = counts[present].astype(np.float64) * (spare / counts.sum())
    found[present] = 1 + np.floor(share).astype(np.int64)
    left = total - int(found.sum())
    most = present[np.lexsort((present, -(share - np.floor(share))))[:left]]
    found[most] += 1
    found[present[np.argmax(counts[present])]] += total - int(found.sum())
    return found


class Table:
    """Shared frequencies in the forms that coding and reading need."""

    def __init__(self, frequencies: np.ndarray, bits: int = BITS):
        self.bits = bits
        self.frequency = frequencies.astype(np.int64)
        self.begin = np.cumsum(self.frequency) - self.frequency
        self.symbol = np.repeat(np.arange(len(frequencies)), frequencies)
        self.limit = self.frequency << (_HIGH_BITS - bits)
        self.mask = (1 << bits) - 1


@dataclass
class Block:
    """The code of one run of tokens; ``states`` and ``at`` are the checkpoints."""

    n_tokens: int
    lanes: int
    words: bytes
    states: bytes
    at: list[int]
    crc32: int

    def checksum(self) -> int:
        return zlib.crc32(self.states, zlib.crc32(self.words))


def encode(tokens: np.ndarray, table: Table, lanes: int = LANES) -> Block:
    lanes = max(1, min(lanes, len(tokens) // 16))
    steps = -(-len(tokens) // lanes)
    state = np.full(lanes, _LOW, np.int64)
    tokens = tokens.astype(np.int64)
    words: list[np.ndarray] = []
    written = 0
    states: list[np.ndarray] = []
    at: list[int] = []
    for step in range(steps - 1, -1, -1):
        now = tokens[step * lanes : (step + 1) * lanes]
        frequency, x = table.frequency.take(now), state[: len(now)]
        full = np.flatnonzero(x >= table.limit.take(now))
        if len(full):
            out = x[full]
            words.append(out.astype(np.uint32))
            written += len(out)
            x[full] = out >> _WORD
        whole = (x / frequency).astype(np.int64)
        x += whole * ((1 << table.bits) - frequency) + table.begin.take(now)
        if step % CHECK_STEPS == 0:
            states.append(state.copy())
            at.append(written)
    packed = np.concatenate(words).astype("<u4").tobytes() if words else b""
    kept = np.concatenate(states[::-1]).astype("<u8").tobytes() if states else b""
    block = Block(len(tokens), lanes, packed, kept, at[::-1], 0)
    block.crc32 = block.checksum()
    return block


def decode(block: Block, table: Table, checkpoint: int = 0, checkpoints: int | None = None) -> np.ndarray:
    """The tokens from a checkpoint on: of the whole rest, or of so many checkpoints."""
    if block.checksum() != block.crc32:
        raise DamagedBlock("a block of token codes is damaged")
    if not block.n_tokens:
        return np.empty(0, np.uint32)
    lanes = block.lanes
    steps = -(-block.n_tokens // lanes)
    first = checkpoint * CHECK_STEPS
    last = steps if checkpoints is None else min(steps, first + checkpoints * CHECK_STEPS)
    words = np.frombuffer(block.words, "<u4").astype(np.int64)
    states = np.frombuffer(block.states, "<u8").reshape(-1, lanes)
    state, end = states[checkpoint].astype(np.int64), block.at[checkpoint]
    tokens = np.empty(min(block.n_tokens, last * lanes) - first * lanes, np.uint32)
    for step in range(first, last):
        place = (step - first) * lanes
        x = state[: min(lanes, block.n_tokens - step * lanes)]
        slot = x & table.mask
        now = table.symbol.take(slot)
        tokens[place : place + len(x)] = now
        x = table.frequency.take(now) * (x >> table.bits) + slot - table.begin.take(now)
        low = np.flatnonzero(x < _LOW)
        if len(low):
            x[low] = (x[low] << _WORD) | words[end - len(low) : end]
            end -= len(low)
        state[: len(x)] = x
    return tokens
