"""Words of many texts at once: places and 64-bit hashes, computed on one byte buffer without a loop over words."""

from __future__ import annotations

import numpy as np

from tenura.llm.common import mixed

#: An odd multiplier; its powers and those of its inverse modulo 2 ** 64 shift a hash along the buffer.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
#: White space of the contract: space and the five ASCII controls from tab to carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.isin(np.arange(256), list(SPACES))
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_powers = {STEP: np.ones(1, np.uint64), BACK: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    known = _powers[base]
    if len(known) < n:
        grown = np.full(max(n, 1 << 20), base, np.uint64)
        grown[0] = 1
        known = _powers[base] = np.cumprod(grown, dtype=np.uint64)
    return known[:n]


#: Bytes that are hashed at a time.
WINDOW = 1 << 19


def words_of(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a byte buffer; equal words have equal hashes wherever they stand.

    Long buffers are hashed in windows that end at white space, so beside the words only one window's sums are held.
    """
    parts = []
    at = 0
    while at < len(buffer):
        end = at + WINDOW
        while end < len(buffer):  # to the next white space
            gap = np.flatnonzero(IS_SPACE[buffer[end : end + WINDOW]])
            if len(gap):
                end += int(gap[0])
                break
            end += WINDOW
        end = min(end, len(buffer))
        starts, ends, hashes = _window(buffer[at:end])
        parts.append((starts + at, ends + at, hashes))
        at = end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))


def _window(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gap = np.concatenate([[True], IS_SPACE[buffer], [True]])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(STEP, len(buffer)), dtype=np.uint64, out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(BACK, len(buffer) + 1)[starts]
    return starts, ends, mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(STEP))


def joined(texts: list[str | None], table: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, a line feed after each, and where each text starts (one entry more than texts)."""
    parts = [(t or "").encode() + b"\n" for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    data = b"".join(parts)
    if table is not None:
        data = data.translate(table)
    return np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(sizes)])
