"""Rolling hashes, window minima and packed byte strings over concatenated texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
S31, S29 = np.uint64(31), np.uint64(29)
#: Bytes that are hashed at a time.
SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S31)) * M1
    return x ^ (x >> S29)


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((a * M2) ^ b)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes at each place, by doubling."""
    power, width, done, have = mix(data.astype(np.uint64) + M2), 1, None, 0
    while True:
        if k & 1:
            n = len(data) - have - width + 1
            if n <= 0:
                return np.empty(0, np.uint64)
            done = power[:n].copy() if done is None else join(done[:n], power[have : have + n])
            have += width
        k >>= 1
        if not k:
            return done
        n = len(power) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        power, width = join(power[:n], power[width : width + n]), 2 * width


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    if len(x) < w:
        return x[:0]
    width = 1
    while 2 * width <= w:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    return np.minimum(x[: len(x) - (w - width)], x[w - width :]) if w > width else x


def segments(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in concatenated pieces of bounded size that overlap by window - 1 bytes:
    (bytes, number of the text, where the piece begins in it, where it begins in bytes)."""
    held, owner, begin, size = [], [], [], 0

    def flush():
        data = np.frombuffer(b"".join(held), np.uint8)
        return data, np.array(owner), np.array(begin), np.cumsum([0, *map(len, held)])

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), SEGMENT):
            piece = text[at : at + SEGMENT + window - 1]
            if len(piece) < window:
                continue
            held.append(piece)
            owner.append(i)
            begin.append(at)
            size += len(piece)
            if size >= SEGMENT:
                yield flush()
                held, owner, begin, size = [], [], [], 0
    if held:
        yield flush()


def runs(data: np.ndarray, edges: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their least gram hash: (hash, number of the piece, first window, end of the windows)."""
    least = window_min(gram_hashes(data, gram), window - gram + 1)
    n = len(least)
    piece = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[:n]
    valid = np.arange(n) + window <= edges[1:][piece]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (piece[1:] != piece[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    end = np.r_[first[1:], n] if len(first) else first
    good = valid[first]
    first, end = first[good], end[good]
    return least[first], piece[first], first, end
