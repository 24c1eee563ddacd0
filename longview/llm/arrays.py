"""Words of many texts as numpy arrays of 64-bit hashes.

Byte ``b`` at place ``i`` of a buffer adds ``TABLE[b] * M**i`` to a running sum modulo 2**64, so that
the hash of any span is a difference of two sums, moved to place 0 by a power of the inverse of ``M``.
All of it is array arithmetic. Long texts are taken in pieces that end between words, which bounds the
memory of a batch whatever the texts' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc

PIECE = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(77))
TABLE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
#: Factors of the words of a window, by their place in it.
PLACES = _rng.integers(1, 2**64 - 1, 64, dtype=np.uint64) | np.uint64(1)
M = 0x9E3779B97F4A7C15
_INVERSE = pow(M, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i for i of 0..n-1 at least."""
    if len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        for k, m in enumerate((M, _INVERSE)):
            x = np.full(size, m, dtype=np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(values: np.ndarray) -> np.ndarray:
    """Running sums of ``values[i] * M**i``, from 0."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hash(running: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((running[stop] - running[start]) * powers(len(running))[1][start])


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words of a buffer."""
    edge = np.diff(np.concatenate(([True], SPACE[buf], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end at white space; a longer word stays whole."""
    at = 0
    while len(text) - at > PIECE:
        gap = np.flatnonzero(SPACE[np.frombuffer(text, np.uint8, PIECE, at)])
        if gap.size:
            stop = at + int(gap[-1]) + 1
        else:
            rest = np.flatnonzero(SPACE[np.frombuffer(text, np.uint8, -1, at + PIECE)])
            stop = at + PIECE + int(rest[0]) + 1 if rest.size else len(text)
        yield text[at:stop]
        at = stop
    if at < len(text):
        yield text[at:]


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buffer, index of each text in it, its start there), texts being parted by a line feed."""
    part: list[bytes] = []
    of: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        for x in _cut(t) if len(t) > PIECE else (t,):
            if part and size + len(x) > PIECE:
                yield _joined(part, of)
                part, of, size = [], [], 0
            part.append(x)
            of.append(i)
            size += len(x) + 1
    if part:
        yield _joined(part, of)


def _joined(part: list[bytes], of: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8), np.array(of), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each lower-cased word of all texts, and the number of the text that it is from."""
    hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    with np.errstate(over="ignore"):
        for buf, of, starts in pieces(texts):
            a, b = spans(buf)
            hashes.append(span_hash(sums(TABLE[LOWER[buf]]), a, b))
            docs.append(np.repeat(of, np.diff(np.append(np.searchsorted(a, starts), len(a)))))
    return np.concatenate(hashes), np.concatenate(docs)


def windows(hashes: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, first word) of each window of ``k`` words inside one text."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += hashes[j : j + n] * PLACES[j]
        out = mix(out)
    at = np.flatnonzero(docs[:n] == docs[k - 1 :][:n])
    return out[at], docs[at], at


def small(batches, column: int, limit: int = 1 << 21):
    """Batches of rows with some ``limit`` bytes of text in ``column``, or one row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield b.slice(at, stop - at)
            at = stop


def as_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty."""
    return [x or b"" for x in column.cast("binary").to_pylist()]
