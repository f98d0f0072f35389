"""Word shingles as numpy arrays, for the stages that run Python over Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
CHUNK = 1024   # shingles permuted at a time, which bounds memory for texts of any length


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
SECRET = bytes.fromhex("b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671fcb79e64eccc0e578825ad07dccff7221b8084674f743248e")   # of xxh3
PRIMES = tuple(map(np.uint64, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x9FB21C651E98DF25, 0x165667919E3779F9)))


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (xxh3 of the word, as ``word_hashes``), first byte and end of each word between ASCII white space, without a
    Python object for words of 16 bytes or less. ``data`` is in lower case."""
    raw = np.frombuffer(data, np.uint8)
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = BLANK[raw]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    n = ends - starts
    out = np.empty(len(n), np.uint64)
    flip = lambda kind, *at: np.bitwise_xor(*(np.frombuffer(SECRET, kind, 1, k)[0] for k in at)).astype(np.uint64)
    many = lambda kind: np.ndarray(max(len(data) - np.dtype(kind).itemsize + 1, 0), kind, data, strides=(1,))   # noqa: E731  a number at every byte
    up = lambda h, k: h ^ (h >> np.uint64(k))
    turn = lambda h, k: (h << np.uint64(k)) | (h >> np.uint64(64 - k))

    at = np.flatnonzero(n <= 3)
    s, k = starts[at], n[at]
    h = raw[s].astype(np.uint64) << np.uint64(16) | raw[s + (k >> 1)].astype(np.uint64) << np.uint64(24) | raw[s + k - 1] | k.astype(np.uint64) << np.uint64(8)
    out[at] = up(up(up(h ^ flip("<u4", 0, 4), 33) * PRIMES[0], 29) * PRIMES[1], 32)

    at = np.flatnonzero((n > 3) & (n <= 8))
    s, k, number = starts[at], n[at], many("<u4")
    h = (number[s + k - 4] + (number[s].astype(np.uint64) << np.uint64(32))) ^ flip("<u8", 8, 16)
    h = (h ^ turn(h, 49) ^ turn(h, 24)) * PRIMES[2]
    out[at] = up((h ^ ((h >> np.uint64(35)) + k.astype(np.uint64))) * PRIMES[2], 28)

    at = np.flatnonzero((n > 8) & (n <= 16))
    s, k, number = starts[at], n[at], many("<u8")
    low, high = number[s] ^ flip("<u8", 24, 32), number[s + k - 8] ^ flip("<u8", 40, 48)
    out[at] = up(up(k.astype(np.uint64) + low.byteswap() + high + _folded(low, high), 37) * PRIMES[3], 32)

    at = np.flatnonzero(n > 16)
    out[at] = np.fromiter((xxhash.xxh3_64_intdigest(data[x:y]) for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)), np.uint64, len(at))
    return out, starts, ends


def _folded(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Both halves of the product of 128 bits, one on the other."""
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    a, b, c, d = x & low, x >> half, y & low, y >> half
    ac, bc, ad = a * c, b * c, a * d
    cross = (ac >> half) + (bc & low) + ad
    return (x * y) ^ (b * d + (bc >> half) + (cross >> half))


def split_words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on; there must be as many."""
    n, out, done, span = len(hashes) - width + 1, np.full(1, np.uint64(width)), 0, 1
    if n < 1:
        raise ValueError("fewer words than a shingle has")
    spans = {1: hashes}                  # of 1, 2, 4 ... words: polynomials in ODD, the first word's power the highest
    while 2 * span <= width:
        spans[2 * span] = spans[span][:-span] * _power(span) + spans[span][span:]
        span *= 2
    for span in sorted(spans, reverse=True):
        if width & span:
            out = out * _power(span) + spans[span][done: done + n]
            done += span
    return mixed(out)


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(ODD), k, 1 << 64))


def shingle_set(ws: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words make one shingle, no words none."""
    if not ws:
        return np.zeros(0, np.uint64)
    return np.unique(rolled(word_hashes(ws), min(width, len(ws))))


def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def minhash(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation over the set."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(low, (hashes[at: at + CHUNK, None] * a + b).min(axis=0), out=low)
    return low


def coordinate_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key for each coordinate and its value."""
    return mixed(low + np.arange(1, len(low) + 1, dtype=np.uint64) * ODD).view(np.int64)


def digest(hashes: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    return xxhash.xxh3_128_digest(hashes.tobytes())
