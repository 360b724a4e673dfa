"""Byte codecs on numpy arrays: Elias-Fano, two-bit bases, qualities, identifiers, zstd, base64."""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import zstandard

# Fixed values of the format: base codes, source encodings, compression level.
BASE_CODES = {"A": 0, "T": 1, "G": 2, "C": 3}
ENCODINGS = {"f32": "<f4", "f64": "<f8", "i32": "<i4", "i64": "<i8"}
ZSTD_LEVEL = 1

_BASES = np.frombuffer(b"ATGC", np.uint8)
_CODE_OF = np.full(256, 255, np.uint8)
_CODE_OF[_BASES] = np.arange(4)


def zstd(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress(data)


def unzstd(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def floats_to_base64(values, encoding: str = "f32") -> str:
    return base64.b64encode(np.asarray(values, ENCODINGS[encoding]).tobytes()).decode()


def base64_to_floats(text: str, encoding: str = "f32") -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ENCODINGS[encoding])


def decode_array(data: bytes, encoding: str, compressed: bool) -> np.ndarray:
    """Bytes of an external array as doubles; ``compressed``: zlib."""
    raw = zlib.decompress(data) if compressed else data
    return np.frombuffer(raw, ENCODINGS[encoding]).astype(np.float64)


def low_bits(n: int, last: int) -> int:
    """Width of the stored low parts: 0 if last <= n, else ceil(log2(last / n))."""
    if last <= n:
        return 0
    width = max(0, (-(-last // n)).bit_length() - 1)
    return width if n << width >= last else width + 1


def ef_encode(values, word: int = 32) -> bytes:
    """Elias-Fano code of a non-decreasing array as little-endian words; empty for an empty array.

    Unary upper parts, then low parts with the highest bit first; the last two
    words are the count and 100 * upper bits + width of a low part.
    """
    x = np.asarray(values, np.uint64)
    if not len(x):
        return b""
    if len(x) > 1 and (x[1:] < x[:-1]).any():
        raise ValueError("Elias-Fano needs a non-decreasing array")
    n, last = len(x), int(x[-1])
    width = low_bits(n, last)
    ones = (x >> np.uint64(width)).astype(np.int64) + np.arange(n)
    upper = int(ones[-1]) + 1
    size = -(-n * (width + 2) // word) * word
    bits = np.zeros(max(size, -(-(upper + n * width) // word) * word), np.uint8)
    bits[ones] = 1
    if width:
        low = bits[upper : upper + n * width].reshape(n, width)
        for k in range(width):  # a bit of all values at a time, which holds a word for each value, not for each bit
            low[:, k] = (x >> np.uint64(width - 1 - k)) & np.uint64(1)
    kind = "u4" if word == 32 else "u8"
    words = np.packbits(bits).view(">" + kind).astype("<" + kind)
    return np.append(words, np.array([n, upper * 100 + width], "<" + kind)).astype("<" + kind).tobytes()


def ef_decode(code: bytes, word: int = 32) -> np.ndarray:
    if not code:
        return np.zeros(0, np.uint64)
    kind = "u4" if word == 32 else "u8"
    words = np.frombuffer(code, "<" + kind)
    n, tail = int(words[-2]), int(words[-1])
    upper, width = divmod(tail, 100)
    bits = np.unpackbits(words[:-2].astype(">" + kind).view(np.uint8))
    high = (np.flatnonzero(bits[:upper])[:n] - np.arange(n)).astype(np.uint64)
    if not width:
        return high
    low = bits[upper : upper + n * width].reshape(n, width)
    out = high << np.uint64(width)
    for k in range(width):
        out |= low[:, k].astype(np.uint64) << np.uint64(width - 1 - k)
    return out


def delta(values: np.ndarray) -> np.ndarray:
    """Differences of a prefix sum, as integers; the first value as it is."""
    x = np.asarray(values).astype(np.int64)
    return np.diff(x, prepend=np.int64(0))


def run_lengths(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start values and lengths of runs, the last run included."""
    if not len(symbols):
        return symbols[:0], np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
    return symbols[start], np.diff(np.r_[start, len(symbols)])


def pack_bases(sequence: bytes) -> tuple[bytes, np.ndarray, bytes]:
    """Two bits a base, first base highest; other letters count as A and are returned with their positions."""
    raw = np.frombuffer(sequence, np.uint8)
    code = _CODE_OF[raw]
    other = np.flatnonzero(code == 255)
    code = np.where(code == 255, 0, code).astype(np.uint8)
    code = np.append(code, np.zeros(-len(code) % 4, np.uint8)).reshape(-1, 4)
    packed = code[:, 0] << 6 | code[:, 1] << 4 | code[:, 2] << 2 | code[:, 3]
    return packed.astype(np.uint8).tobytes(), other.astype("<u4"), raw[other].tobytes()


def unpack_bases(packed: bytes, count: int, other: np.ndarray, letters: bytes) -> bytes:
    raw = np.frombuffer(packed, np.uint8)
    code = (raw[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel()[:count]
    out = _BASES[code].copy()
    out[np.asarray(other, np.int64)] = np.frombuffer(letters, np.uint8)
    return out.tobytes()


def encode_quality(symbols: bytes) -> tuple[bytes, bytes]:
    """Alphabet by falling frequency (ties by symbol), and the Elias-Fano code of the running sum of (rank, run) pairs.

    One distinct symbol needs no code beyond its count.
    """
    raw = np.frombuffer(symbols, np.uint8)
    if not len(raw):
        return b"", b""
    kinds, counts = np.unique(raw, return_counts=True)
    order = np.lexsort((kinds, -counts))
    alphabet = kinds[order]
    rank = np.zeros(256, np.int64)
    rank[alphabet] = np.arange(len(alphabet))
    value, length = run_lengths(raw)
    stream = np.stack([rank[value], length], 1).ravel()
    return alphabet.tobytes(), zstd(ef_encode(np.cumsum(stream), 64))


def decode_quality(alphabet: bytes, code: bytes) -> bytes:
    if not alphabet:
        return b""
    stream = delta(ef_decode(unzstd(code), 64)).reshape(-1, 2)
    return np.repeat(np.frombuffer(alphabet, np.uint8)[stream[:, 0]], stream[:, 1]).tobytes()


_NUMBER = re.compile(r"0|[1-9][0-9]{0,17}")


def tokenize_id(identifier: str) -> list[str]:
    """Tokens between colons; a blank is a token of its own, written as a tab; a trailing empty token is dropped."""
    tokens = identifier.replace(" ", ":\t:").split(":")
    return tokens[:-1] if tokens and tokens[-1] == "" else tokens


def encode_ids(identifiers: list[str]) -> tuple[list, bytes]:
    """Key and code of a batch of identifiers.

    Each token column is constant, numeric (all rows plain integers) or a dictionary
    in order of first appearance; the columns' numbers follow one another in the
    code as a running sum.  Ragged batches, and identifiers that tokens don't
    restore, are kept as a dictionary of whole identifiers.
    """
    rows = [tokenize_id(s) for s in identifiers]
    if {len(r) for r in rows} != {len(rows[0])} or not rows[0] or any(":".join(r).replace(":\t:", " ") != s for r, s in zip(rows, identifiers)):
        return _encode_whole(identifiers)
    key, numbers = [], []
    for column in zip(*rows):
        distinct = list(dict.fromkeys(column))
        if len(distinct) == 1:
            key.append(["c", distinct[0]])
        elif all(_NUMBER.fullmatch(t) for t in distinct):
            low = min(map(int, distinct))
            key.append(["n", low])
            numbers.append(np.array([int(t) - low for t in column], np.int64))
        else:
            at = {t: k for k, t in enumerate(distinct)}
            key.append(["d", distinct])
            numbers.append(np.array([at[t] for t in column], np.int64))
    if not numbers:
        return key, b""
    flat = np.concatenate(numbers)
    if float(flat.astype(np.float64).sum()) >= 2**62:
        return _encode_whole(identifiers)
    return key, zstd(ef_encode(np.cumsum(flat), 64))


def _encode_whole(identifiers: list[str]) -> tuple[list, bytes]:
    distinct = list(dict.fromkeys(identifiers))
    at = {t: k for k, t in enumerate(distinct)}
    return [["w", distinct]], zstd(ef_encode(np.cumsum([at[t] for t in identifiers]), 64))


def decode_ids(key: list, code: bytes, count: int) -> list[str]:
    flat = delta(ef_decode(unzstd(code), 64)).reshape(-1, count) if code else np.zeros((0, count), np.int64)
    if key and key[0][0] == "w":
        return [key[0][1][v] for v in flat[0].tolist()]
    columns, used = [], 0
    for kind, what in key:
        if kind == "c":
            columns.append([what] * count)
            continue
        x = flat[used]
        used += 1
        columns.append([str(what + v) for v in x.tolist()] if kind == "n" else [what[v] for v in x.tolist()])
    return [":".join(r).replace(":\t:", " ") for r in zip(*columns)]
