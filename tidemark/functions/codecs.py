"""Lossless codecs and transforms over arrays, as Arrow functions on columns."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


class Bits:
    """Bits appended to an integer buffer, most significant first."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def put(self, value: int, width: int) -> None:
        if width:
            self.parts.append(format(value & ((1 << width) - 1), f"0{width}b"))

    def done(self) -> bytes:
        s = "".join(self.parts)
        return int(s + "0" * (-len(s) % 8), 2).to_bytes((len(s) + 7) // 8, "big") if s else b""


class Reader:
    def __init__(self, data: bytes):
        self.s, self.at = "".join(format(b, "08b") for b in data), 0

    def get(self, width: int) -> int:
        self.at += width
        return int(self.s[self.at - width : self.at] or "0", 2)


def _bits_of(x: float) -> int:
    return struct.unpack(">Q", struct.pack(">d", x))[0]


def xor_encode(values: list[float]) -> bytes:
    """Floating-point values by the exclusive or with the value before: leading zeros, length, bits."""
    out = Bits()
    out.put(len(values), 32)
    prev, lead, size = 0, -1, 0
    for i, v in enumerate(values):
        b = _bits_of(v)
        if i == 0:
            out.put(b, 64)
        else:
            x = b ^ prev
            if not x:
                out.put(0, 1)
            else:
                z, t = min(31, 64 - x.bit_length()), (x & -x).bit_length() - 1
                if lead >= 0 and z >= lead and t >= 64 - lead - size:
                    out.put(0b10, 2)
                else:
                    lead, size = z, 64 - z - t
                    out.put(0b11, 2)
                    out.put(lead, 5)
                    out.put(size - 1, 6)
                out.put(x >> (64 - lead - size), size)
        prev = b
    return out.done()


def xor_decode(data: bytes) -> list[float]:
    r = Reader(data)
    n, prev, lead, size, out = r.get(32), 0, 0, 0, []
    for i in range(n):
        if i == 0:
            prev = r.get(64)
        elif r.get(1):
            if r.get(1):
                lead, size = r.get(5), r.get(6) + 1
            prev ^= r.get(size) << (64 - lead - size)
        out.append(struct.unpack(">d", struct.pack(">Q", prev))[0])
    return out


#: Prefix, its bits, and bits of the value for a second difference (fixed values).
_CLASSES = ((0b10, 2, 7), (0b110, 3, 9), (0b1110, 4, 12), (0b1111, 4, 64))


def times_encode(times: list[int]) -> bytes:
    """Times by their second differences in five size classes."""
    out = Bits()
    out.put(len(times), 32)
    prev = delta = 0
    for i, t in enumerate(times):
        if i == 0:
            out.put(t, 64)
        else:
            d2 = (t - prev) - delta
            delta = t - prev
            if not d2:
                out.put(0, 1)
            else:
                prefix, bits, width = next(c for c in _CLASSES if -(1 << (c[2] - 1)) <= d2 < 1 << (c[2] - 1))
                out.put(prefix, bits)
                out.put(d2, width)
        prev = t
    return out.done()


def times_decode(data: bytes) -> list[int]:
    r = Reader(data)
    n, prev, delta, out = r.get(32), 0, 0, []
    signed = lambda x, w: x - (1 << w) if x >> (w - 1) else x
    for i in range(n):
        if i == 0:
            prev = signed(r.get(64), 64)
        else:
            ones = 0
            while ones < 4 and r.get(1):
                ones += 1
            delta += signed(r.get(w := _CLASSES[ones - 1][2]), w) if ones else 0
            prev += delta
        out.append(prev)
    return out


def varint_encode(values: list[int]) -> bytes:
    """Signed integers, zigzag folded, seven bits a byte."""
    out = bytearray()
    for v in values:
        z = (v << 1) ^ (v >> 63)
        z &= 0xFFFFFFFFFFFFFFFF
        while z >= 0x80:
            out.append(z & 0x7F | 0x80)
            z >>= 7
        out.append(z)
    return bytes(out)


def varint_decode(data: bytes) -> list[int]:
    out, z, shift = [], 0, 0
    for b in data:
        z |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            out.append((z >> 1) ^ -(z & 1))
            z = shift = 0
    return out


def huffman_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Code length of each symbol of an optimal prefix code."""
    import heapq

    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    heap = [(c, s, (s,)) for s, c in sorted(counts.items())]
    heapq.heapify(heap)
    depth = dict.fromkeys(counts, 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return depth


def canonical_codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Code and length of each symbol, by length and then symbol."""
    out, code, last = {}, 0, 0
    for s, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[s], last = (code, n), n
        code += 1
    return out


def arrow(f, kind: str):
    """A Python function of one list or bytes as a column function."""
    target = {"binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}[kind]
    return F.arrow_udf(lambda a: pa.array([None if x is None else f(x) for x in a.to_pylist()], target), kind)


def dft_magnitudes(column: Column) -> Column:
    """Magnitudes of the discrete Fourier transform of an array."""
    return arrow(lambda x: np.abs(np.fft.fft(x)).tolist(), "array<double>")(column)


def dct(values: list[float]) -> np.ndarray:
    """Orthonormal cosine transform (type 2)."""
    n = len(values)
    k = np.arange(n)
    out = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) @ np.asarray(values, float) * np.sqrt(2 / n)
    out[0] /= np.sqrt(2)
    return out


def inverse_dct(values: list[float]) -> np.ndarray:
    n = len(values)
    k, x = np.arange(n), np.asarray(values, float).copy()
    x[0] /= np.sqrt(2)
    return np.cos(np.pi * (2 * k[:, None] + 1) * k[None, :] / (2 * n)) @ x * np.sqrt(2 / n)


def soft_threshold(column: Column, level: float) -> Column:
    return F.transform(column, lambda x: F.signum(x) * F.greatest(F.abs(x) - level, F.lit(0.0)))


def top_coefficients(column: Column, k: int) -> Column:
    """The k coefficients of largest size as (index, value), largest first, ties to the lower index."""
    pairs = F.transform(column, lambda x, i: F.struct((-F.abs(x)).alias("o"), i.alias("index"), x.alias("value")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p["index"].alias("index"), p["value"].alias("value")))


#: Values in a word and bits of each, by selector (fixed values of the 64-bit word layout).
_PACKS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))


def words_encode(values: list[int]) -> bytes:
    """Non-negative integers below 2^60 packed into 64-bit words with a 4-bit selector; the count goes first."""
    out, i = [struct.pack("<Q", len(values))], 0
    while i < len(values):
        for sel, (n, bits) in enumerate(_PACKS):
            part = values[i : i + n]
            if len(part) < n and bits == 0:
                continue
            if all(0 <= v < 1 << bits if bits else v == 0 for v in part):
                word = sel << 60
                for k, v in enumerate(part):
                    word |= v << (k * bits) if bits else 0
                out.append(struct.pack("<Q", word))
                i += len(part)
                break
        else:
            raise ValueError("a value does not fit 60 bits")
    return b"".join(out)


def words_decode(data: bytes) -> list[int]:
    (total,), out = struct.unpack_from("<Q", data), []
    for at in range(8, len(data), 8):
        (word,) = struct.unpack_from("<Q", data, at)
        n, bits = _PACKS[word >> 60]
        out += [(word >> (k * bits)) & ((1 << bits) - 1) if bits else 0 for k in range(min(n, total - len(out)))]
    return out


def huffman_encode(values: list[int], codes: dict[int, tuple[int, int]]) -> bytes:
    out = Bits()
    out.put(len(values), 32)
    for v in values:
        out.put(*codes[v])
    return out.done()


def huffman_decode(data: bytes, codes: dict[int, tuple[int, int]]) -> list[int]:
    back = {(n, c): s for s, (c, n) in codes.items()}
    r = Reader(data)
    total, out = r.get(32), []
    while len(out) < total:
        c = n = 0
        while (n, c) not in back:
            c, n = c << 1 | r.get(1), n + 1
        out.append(back[(n, c)])
    return out


#: Cosine terms of the window shapes (fixed values).
_WINDOWS = {"rectangular": (1.0,), "hann": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08), "blackman_harris": (0.35875, 0.48829, 0.14128, 0.01168)}


def window_shape(kind: str, n: int) -> Column:
    """An array of n weights."""
    terms = _WINDOWS[kind]

    def weight(i: Column) -> Column:
        total = F.lit(0.0)
        for k, a in enumerate(terms):
            total = total + (-1) ** k * a * F.cos(2 * np.pi * k * i / max(1, n - 1))
        return total

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), weight)


def hard_threshold(column: Column, level: float) -> Column:
    return F.transform(column, lambda x: F.when(F.abs(x) >= level, x).otherwise(F.lit(0.0)))
