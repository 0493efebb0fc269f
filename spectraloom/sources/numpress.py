"""The three published ways of packing the numbers of a spectrum into few bytes.

``linear`` keeps scaled m/z as differences from a line through the last two values, ``slof`` keeps
scaled logarithms of intensities in two bytes, ``pic`` keeps rounded counts. ``linear`` and ``pic`` write
each whole number as a half byte that tells how many of its leading half bytes are left out (0 to 8
zeros, or 9 to 15 for one to seven that are all ones), and then the others, the lowest first.
"""

from __future__ import annotations

import base64
import struct
import zlib

WAYS = ("linear", "slof", "pic")


def whole_numbers(data: bytes):
    """The whole numbers (32 bits, signed) of packed half bytes, the high half of a byte first."""
    halves = [h for b in data for h in (b >> 4, b & 15)]
    at, out = 0, []
    while at < len(halves):
        head = halves[at]
        left = 8 - head if head <= 8 else 16 - head
        if at + 1 + left > len(halves) or left == 8 and at + 1 == len(halves):
            break
        value = 0 if head <= 8 else -1 << 4 * left
        for k in range(left):
            value |= halves[at + 1 + k] << 4 * k
        value &= 0xFFFFFFFF
        out.append(value - (1 << 32) if value >> 31 else value)
        at += 1 + left
        if at == len(halves) - 1 and halves[at] == 0:  # the half that fills the last byte
            break
    return out


def unpack(data: bytes, way: str):
    import numpy as np

    if way == "pic":
        return np.array(whole_numbers(data), float)
    if len(data) < 8:
        return np.empty(0)
    (scale,) = struct.unpack(">d", data[:8])
    if way == "slof":
        return np.exp(np.frombuffer(data[8:], "<u2") / scale) - 1
    out = [struct.unpack_from("<I", data, 8 + 4 * k)[0] for k in range(min(2, (len(data) - 8) // 4))]
    for off in whole_numbers(data[16:]):
        out.append(2 * out[-1] - out[-2] + off)
    return np.array(out, float) / scale


def decode(text: str | None, way: str, packed: bool = False):
    raw = base64.b64decode(text or "")
    return unpack(zlib.decompress(raw) if packed and raw else raw, way)
