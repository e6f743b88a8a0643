"""Baseline JPEG frames to their luma, by the tables that they carry."""

from __future__ import annotations

import struct

import numpy as np

#: The order of coefficients, by rows of the block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: The standard's Huffman tables (codes of each length, symbols), for frames of motion-JPEG without their own.
#: The symbols of AC tables go on in ascending order with the runs and sizes (1 to 10) that aren't in front.
DC_LUMA = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), list(range(12))
DC_CHROMA = (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), list(range(12))
AC_LUMA = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), [
    0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1,
    0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82,
]
AC_CHROMA = (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), [
    0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42,
    0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1,
]


def completed(symbols: list[int]) -> list[int]:
    """AC symbols with those that follow by rule."""
    return symbols + [run << 4 | size for run in range(16) for size in range(1, 11) if run << 4 | size not in symbols]


def huffman(counts, symbols: list[int]) -> np.ndarray:
    """For each 16 bits that begin with a code its length << 8 and symbol; 0 where none does."""
    table = np.zeros(1 << 16, np.int32)
    code, at = 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            first = code << 16 - length
            table[first : first + (1 << 16 - length)] = length << 8 | symbol
            code += 1
        at += n
        code <<= 1
    return table


#: The transform of 8 coefficients to 8 samples.
WAVES = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class _Bits:
    """Bits of an interval of entropy-coded data, ones after its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data.replace(b"\xff\0", b"\xff") + b"\xff" * 8, 0, 0
        self.end = 8 * (len(self.data) - 8)

    def symbol(self, table: np.ndarray) -> int:
        i, shift = self.at >> 3, self.at & 7
        found = int(table[int.from_bytes(self.data[i : i + 3], "big") >> 8 - shift & 0xFFFF])
        self.at += found >> 8
        if not found or self.at > self.end:
            raise ValueError("a frame is damaged")
        return found & 0xFF

    def value(self, size: int) -> int:
        """A coefficient of so many bits."""
        if not size:
            return 0
        i, shift = self.at >> 3, self.at & 7
        bits = int.from_bytes(self.data[i : i + 4], "big") >> 32 - shift - size & (1 << size) - 1
        self.at += size
        if self.at > self.end:
            raise ValueError("a frame is damaged")
        return bits if bits >> size - 1 else bits - (1 << size) + 1


def _segments(frame: bytes):
    """(marker, body) of the segments up to the scan, whose body is all that follows it."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at = 2
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise ValueError("a frame is damaged")
        marker = frame[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", frame, at + 2)[0]
        yield marker, frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDA:
            yield None, frame[at:]
            return


def _intervals(data: bytes) -> list[bytes]:
    """Entropy-coded data up to the end marker, cut at restart markers."""
    out, begin, at = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            out.append(data[begin:])
            return out
        marker = data[at + 1]
        if 0xD0 <= marker <= 0xD7:
            out.append(data[begin:at])
            begin = at + 2
        elif marker not in (0, 0xFF):
            out.append(data[begin:at])
            return out
        at += 1 if marker == 0xFF else 2


def luma(frame: bytes) -> np.ndarray:
    """Samples (rows, columns) of the first component of a baseline frame (sequential, 8 bits, Huffman-coded, one scan)."""
    quantizers, tables, shape, components, restart, order, data = {}, {}, None, [], 0, [], b""
    for i, (dc, ac) in enumerate(((DC_LUMA, AC_LUMA), (DC_CHROMA, AC_CHROMA))):
        tables[0, i], tables[1, i] = dc, (ac[0], completed(ac[1]))
    for marker, body in _segments(frame):
        if marker is None:
            data = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantizers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[129 if wide else 65 :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = tuple(body[1:17]), list(body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            precision, rows, columns, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("samples of other than 8 bits")
            shape, components = (rows, columns), [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            restart = struct.unpack_from(">H", body)[0]
        elif marker == 0xDA:
            order = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
    if shape is None or len(order) != len(components):
        raise ValueError("not a frame of one scan")
    across, down = max(c[1] for c in components), max(c[2] for c in components)
    single = len(components) == 1
    if single:  # its blocks stand one by one, whatever its sampling
        components = [(components[0][0], 1, 1, components[0][3])]
        across = down = 1
    wide, high = -(-shape[1] // (8 * across)), -(-shape[0] // (8 * down))
    coded = {key: huffman(*table) for key, table in tables.items()}
    plan = []
    for c, (name, h, v, _) in enumerate(components):
        dc, ac = next((dc, ac) for which, dc, ac in order if which == name)
        plan.append((c, h, v, coded[0, dc], coded[1, ac]))
    blocks = np.zeros((high * components[0][2], wide * components[0][1], 64), np.int64)
    intervals = iter(_intervals(data))
    bits, last = None, []
    for unit in range(wide * high):
        if bits is None or restart and unit % restart == 0:
            bits, last = _Bits(next(intervals, b"")), [0] * len(components)
        for c, h, v, dc, ac in plan:
            for y in range(v):
                for x in range(h):
                    last[c] += bits.value(bits.symbol(dc))
                    block = blocks[unit // wide * v + y, unit % wide * h + x] if c == 0 else None
                    if block is not None:
                        block[0] = last[c]
                    k = 1
                    while k < 64:
                        symbol = bits.symbol(ac)
                        if not symbol & 15:
                            if symbol != 0xF0:
                                break
                            k += 16
                            continue
                        k += symbol >> 4
                        value = bits.value(symbol & 15)
                        if k > 63:
                            raise ValueError("a frame is damaged")
                        if block is not None:
                            block[k] = value
                        k += 1
    spread = np.zeros_like(blocks)
    spread[..., ZIGZAG] = blocks * quantizers[components[0][3]]
    samples = WAVES.T @ spread.reshape(*blocks.shape[:2], 8, 8) @ WAVES
    image = np.clip(np.rint(samples + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, -1)
    return image[: -(-shape[0] * components[0][2] // down), : -(-shape[1] * components[0][1] // across)]
