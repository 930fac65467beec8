"""Progressive JPEG: a decoder in numpy for 8-bit Huffman-coded files, and an encoder that stores bytes as coefficients.

The decoder accumulates spectral-selection and successive-approximation scans into coefficient arrays, inverse-transforms
them, upsamples the chroma and converts to RGB (ITU-T T.81, JFIF). Scans whose Huffman table holds one code have a fixed
layout and are read with a few array operations; all others are read bit by bit.

The encoder puts 64 bytes of a payload into the 64 coefficients of a block, in zigzag order: byte b is coefficient b from
128 on and b - 255 below, the value whose eight magnitude bits are b. Every coefficient then has the same size category, so
each table needs one code. Quantisation is by 1, so coefficients, and with them the payload, are kept exactly.
"""

from __future__ import annotations

import functools
import re
import struct

#: Block size, MCUs of a row and of a frame at most. Longer payloads take several frames, one file after another.
ROW, FRAME = 32, 1024
#: Spectral bands of the luma's first AC scans; chroma has one. All are refined by one bit afterwards.
BANDS = ((1, 5), (6, 63))


@functools.cache
def zigzag():
    """Natural position of each coefficient in zigzag order: along the antidiagonals, in alternating direction."""
    import numpy as np

    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


@functools.cache
def inverse_dct():
    """64 x 64: rows are coefficients in zigzag order, columns samples."""
    import numpy as np

    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return np.kron(basis, basis)[zigzag()].astype(np.float32)


# --- writing -----------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbol: int, length: int) -> bytes:
    """A Huffman table of one code, all zeros, of the given length. kind: 0 for DC, 16 for AC."""
    return _segment(0xC4, bytes([kind, *(int(k == length) for k in range(1, 17)), symbol]))


def _scan(component: int, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([1, component, 0, first, last, high << 4 | low]))


def shape(blocks: int) -> tuple[int, int]:
    """MCUs across and down for so many blocks of payload; an MCU holds four luma and two chroma blocks."""
    units = max(1, -(-blocks // 6))
    down = -(-units // ROW)
    return -(-units // down), down


@functools.cache
def _heads(across: int, down: int):
    """What stands before each scan's data, by component: DC, first AC scans, refinement."""
    import numpy as np

    dqt = b"".join(_segment(0xDB, bytes([k]) + b"\x01" * 64) for k in (0,))
    sof = _segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    start = b"\xff\xd8" + dqt + sof
    out = []
    for c, blocks in ((1, 4 * across * down), (2, across * down), (3, across * down)):
        bands = BANDS if c == 1 else ((1, 63),)
        dc = _segment(0xDD, struct.pack(">H", 1)) + _table(0, 8, 8) + _scan(c, 0, 0, 0, 0)
        ac = [(_segment(0xDD, b"\0\0") if k == 0 else b"") + (_table(16, 0x07, 1) if k == 0 else b"") + _scan(c, a, b, 0, 1) for k, (a, b) in enumerate(bands)]
        n = blocks.bit_length() - 1
        refine = _table(16, n << 4, 1) + _scan(c, 1, 63, 1, 0)
        lead = np.array([0, *(blocks - (1 << n) >> k & 1 for k in range(n - 1, -1, -1))], np.uint8)
        out.append((blocks, dc, list(zip(bands, ac, strict=True)), refine, lead))
    return start, out


@functools.cache
def _restarts(n: int):
    import numpy as np

    out = np.zeros((n, 4), np.uint8)
    out[:, 2], out[:, 3] = 0xFF, 0xD0 + np.arange(n) % 8
    return out


def encode_frame(payload, note: bytes) -> bytes:
    """One file of the payload (a uint8 array, a multiple of 64 long). note: a comment segment."""
    import numpy as np

    across, down = shape(len(payload) // 64)
    start, parts = _heads(across, down)
    cells = np.zeros((6 * across * down, 64), np.uint8)
    cells.reshape(-1)[: len(payload)] = payload
    out, at = [start, _segment(0xFE, note)], 0
    for blocks, dc, bands, refine, lead in parts:
        x = cells[at : at + blocks]
        at += blocks
        head = x[:, 0]
        if (head == 255).any():  # a data byte 255 is followed by 0
            data = b"".join(bytes([0, b]) + (b"\0" if b == 255 else b"") + bytes([255, 0xD0 + k % 8]) for k, b in enumerate(head.tolist()))[:-2]
        else:
            marked = _restarts(blocks).copy()
            marked[:, 1] = head
            data = marked.tobytes()[:-2]
        out += [dc, data]
        half = x >> 1
        for (a, b), ac in bands:
            out += [ac, half[:, a : b + 1].tobytes()]
        bits = np.concatenate((lead, (((x[:, 1:] & 1) ^ (x[:, 1:] < 128)).reshape(-1))))
        pad = -len(bits) % 8
        packed = np.packbits(np.concatenate((bits, np.ones(pad, np.uint8))) if pad else bits).tobytes()
        out += [refine, packed.replace(b"\xff", b"\xff\0")]
    out.append(b"\xff\xd9")
    return b"".join(out)


def encode(payload: bytes) -> bytes:
    import numpy as np

    x = np.frombuffer(payload, np.uint8)
    step = 6 * 64 * FRAME
    return b"".join(encode_frame(x[at : at + step], b"%d" % len(x[at : at + step])) for at in range(0, len(x), step))


# --- reading -----------------------------------------------------------------------------------------------------------

MARK = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")
RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _codes(body: bytes):
    """Tables of a DHT segment: (kind and number, {(length, code): symbol})."""
    at = 0
    while at < len(body):
        kind, counts = body[at], body[at + 1 : at + 17]
        at += 17
        code, table = 0, {}
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                table[length, code] = body[at]
                code, at = code + 1, at + 1
            code <<= 1
        yield kind, table


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.size = int.from_bytes(data), 0, 8 * len(data)

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.at += n
        left = self.size - self.at
        return (self.data >> left if left >= 0 else (self.data << -left) | ((1 << -left) - 1)) & ((1 << n) - 1)

    def symbol(self, table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such Huffman code")

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> size - 1 else v - (1 << size) + 1


class Component:
    def __init__(self, number: int, h: int, v: int, quant: int):
        self.number, self.h, self.v, self.quant = number, h, v, quant


class Frame:
    """Size, components and coefficients of one file; coefs holds an int16 array (rows, columns, 64) for each component."""


def read_frames(data: bytes) -> list[Frame]:
    """Every file in data, one after another."""
    out, at = [], 0
    while at < len(data):
        frame, at = read_frame(data, at)
        out.append(frame)
    return out


def read_frame(data: bytes, at: int = 0, fast: bool = True) -> tuple[Frame, int]:
    """Accumulate all scans of the file at a position; also the position behind it."""
    import numpy as np

    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    frame, tables, at = Frame(), {}, at + 2
    frame.quants, frame.restart, frame.notes, frame.components = {}, 0, [], []
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        marker = data[at + 1]
        if marker == 0xD9:
            return frame, at + 2
        size = data[at + 2] << 8 | data[at + 3]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC4:
            tables.update(_codes(body))
        elif marker == 0xDD:
            frame.restart = body[0] << 8 | body[1]
        elif marker == 0xFE:
            frame.notes.append(body)
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                frame.quants[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.float32)
                k += 65 + 64 * wide
        elif marker in (0xC0, 0xC1, 0xC2):
            if body[0] != 8:
                raise ValueError("samples of 8 bits only")
            frame.height, frame.width = body[1] << 8 | body[2], body[3] << 8 | body[4]
            frame.components = [Component(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            h, v = max(c.h for c in frame.components), max(c.v for c in frame.components)
            frame.across, frame.down, frame.h, frame.v = -(-frame.width // (8 * h)), -(-frame.height // (8 * v)), h, v
            for c in frame.components:
                c.columns, c.rows = -(-(-(-frame.width * c.h // h)) // 8), -(-(-(-frame.height * c.v // v)) // 8)
            frame.coefs = [np.zeros((frame.down * c.v, frame.across * c.h, 64), np.int16) for c in frame.components]
        elif 0xC3 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("lossless, hierarchical and arithmetic files are not read")
        elif marker == 0xDA:
            end = MARK.search(data, at).start()
            _read_scan(frame, tables, body, data[at:end], fast)
            at = end


def _read_scan(frame: Frame, tables: dict, head: bytes, data: bytes, fast: bool) -> None:
    n = head[0]
    picked = [(next(i for i, c in enumerate(frame.components) if c.number == head[1 + 2 * k]), head[2 + 2 * k]) for k in range(n)]
    first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    if fast and n == 1 and _fixed_layout(frame, tables, picked[0], first, last, high, low, data):
        return
    parts = [x.replace(b"\xff\0", b"\xff") for x in RESTART.split(data)]
    if n == 1:
        i = picked[0][0]
        units = [[(i, y, x)] for y in range(frame.components[i].rows) for x in range(frame.components[i].columns)]
    else:
        units = [
            [(i, my * frame.components[i].v + y, mx * frame.components[i].h + x) for i, _ in picked for y in range(frame.components[i].v) for x in range(frame.components[i].h)]
            for my in range(frame.down)
            for mx in range(frame.across)
        ]
    use = dict(picked)
    step = frame.restart or len(units)
    for k, part in zip(range(0, len(units), step), parts, strict=False):
        bits, before, run = _Bits(part), dict.fromkeys(use, 0), 0
        for unit in units[k : k + step]:
            for i, y, x in unit:
                block = frame.coefs[i][y, x]
                if first == 0:
                    if high:
                        block[0] |= bits.take(1) << low
                    else:
                        before[i] += bits.value(bits.symbol(tables[use[i] >> 4]))
                        block[0] = before[i] << low
                    if last == 0:
                        continue
                at = max(1, first)
                table = tables[16 | use[i] & 15]
                run = _refine_block(bits, table, block, at, last, low, run) if high else _first_block(bits, table, block, at, last, low, run)


def _first_block(bits: _Bits, table: dict, block, at: int, last: int, low: int, run: int) -> int:
    """One block of a first AC scan; run: blocks that an end-of-band run still covers."""
    if run:
        return run - 1
    while at <= last:
        symbol = bits.symbol(table)
        zeros, size = symbol >> 4, symbol & 15
        if size:
            at += zeros
            block[at] = bits.value(size) * (1 << low)
            at += 1
        elif zeros == 15:
            at += 16
        else:
            return (1 << zeros) + bits.take(zeros) - 1
    return 0


def _refine_block(bits: _Bits, table: dict, block, at: int, last: int, low: int, run: int) -> int:
    """One block of a refining AC scan: correction bits for what is not zero yet, new coefficients between."""

    def correct(k: int) -> None:
        if bits.take(1):
            block[k] += (1 << low) if block[k] > 0 else -(1 << low)

    while not run and at <= last:
        symbol = bits.symbol(table)
        zeros, size = symbol >> 4, symbol & 15
        new = 0
        if size:
            new = 1 << low if bits.take(1) else -(1 << low)
        elif zeros < 15:
            run = (1 << zeros) + bits.take(zeros)
            break
        while at <= last:
            if block[at]:
                correct(at)
            elif zeros == 0:
                if new:
                    block[at] = new
                at += 1
                break
            else:
                zeros -= 1
            at += 1
    if run:
        for k in range(at, last + 1):
            if block[k]:
                correct(k)
        return run - 1
    return 0


def _fixed_layout(frame: Frame, tables: dict, pick: tuple[int, int], first: int, last: int, high: int, low: int, data: bytes) -> bool:
    """Reads the scan with array operations if its table has one code and so all of its fields a known place."""
    import numpy as np

    i, use = pick
    c, coefs = frame.components[i], frame.coefs[i]
    if coefs.shape[:2] != (c.rows, c.columns) or (first == 0 and (last or high)):
        return False
    table = tables[16 | use & 15 if first else use >> 4]
    if len(table) != 1:
        return False
    ((length, _), symbol), blocks = next(iter(table.items())), c.rows * c.columns
    flat = coefs.reshape(blocks, 64)
    if not first:
        if frame.restart != 1 or length != 8 or symbol != 8 or len(data) != 4 * blocks - 2:
            return False
        b = np.frombuffer(data + b"\0\0", np.uint8).reshape(blocks, 4)[:, 1].astype(np.int16)
        if (b == 255).any():
            return False
        flat[:, 0] = np.where(b >= 128, b, b - 255) << low
        return True
    if frame.restart:
        return False
    width = last - first + 1
    if not high:
        if symbol >> 4 or symbol & 15 != 7 or length != 1 or len(data) != blocks * width:
            return False
        b = np.frombuffer(data, np.uint8).reshape(blocks, width).astype(np.int16)
        flat[:, first : last + 1] = np.where(b >= 64, b, b - 127) * (1 << low)
        return True
    size = symbol >> 4
    if symbol & 15 or size > 14 or not flat[:, first : last + 1].all():
        return False
    raw = np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8)
    bits = np.unpackbits(raw)
    run = (1 << size) + int("0" + "".join(map(str, bits[length : length + size].tolist())), 2)
    if run != blocks or len(bits) < length + size + blocks * width:
        return False
    x = flat[:, first : last + 1]
    add = bits[length + size : length + size + blocks * width].reshape(blocks, width).astype(np.int16) << low
    flat[:, first : last + 1] = np.where(x > 0, x + add, x - add)
    return True


def payload(frame: Frame) -> bytes:
    """The bytes that encode() put into a frame's coefficients."""
    import numpy as np

    x = np.concatenate([c.reshape(-1, 64) for c in frame.coefs])
    if ((x > 255) | (x < -255) | ((x > -128) & (x < 128))).any():
        raise ValueError("coefficients that hold no payload byte")
    return np.where(x >= 0, x, x + 255).astype(np.uint8).tobytes()[: int(frame.notes[0])]


def rgb(frame: Frame):
    """A (height, width, 3) uint8 array: inverse transform, chroma repeated to full resolution, YCbCr to RGB."""
    import numpy as np

    planes = []
    for c, coefs in zip(frame.components, frame.coefs, strict=True):
        rows, columns = coefs.shape[:2]
        x = (coefs.reshape(-1, 64) * frame.quants[c.quant]).astype(np.float32) @ inverse_dct()
        x = x.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * columns)
        x = np.clip(np.rint(x) + 128, 0, 255)
        x = x.repeat(frame.v // c.v, axis=0).repeat(frame.h // c.h, axis=1)
        planes.append(x[: frame.height, : frame.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((*y.shape, 3), np.float32)
    out[:, :, 0], out[:, :, 1], out[:, :, 2] = y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)
