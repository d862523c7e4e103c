"""Small baseline JPEGs with EXIF, XMP and a thumbnail, written for the tests."""

import struct

import numpy as np

from aerialframe.functions.jpeg import _BASIS, EXIF_SIGNATURE, XMP_SIGNATURE, ZIGZAG


def _segment(marker, body):
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_grey(grey, step=4):
    """Grey pixels as a baseline JPEG; every Huffman code has eight bits."""
    h, w = grey.shape
    padded = np.pad(grey.astype(float) - 128, ((0, -h % 8), (0, -w % 8)), mode="edge")
    symbols = list(range(12)), [r << 4 | s for r in range(16) for s in range(11) if s or r in (0, 15)]
    table = lambda kind, values: bytes([kind]) + bytes([0] * 7 + [len(values)] + [0] * 8) + bytes(values)
    bits = []

    def number(v):
        n = abs(v).bit_length()
        return n, format(v if v >= 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    last = 0
    for y in range(0, padded.shape[0], 8):
        for x in range(0, padded.shape[1], 8):
            c = np.rint((_BASIS @ padded[y : y + 8, x : x + 8] @ _BASIS.T).ravel()[ZIGZAG] / step).astype(int).tolist()
            n, extra = number(c[0] - last)
            last = c[0]
            bits.append(format(symbols[0].index(n), "08b") + extra)
            run = 0
            for i, v in enumerate(c[1:], 1):
                if not any(c[i:]):
                    bits.append(format(symbols[1].index(0), "08b"))
                    break
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    bits.append(format(symbols[1].index(0xF0), "08b"))
                    run -= 16
                n, extra = number(v)
                bits.append(format(symbols[1].index(run << 4 | n), "08b") + extra)
                run = 0
    stream = "".join(bits)
    stream += "1" * (-len(stream) % 8)
    data = bytes(int(stream[i : i + 8], 2) for i in range(0, len(stream), 8)).replace(b"\xff", b"\xff\0")
    frame = struct.pack(">BHHBBBB", 8, h, w, 1, 1, 0x11, 0)
    return b"\xff\xd8" + _segment(0xDB, bytes([0] + [step] * 64)) + _segment(0xC0, frame) + _segment(0xC4, table(0, symbols[0])) + _segment(0xC4, table(0x10, symbols[1])) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data + b"\xff\xd9"


def encode_progressive(grey, step=4):
    """The same picture in five scans: DC, two bands with a bit less, then that bit for both. Runs of blocks without a band are counted."""
    h, w = grey.shape
    padded = np.pad(grey.astype(float) - 128, ((0, -h % 8), (0, -w % 8)), mode="edge")
    blocks = [np.rint((_BASIS @ padded[y : y + 8, x : x + 8] @ _BASIS.T).ravel()[ZIGZAG] / step).astype(int).tolist() for y in range(0, padded.shape[0], 8) for x in range(0, padded.shape[1], 8)]
    dc, ac = list(range(12)), [r << 4 | s for r in range(16) for s in range(12)]
    table = lambda kind, values: bytes([kind]) + bytes([0] * 7 + [len(values)] + [0] * 8) + bytes(values)
    code = lambda values, s: format(values.index(s), "08b")
    less = lambda v, k: (abs(v) >> k) * (1 if v > 0 else -1)

    def number(v):
        n = abs(v).bit_length()
        return n, format(v if v >= 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def pack(bits):
        stream = "".join(bits)
        stream += "1" * (-len(stream) % 8)
        return bytes(int(stream[i : i + 8], 2) for i in range(0, len(stream), 8)).replace(b"\xff", b"\xff\0")

    def ended(run, bits, waiting):
        if run:
            n = run.bit_length() - 1
            bits.append(code(ac, n << 4) + (format(run - (1 << n), f"0{n}b") if n else ""))
        bits += waiting

    def first(start, end, low):
        bits, run = [], 0
        for c in blocks:
            values, zeros = [less(v, low) for v in c[start : end + 1]], 0
            for i, v in enumerate(values):
                if not any(values[i:]):
                    run += 1
                    break
                if v == 0:
                    zeros += 1
                    continue
                ended(run, bits, [])
                run = 0
                while zeros > 15:
                    bits.append(code(ac, 0xF0))
                    zeros -= 16
                n, extra = number(v)
                bits.append(code(ac, zeros << 4 | n) + extra)
                zeros = 0
        ended(run, bits, [])
        return pack(bits)

    def refined(start, end):
        bits, run, waiting = [], 0, []
        for c in blocks:
            new = [i for i in range(start, end + 1) if abs(c[i]) == 1]
            zeros, mine = 0, []
            for i in range(start, end + 1):
                v = abs(c[i])
                if v == 0:
                    zeros += 1
                    continue
                while zeros > 15 and new and i <= new[-1]:
                    ended(run, bits, waiting)
                    run, waiting = 0, []
                    bits += [code(ac, 0xF0), *mine]
                    zeros, mine = zeros - 16, []
                if v > 1:
                    mine.append(str(v & 1))
                    continue
                ended(run, bits, waiting)
                run, waiting = 0, []
                bits += [code(ac, zeros << 4 | 1), "1" if c[i] > 0 else "0", *mine]
                zeros, mine = 0, []
            if zeros or mine:
                run, waiting = run + 1, waiting + mine
        ended(run, bits, waiting)
        return pack(bits)

    bits, last = [], 0
    for c in blocks:
        n, extra = number((c[0] >> 1) - last)
        last = c[0] >> 1
        bits.append(code(dc, n) + extra)
    scan = lambda start, end, approx, data: _segment(0xDA, bytes([1, 1, 0, start, end, approx])) + data
    frame = struct.pack(">BHHBBBB", 8, h, w, 1, 1, 0x11, 0)
    tables = _segment(0xDB, bytes([0] + [step] * 64)) + _segment(0xC2, frame) + _segment(0xC4, table(0, dc)) + _segment(0xC4, table(0x10, ac))
    scans = scan(0, 0, 0x01, pack(bits)) + scan(1, 5, 0x01, first(1, 5, 1)) + scan(6, 63, 0x01, first(6, 63, 1))
    scans += scan(1, 63, 0x10, refined(1, 63)) + scan(0, 0, 0x10, pack([str(c[0] & 1) for c in blocks]))
    return b"\xff\xd8" + tables + scans + b"\xff\xd9"


def _ifd(entries, at, nxt=0):
    """One directory at ``at``: (tag, kind, values)."""
    code, size = {2: "s", 3: "H", 4: "I", 5: "I"}, {2: 1, 3: 2, 4: 4, 5: 8}
    table, extra, free = b"", b"", at + 2 + 12 * len(entries) + 4
    for tag, kind, values in sorted(entries):
        data = values.encode() + b"\0" if kind == 2 else struct.pack(f"<{len(values)}{code[kind]}", *values)
        count = len(data) // size[kind]
        inline = len(data) <= 4
        table += struct.pack("<HHI", tag, kind, count) + (data.ljust(4, b"\0") if inline else struct.pack("<I", free + len(extra)))
        extra += b"" if inline else data + b"\0" * (len(data) % 2)
    return struct.pack("<H", len(entries)) + table + struct.pack("<I", nxt) + extra


def _dms(v):
    v = abs(v)
    d, m = int(v), int(v % 1 * 60)
    return (d, 1, m, 1, round((v - d - m / 60) * 3600 * 1000), 1000)


def photo(lat=10.0, lon=106.0, altitude=80.0, yaw=0.0, taken="2024:05:01 10:00:00", sharp=True, gps=True, size=(64, 48), extra_exif=(), model="FC6310", focal_35mm=24, encode=encode_grey, padding=0):
    grey = (np.indices((72, 96)).sum(0) // 4 % 2 * 255) if sharp else np.full((72, 96), 128)
    thumb = encode(grey)
    exif = [(0x920A, 5, (88, 10)), (0xA002, 4, (5472,)), (0xA003, 4, (3648,)), (0x9003, 2, taken), *extra_exif]
    if focal_35mm:
        exif.append((0xA405, 3, (focal_35mm,)))
    where = [(1, 2, "N" if lat >= 0 else "S"), (2, 5, _dms(lat)), (3, 2, "E" if lon >= 0 else "W"), (4, 5, _dms(lon))]
    main = lambda e, g: [(0x0110, 2, model), (0x8769, 4, (e,)), *([(0x8825, 4, (g,))] if gps else [])]
    at_exif = 8 + len(_ifd(main(0, 0), 8))
    at_gps = at_exif + len(_ifd(exif, at_exif))
    at_second = at_gps + (len(_ifd(where, at_gps)) if gps else 0)
    second = lambda n: [(0x0201, 4, (n,)), (0x0202, 4, (len(thumb),))]
    at_thumb = at_second + len(_ifd(second(0), at_second))
    tiff = struct.pack("<2sHI", b"II", 42, 8) + _ifd(main(at_exif, at_gps), 8, at_second) + _ifd(exif, at_exif) + (_ifd(where, at_gps) if gps else b"") + _ifd(second(at_thumb), at_second) + thumb
    xmp = f'<x drone-dji:RelativeAltitude="+{altitude:.2f}" drone-dji:GimbalYawDegree="{yaw:+.2f}"/>'.encode()
    body = encode_grey(np.indices((size[1], size[0])).sum(0) % 256)
    between = b"".join(_segment(0xE2, b"ICC" + bytes(60_000)) for _ in range(padding // 60_000))
    return b"\xff\xd8" + _segment(0xE1, EXIF_SIGNATURE + tiff) + between + _segment(0xE1, XMP_SIGNATURE + xmp) + body[2:]
