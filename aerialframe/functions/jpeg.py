"""What a photo's header holds: EXIF tags, the XMP packet, sizes, and the grey values of the embedded thumbnail."""

from __future__ import annotations

import struct
from typing import Any

import numpy as np

#: Bytes of a file that are searched for metadata.
HEADER_BYTES = 4 << 20
XMP_SIGNATURE, EXIF_SIGNATURE = b"http://ns.adobe.com/xap/1.0/\0", b"Exif\0\0"
# Tag numbers by directory.
EXIF_POINTER, GPS_POINTER = 0x8769, 0x8825
TAGS = {
    "model": ("main", 0x0110, "ascii"), "focal_mm": ("exif", 0x920A, "rational"), "focal_35mm": ("exif", 0xA405, "uint"),
    "pixel_x": ("exif", 0xA002, "uint"), "pixel_y": ("exif", 0xA003, "uint"), "x_res": ("exif", 0xA20E, "rational"), "y_res": ("exif", 0xA20F, "rational"),
    "res_unit": ("exif", 0xA210, "uint"), "taken": ("exif", 0x9003, "ascii"), "subsec": ("exif", 0x9291, "ascii"),
    "lat_ref": ("gps", 0x0001, "ascii"), "lat_parts": ("gps", 0x0002, "rationals"), "lon_ref": ("gps", 0x0003, "ascii"), "lon_parts": ("gps", 0x0004, "rationals"),
}
THUMB_OFFSET, THUMB_LENGTH = 0x0201, 0x0202
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def segments(data: bytes):
    """(marker, payload) up to the picture's own data."""
    at, limit = 2, min(len(data), HEADER_BYTES)
    if data[:2] != b"\xff\xd8":
        return
    while at + 4 <= limit and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0xD9, 0xDA):
            return
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def wanted(data: bytes) -> int:
    """How many bytes of a file's front are needed to pass its header, as far as ``data``, what is read so far, tells; HEADER_BYTES at most."""
    at = 2
    if data[:2] != b"\xff\xd8":
        return min(2, HEADER_BYTES)
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker in (0xD9, 0xDA):
            return at
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
        else:
            at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    return min(HEADER_BYTES, at + 4 if at + 4 > len(data) else at)


def _directory(tiff: bytes, end: str, at: int) -> tuple[dict[int, tuple[int, int, int]], int]:
    """Entries of one directory as tag: (type, count, place of the value), and the place of the next directory."""
    if at <= 0 or at + 2 > len(tiff):
        return {}, 0
    n = struct.unpack_from(end + "H", tiff, at)[0]
    out = {}
    for i in range(n):
        p = at + 2 + 12 * i
        if p + 12 > len(tiff):
            return out, 0
        tag, kind, count = struct.unpack_from(end + "HHI", tiff, p)
        where = p + 8 if SIZES.get(kind, 0) * count <= 4 else struct.unpack_from(end + "I", tiff, p + 8)[0]
        if kind in SIZES and where + SIZES[kind] * count <= len(tiff):
            out.setdefault(tag, (kind, count, where))
    p = at + 2 + 12 * n
    return out, struct.unpack_from(end + "I", tiff, p)[0] if p + 4 <= len(tiff) else 0


def _value(tiff: bytes, end: str, entry: tuple[int, int, int] | None, want: str) -> Any:
    if not entry or not entry[1]:
        return None
    kind, count, at = entry
    if want in ("rational", "rationals") and kind in (5, 10):
        nums = struct.unpack_from(end + ("II" if kind == 5 else "ii") * count, tiff, at)
        got = [a / b if b else (float("nan") if not a else float("inf") if a > 0 else float("-inf")) for a, b in zip(nums[::2], nums[1::2], strict=True)]
        return got if want == "rationals" else got[0]
    if want == "uint" and kind in (3, 4):
        return struct.unpack_from(end + ("H" if kind == 3 else "I"), tiff, at)[0]
    if want == "ascii" and kind == 2:
        return tiff[at : at + count].split(b"\0")[0].decode("latin-1").strip() or None
    return None


def read_header(data: bytes) -> dict[str, Any]:
    """Every tag of TAGS (null if missing), has_exif, thumbnail, xmp, and the width and height of the picture's frame."""
    out: dict[str, Any] = dict.fromkeys([*TAGS, "thumbnail", "xmp", "frame_w", "frame_h"]) | {"has_exif": False}
    packet = False  # the first one counts, even if it can't be read
    for marker, body in segments(data):
        if marker == 0xE1 and body.startswith(EXIF_SIGNATURE) and not out["has_exif"]:
            tiff = body[len(EXIF_SIGNATURE) :]
            if tiff[:4] not in (b"II*\0", b"MM\0*") or len(tiff) < 8:
                continue
            end = "<" if tiff[:2] == b"II" else ">"
            main, nxt = _directory(tiff, end, struct.unpack_from(end + "I", tiff, 4)[0])
            dirs = {"main": main}
            for name, tag in (("exif", EXIF_POINTER), ("gps", GPS_POINTER)):
                dirs[name] = _directory(tiff, end, _value(tiff, end, main.get(tag), "uint") or 0)[0]
            out["has_exif"] = True
            out |= {k: _value(tiff, end, dirs[d].get(tag), want) for k, (d, tag, want) in TAGS.items()}
            second = _directory(tiff, end, nxt)[0]
            spans = [second.get(t) for t in (THUMB_OFFSET, THUMB_LENGTH)]
            if all(s and s[0] == 4 for s in spans):
                a, n = (_value(tiff, end, s, "uint") for s in spans)
                out["thumbnail"] = tiff[a : a + n] if n and a + n <= len(tiff) else None
        elif marker == 0xE1 and body.startswith(XMP_SIGNATURE) and not packet:
            packet = True
            try:
                out["xmp"] = body[len(XMP_SIGNATURE) :].decode()
            except UnicodeDecodeError:
                out["xmp"] = None
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            out["frame_h"], out["frame_w"] = struct.unpack_from(">HH", body, 1)
    return out


# Fixed value: the order in which a block's 64 coefficients are stored, diagonal by diagonal.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_BASIS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def decode_grey(data: bytes) -> np.ndarray | None:
    """The first component (grey values) of a small JPEG, baseline or progressive; None for anything else or if it is broken."""
    try:
        return _Picture(data).grey()
    except (IndexError, KeyError, struct.error, ValueError):
        return None


class _Bits:
    """The bits of a scan; after its end come zeros."""

    def __init__(self, stream: bytes):
        self.stream, self.pos, self.held, self.n = stream, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            b = self.stream[self.pos] if self.pos < len(self.stream) else 0
            self.pos += 1
            if b == 0xFF:
                if self.pos < len(self.stream) and self.stream[self.pos] != 0:
                    self.pos, b = self.pos - 1, 0  # a marker
                else:
                    self.pos += 1
            self.held, self.n = (self.held << 8 | b) & 0xFFFFFFFFFF, self.n + 8
        self.n -= n
        return self.held >> self.n & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def number(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def restart(self) -> None:
        """Go behind the next restart marker."""
        while not (self.stream[self.pos] == 0xFF and 0xD0 <= self.stream[self.pos + 1] <= 0xD7):
            self.pos += 1
        self.pos, self.held, self.n = self.pos + 2, 0, 0


class _Picture:
    """Coefficients of all components, filled scan by scan. A baseline picture is one with a single pass over all of them."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[int, dict[tuple[int, int], int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.width = self.height = self.every = 0
        self.progressive = False
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            marker = data[at + 1]
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self.tables(body)
            elif marker == 0xC4:
                self.huffman(body)
            elif marker in (0xC0, 0xC1, 0xC2):
                self.frame(body, marker == 0xC2)
            elif marker == 0xDD:
                self.every = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                end = at
                while end + 1 < len(data) and not (data[end] == 0xFF and data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7):
                    end += 1
                self.scan(body, _Bits(data[at:end] if end + 1 < len(data) else data[at:]))
                if not self.progressive:
                    break
                at = end
            elif 0xC3 <= marker <= 0xCF:
                raise ValueError("Coded in another way.")

    def tables(self, body: bytes) -> None:
        while body:
            n = 128 if body[0] >> 4 else 64
            self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(float)
            body = body[1 + n :]

    def huffman(self, body: bytes) -> None:
        while body:
            table, code, p = {}, 0, 17
            for length in range(1, 17):
                for _ in range(body[length]):
                    table[length, code] = body[p]
                    code, p = code + 1, p + 1
                code <<= 1
            self.codes[body[0]] = table
            body = body[p:]

    def frame(self, body: bytes, progressive: bool) -> None:
        self.progressive = progressive
        self.height, self.width, n = struct.unpack_from(">HHB", body, 1)
        if not n or not self.width or not self.height:
            raise ValueError("No picture.")
        self.parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
        if n == 1:
            self.parts = {k: (1, 1, q) for k, (_, _, q) in self.parts.items()}
        self.first = next(iter(self.parts))
        self.h, self.v = max(p[0] for p in self.parts.values()), max(p[1] for p in self.parts.values())
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        self.blocks = {k: np.zeros((self.down * v, self.across * h, 64), np.int64) for k, (h, v, _) in self.parts.items()}

    def scan(self, body: bytes, bits: _Bits) -> None:
        chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
        start, end, approx = body[1 + 2 * body[0] : 4 + 2 * body[0]]
        high, low = approx >> 4, approx & 15
        if len(chosen) > 1:
            units = [[(k, t, row * v + j, col * h + i) for k, t in chosen for h, v, _ in [self.parts[k]] for j in range(v) for i in range(h)] for row in range(self.down) for col in range(self.across)]
        else:  # only the blocks that the picture needs
            k, t = chosen[0]
            h, v, _ = self.parts[k]
            wide, tall = -(-self.width * h // (8 * self.h)), -(-self.height * v // (8 * self.v))
            units = [[(k, t, row, col)] for row in range(tall) for col in range(wide)]
        last, self.run = dict.fromkeys(self.parts, 0), 0
        for n, unit in enumerate(units):
            if self.every and n and n % self.every == 0:
                bits.restart()
                last, self.run = dict.fromkeys(self.parts, 0), 0
            for k, t, row, col in unit:
                block = self.blocks[k][row, col]
                if not self.progressive:
                    last[k] += bits.number(bits.symbol(self.codes[t >> 4]))
                    block[0] = last[k]
                    self.ac(block, bits, self.codes[0x10 | t & 15], 1, 63, 0)
                elif start == 0 and high == 0:
                    last[k] += bits.number(bits.symbol(self.codes[t >> 4]))
                    block[0] = last[k] << low
                elif start == 0:
                    block[0] |= bits.take(1) << low
                elif high == 0:
                    self.ac(block, bits, self.codes[0x10 | t & 15], start, end, low)
                else:
                    self.refine(block, bits, self.codes[0x10 | t & 15], start, end, 1 << low)

    def ac(self, block: np.ndarray, bits: _Bits, table: dict[tuple[int, int], int], start: int, end: int, low: int) -> None:
        """Coefficients of a band for the first time; a run of blocks may have none."""
        if self.run:
            self.run -= 1
            return
        i = start
        while i <= end:
            s = bits.symbol(table)
            zeros, size = s >> 4, s & 15
            if not size and zeros < 15:
                if zeros and not self.progressive:
                    raise ValueError("no such code")
                self.run = (1 << zeros) + (bits.take(zeros) if zeros else 0) - 1
                return
            i += zeros
            if size:
                block[i] = bits.number(size) * (1 << low)
            i += 1

    def refine(self, block: np.ndarray, bits: _Bits, table: dict[tuple[int, int], int], start: int, end: int, one: int) -> None:
        """One more bit of a band: coefficients that have a value take a bit each as they are passed, zeros are counted."""

        def pass_by(i: int) -> None:
            if bits.take(1) and not abs(int(block[i])) & one:
                block[i] += one if block[i] > 0 else -one

        i = start
        while i <= end and not self.run:
            s = bits.symbol(table)
            zeros, size, value = s >> 4, s & 15, 0
            if size:
                value = one if bits.take(1) else -one
            elif zeros < 15:
                self.run = (1 << zeros) + (bits.take(zeros) if zeros else 0)
                break
            while i <= end:
                if block[i]:
                    pass_by(i)
                elif zeros == 0:
                    block[i] = value
                    i += 1
                    break
                else:
                    zeros -= 1
                i += 1
        if self.run:
            for j in range(i, end + 1):
                if block[j]:
                    pass_by(j)
            self.run -= 1

    def grey(self) -> np.ndarray:
        if not self.parts:
            raise ValueError("No picture.")
        h, v, q = self.parts[self.first]
        blocks = self.blocks[self.first]
        full = np.zeros(blocks.shape)
        full[..., ZIGZAG] = blocks * self.quant[q]
        pixels = _BASIS.T @ full.reshape(*blocks.shape[:2], 8, 8) @ _BASIS
        out = pixels.transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, blocks.shape[1] * 8)
        rows, cols = -(-self.height * v // self.v), -(-self.width * h // self.h)
        return np.clip(np.rint(out[:rows, :cols] + 128), 0, 255).astype(np.uint8)
