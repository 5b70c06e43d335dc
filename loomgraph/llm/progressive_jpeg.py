"""Progressive JPEG in numpy: coefficient arrays to scans and back.

``encode`` writes DC and AC first scans and refinements (spectral selection and
successive approximation) with fixed-length Huffman tables. ``decode`` reads any
progressive Huffman file of 8-bit samples without restart intervals: it
accumulates all scans into coefficient arrays; ``to_rgb`` dequantizes, applies the
inverse transform, repeats subsampled components to full resolution and converts
YCbCr. Scans whose coefficients all have one length are read as a whole array.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: The zigzag order of an 8 x 8 block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


def _basis() -> np.ndarray:
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    both = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return both[ZIGZAG].astype(np.float32)


BASIS = _basis()


@dataclass
class Component:
    """coefs: rows of blocks x blocks x 64 in zigzag order; h, v: sampling factors."""

    coefs: np.ndarray
    h: int = 1
    v: int = 1
    quant: np.ndarray = field(default_factory=lambda: np.ones(64, np.int32))


@dataclass
class Image:
    width: int
    height: int
    parts: list[Component]
    comment: bytes = b""

    def __post_init__(self):
        self.hmax, self.vmax = max(p.h for p in self.parts), max(p.v for p in self.parts)


# --- bits -------------------------------------------------------------------


def _pack(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Concatenated bit strings, filled with ones, 0xFF stuffed."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    bits = np.ones(-(-total // 8) * 8, np.uint8)
    starts = ends - lengths
    for j in range(int(lengths.max()) if len(lengths) else 0):
        some = lengths > j
        bits[starts[some] + j] = (values[some] >> (lengths[some] - 1 - j)) & 1
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _fixed(rows: np.ndarray, total: int) -> bytes:
    bits = np.ones(-(-total // 8) * 8, np.uint8)
    bits[:total] = rows.reshape(-1)
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _bits_of(values: np.ndarray, width: int) -> np.ndarray:
    """values x width matrix of bits, high bit first."""
    if width == 8:
        return np.unpackbits(values.astype(np.uint8)[..., None], axis=-1)
    return ((values[..., None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8)


def _category(v: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def _extra(v, size):
    """Magnitude bits: negative values are one below their complement."""
    return np.where(v >= 0, v, v + (1 << size) - 1)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(1024)
def _table(kind: int, slot: int, symbols: tuple[int, ...]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A table segment in which all codes have one length, and symbol -> (code, length)."""
    length = max(1, len(symbols).bit_length())  # leaves the code of ones unused
    counts = [0] * 16
    counts[length - 1] = len(symbols)
    return _segment(0xC4, bytes([kind << 4 | slot, *counts, *symbols])), {s: (i, length) for i, s in enumerate(symbols)}


# --- encoder ----------------------------------------------------------------


def _scan_head(parts: list[int], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(parts), *[x for p in parts for x in (p + 1, 0)], ss, se, ah << 4 | al]))


def _mcu_order(image: Image) -> list[tuple[int, np.ndarray]]:
    """(component, its block coefficients in the order of an interleaved scan), one array per slot."""
    mx, my = -(-image.width // (8 * image.hmax)), -(-image.height // (8 * image.vmax))
    out = []
    for i, p in enumerate(image.parts):
        for y in range(p.v):
            for x in range(p.h):
                out.append((i, (y, x, my, mx)))
    return out


def _blocks(p: Component, slot) -> np.ndarray:
    y, x, my, mx = slot
    return p.coefs[y : my * p.v : p.v, x : mx * p.h : p.h]


def encode(image: Image, bands=((1, 5), (6, 63)), low: int = 1, chroma=None) -> bytes:
    """The file: DC, then each band, first without its ``low`` lowest bits, then bit by bit.

    ``chroma``: bands of the components after the first, where they are others.
    """
    out = [b"\xff\xd8"]
    if image.comment:
        out.append(_segment(0xFE, image.comment))
    for i, p in enumerate(image.parts):
        out.append(_segment(0xDB, bytes([0x10 | i]) + p.quant.astype(">u2").tobytes()))
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, image.height, image.width, len(image.parts)) + b"".join(bytes([i + 1, p.h << 4 | p.v, i]) for i, p in enumerate(image.parts))))
    every = list(range(len(image.parts)))
    scans = [(i, _own_blocks(image, i), ss, se) for i in every for ss, se in (bands if not i or chroma is None else chroma)]
    out.append(_dc_first(image, every, low))
    out += [_ac_first(blocks, i, ss, se, low) for i, blocks, ss, se in scans]
    for bit in range(low - 1, -1, -1):
        out.append(_dc_refine(image, every, bit))
        out += [_ac_refine(blocks, i, ss, se, bit) for i, blocks, ss, se in scans]
    return b"".join([*out, b"\xff\xd9"])


def _own_blocks(image: Image, i: int) -> np.ndarray:
    """The component's blocks in a scan of its own: only those that the picture needs."""
    p = image.parts[i]
    bw, bh = -(-(-(-image.width * p.h // image.hmax)) // 8), -(-(-(-image.height * p.v // image.vmax)) // 8)
    return p.coefs[:bh, :bw]


def _interleaved(image: Image, every: list[int]):
    """Coefficients 0 in MCU order and the component of each."""
    if len(every) == 1:
        dc = _own_blocks(image, every[0])[..., 0].reshape(-1, 1)
        return dc, np.zeros(1, int)
    slots = _mcu_order(image)
    return np.stack([_blocks(image.parts[i], s)[..., 0].reshape(-1) for i, s in slots], 1), np.array([i for i, _ in slots])


def _dc_first(image: Image, every: list[int], al: int) -> bytes:
    dc, owner = _interleaved(image, every)
    dc = (dc >> al).astype(np.int64)
    diff = np.empty_like(dc)
    for i in set(owner.tolist()):
        own = dc[:, owner == i].reshape(-1)
        diff[:, owner == i] = np.diff(own, prepend=0).reshape(-1, int((owner == i).sum()))
    diff = diff.reshape(-1)
    size = _category(diff)
    table, codes = _table(0, 0, tuple(range(12)))
    length = codes[0][1]
    return table + _scan_head(every, 0, 0, 0, al) + _pack(size << size | _extra(diff, size), length + size)


def _dc_refine(image: Image, every: list[int], al: int) -> bytes:
    dc, _ = _interleaved(image, every)
    return _scan_head(every, 0, 0, al + 1, al) + _fixed(((dc >> al) & 1).astype(np.uint8), dc.size)


def _down(v: np.ndarray, al: int) -> np.ndarray:
    """Magnitude without its al lowest bits, sign kept."""
    return np.sign(v) * (np.abs(v) >> al)


def _ac_first(blocks: np.ndarray, part: int, ss: int, se: int, al: int) -> bytes:
    v = _down(blocks.reshape(-1, 64)[:, ss : se + 1].astype(np.int64), al)
    size = _category(v)
    head = _scan_head([part], ss, se, 0, al)
    if v.size and (v > 0).all() and (size == size.flat[0]).all():
        s = int(size.flat[0])
        table, _ = _table(1, 0, (s,))
        rows = np.zeros((v.size, s + 1), np.uint8)
        rows[:, 1:] = _bits_of(v.reshape(-1), s)
        return table + head + _fixed(rows, rows.size)
    tokens: list[tuple[int, int, int]] = []  # symbol, extra bits, their number
    for row, sizes in zip(v.tolist(), size.tolist()):
        run = 0
        for x, s in zip(row, sizes):
            if not x:
                run += 1
                continue
            while run > 15:
                tokens.append((0xF0, 0, 0))
                run -= 16
            tokens.append((run << 4 | s, x if x > 0 else x + (1 << s) - 1, s))
            run = 0
        if run:
            tokens.append((0, 0, 0))
    return _coded(tokens, head)


def _coded(tokens, head: bytes) -> bytes:
    table, codes = _table(1, 0, tuple(sorted({t[0] for t in tokens}) or (0,)))
    if not tokens:
        return table + head
    value = np.array([codes[s][0] << n | e for s, e, n in tokens], np.int64)
    return table + head + _pack(value, np.array([codes[s][1] + n for s, _, n in tokens], np.int64))


def _ac_refine(blocks: np.ndarray, part: int, ss: int, se: int, al: int) -> bytes:
    v = blocks.reshape(-1, 64)[:, ss : se + 1].astype(np.int64)
    magnitude = np.abs(v)
    head = _scan_head([part], ss, se, al + 1, al)
    if v.size and (magnitude >> (al + 1)).all():
        # nothing can become nonzero: runs of finished blocks, a correction bit each
        table, codes = _table(1, 0, tuple(n << 4 for n in range(15)))
        rows, parts, at = ((magnitude >> al) & 1).astype(np.uint8), [], 0
        while at < len(rows):
            n = min(len(rows) - at, 32767)
            high = n.bit_length() - 1
            code, length = codes[high << 4]
            lead = np.array([code << high | (n - (1 << high))])
            parts += [_bits_of(lead, length + high).reshape(-1), rows[at : at + n].reshape(-1)]
            at += n
        bits = np.concatenate(parts)
        return table + head + _fixed(bits, bits.size)
    tokens: list[tuple[int, int, int]] = []
    for row, mags in zip(v.tolist(), magnitude.tolist()):
        new = [i for i, m in enumerate(mags) if m >> al == 1]
        last = new[-1] if new else -1
        run, held = 0, []
        for i, m in enumerate(mags):
            if m >> al == 0:
                run += 1
                continue
            while run > 15 and i <= last:
                tokens += [(0xF0, 0, 0), *[(-1, b, 1) for b in held]]
                run, held = run - 16, []
            if m >> al > 1:
                held.append(m >> al & 1)
                continue
            tokens += [(run << 4 | 1, int(row[i] > 0), 1), *[(-1, b, 1) for b in held]]
            run, held = 0, []
        if run or held:
            tokens += [(0, 0, 0), *[(-1, b, 1) for b in held]]
    table, codes = _table(1, 0, tuple(sorted({t[0] for t in tokens} - {-1}) or (0,)))
    if not tokens:
        return table + head
    codes = codes | {-1: (0, 0)}
    value = np.array([codes[s][0] << n | e for s, e, n in tokens], np.int64)
    return table + head + _pack(value, np.array([codes[s][1] + n for s, _, n in tokens], np.int64))


# --- decoder ----------------------------------------------------------------


@lru_cache(1024)
class _Huffman:
    """Codes of a table segment's counts and symbols; never changed, so kept by them."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[tuple[int, int], int] = {}
        code = at = 0
        for length, n in enumerate(counts, 1):
            for s in symbols[at : at + n]:
                self.codes[length, code] = s
                code += 1
            at += n
            code <<= 1
        lengths = {k[0] for k in self.codes}
        self.length = lengths.pop() if len(lengths) == 1 else 0
        self.first = min(self.codes) if self.codes else None
        self.flat = {format(c, f"0{n}b"): s for (n, c), s in self.codes.items()}


class _Bits:
    def __init__(self, data: bytes):
        self.array = np.unpackbits(np.frombuffer(data, np.uint8))
        self._text: str | None = None
        self.at = 0

    @property
    def text(self) -> str:
        if self._text is None:
            self._text = (self.array + 48).tobytes().decode("ascii")
        return self._text

    def symbol(self, table: _Huffman) -> int:
        text, at, flat = self.text, self.at, table.flat
        if table.length:
            self.at += table.length
            return flat[text[at : self.at]]
        for n in range(1, 17):
            if (s := flat.get(text[at : at + n])) is not None:
                self.at += n
                return s
        raise ValueError("no such code")

    def take(self, n: int) -> int:
        self.at += n
        return int(self.text[self.at - n : self.at], 2) if n else 0

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x if not n or x >> (n - 1) else x - (1 << n) + 1


def decode(data: bytes) -> Image:
    """All scans accumulated into the components' coefficients."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, image, comment = 2, None, b""
    quant: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], _Huffman] = {}
    slots: list[int] = []
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            specs = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
            hmax, vmax = max(s[1] >> 4 for s in specs), max(s[1] & 15 for s in specs)
            mx, my = -(-width // (8 * hmax)), -(-height // (8 * vmax))
            parts = [Component(np.zeros((my * (s[1] & 15), mx * (s[1] >> 4), 64), np.int32), s[1] >> 4, s[1] & 15) for s in specs]
            image, slots, ids = Image(width, height, parts, comment), [s[2] for s in specs], [s[0] for s in specs]
        elif marker == 0xDA:
            n = body[0]
            chosen = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            ss, se, approx = body[1 + 2 * n : 4 + 2 * n]
            end = at
            while True:
                end = data.index(b"\xff", end)
                if data[end + 1] != 0:
                    break
                end += 2
            bits = _Bits(data[at:end].replace(b"\xff\x00", b"\xff"))
            at = end
            _scan(image, chosen, tables, ss, se, approx >> 4, approx & 15, bits)
        elif marker == 0xDD and body != b"\x00\x00":
            raise ValueError("restart intervals are not read")
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a progressive Huffman file")
    if image is None:
        raise ValueError("no frame")
    for p, s in zip(image.parts, slots):
        p.quant = quant[s]
    return image


def _scan(image: Image, chosen, tables, ss, se, ah, al, bits: _Bits) -> None:
    if ss:
        (i, slot), = chosen
        view = _own_blocks(image, i)
        flat = view.reshape(-1, 64)
        if not np.shares_memory(flat, view):
            flat = flat.copy()
        table = tables[1, slot & 15]
        (_ac_refine_in if ah else _ac_first_in)(flat, table, ss, se, al, bits)
        view[...] = flat.reshape(view.shape)
        return
    if len(chosen) == 1:
        i = chosen[0][0]
        views, owner, slots = [_own_blocks(image, i)], [0], [chosen[0][1]]
    else:
        order = _mcu_order(image)
        views, owner = [_blocks(image.parts[i], s) for i, s in order], [i for i, _ in order]
        slots = [dict(chosen)[i] for i in owner]
    n = views[0].shape[0] * views[0].shape[1]
    if ah:
        got = bits.array[: n * len(views)].reshape(n, -1).astype(np.int32) << al
        for k, view in enumerate(views):
            view[..., 0] |= got[:, k].reshape(view.shape[:2])
        return
    use = [tables[0, s >> 4] for s in slots]
    diff = np.empty((n, len(views)), np.int64)
    if use[0].length and all(t is use[0] for t in use):
        # one table with codes of one length, read along the bit string
        text, at, flat, length = bits.text, 0, use[0].flat, use[0].length
        out = []
        for _ in range(n * len(views)):
            to = at + length
            size = flat[text[at:to]]
            at = to + size
            if size:
                x = int(text[to:at], 2)
                out.append(x if text[to] == "1" else x - (1 << size) + 1)
            else:
                out.append(0)
        diff[...] = np.array(out, np.int64).reshape(n, -1)
    else:
        for row in range(n):
            for k, table in enumerate(use):
                diff[row, k] = bits.signed(bits.symbol(table))
    owner = np.array(owner)
    for i in set(owner.tolist()):
        own = owner == i
        value = np.cumsum(diff[:, own].reshape(-1)).reshape(n, -1) << al
        for k, col in zip(np.flatnonzero(own), value.T):
            views[k][..., 0] = col.reshape(views[k].shape[:2])


def _ac_first_in(flat, table: _Huffman, ss, se, al, bits: _Bits) -> None:
    n, k = len(flat), se - ss + 1
    if len(table.codes) == 1:
        (length, code), symbol = next(iter(table.codes.items()))
        size = symbol & 15
        if symbol < 16 and 0 < size and length + size <= 16 and len(bits.array) >= n * k * (length + size):
            rows = bits.array[: n * k * (length + size)].reshape(-1, length + size)[:, length:]
            if size <= 8:
                value = (np.packbits(rows, axis=1)[:, 0] >> (8 - size)).astype(np.int32)
            else:
                value = rows.astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
            value = np.where(rows[:, 0] == 1, value, value - (1 << size) + 1)
            flat[:, ss : se + 1] = value.reshape(n, k) << al
            return
    row = 0
    while row < n:
        i = ss
        while i <= se:
            symbol = bits.symbol(table)
            run, size = symbol >> 4, symbol & 15
            if size:
                i += run
                flat[row, i] = bits.signed(size) * (1 << al)
                i += 1
            elif run == 15:
                i += 16
            else:
                row += (1 << run) + bits.take(run) - 1
                break
        row += 1


def _ac_refine_in(flat, table: _Huffman, ss, se, al, bits: _Bits) -> None:
    n, k, bit = len(flat), se - ss + 1, 1 << al
    band = flat[:, ss : se + 1]
    if (band != 0).all():
        row = 0
        while row < n:
            run = bits.symbol(table) >> 4
            count = (1 << run) + bits.take(run)
            got = bits.array[bits.at : bits.at + count * k].reshape(count, k)
            part = band[row : row + count]
            part += np.where(part > 0, bit, -bit).astype(np.int32) * got
            bits.at += count * k
            row += count
        return
    finished = 0
    for row in range(n):
        cells, i = flat[row], ss

        def correct(j):
            if bits.take(1):
                cells[j] += bit if cells[j] > 0 else -bit

        if not finished:
            while i <= se:
                symbol = bits.symbol(table)
                run, size = symbol >> 4, symbol & 15
                value = 0
                if size:
                    value = bit if bits.take(1) else -bit
                elif run < 15:
                    finished = (1 << run) + bits.take(run)
                    break
                while i <= se:
                    if cells[i]:
                        correct(i)
                    elif run == 0:
                        if value:
                            cells[i] = value
                        i += 1
                        break
                    else:
                        run -= 1
                    i += 1
        if finished:
            for j in range(i, se + 1):
                if cells[j]:
                    correct(j)
            finished -= 1


# --- samples ----------------------------------------------------------------


def samples(p: Component) -> np.ndarray:
    """Samples 0..255 of a component, in whole blocks."""
    by, bx, _ = p.coefs.shape
    out = (p.coefs.reshape(-1, 64) * p.quant).astype(np.float32) @ BASIS
    out = np.clip(np.rint(out + 128), 0, 255).astype(np.uint8)
    return out.reshape(by, bx, 8, 8).transpose(0, 2, 1, 3).reshape(by * 8, bx * 8)


def to_rgb(image: Image) -> np.ndarray:
    """height x width x 3 samples; subsampled components repeat."""
    planes = [np.repeat(np.repeat(samples(p), image.vmax // p.v, 0), image.hmax // p.h, 1)[: image.height, : image.width] for p in image.parts]
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, 2)
    y, cb, cr = (x.astype(np.float32) for x in planes)
    rgb = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], 2)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def from_rgb(rgb: np.ndarray, quant: np.ndarray | None = None, subsample: bool = True) -> Image:
    """YCbCr coefficients of an RGB tensor, chroma averaged over 2 x 2 when subsampled."""
    height, width = rgb.shape[:2]
    r, g, b = (rgb[..., i].astype(np.float32) for i in range(3))
    planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    quant = np.ones(64, np.int32) if quant is None else quant
    step = 16 if subsample else 8
    fill = ((0, -height % step), (0, -width % step))
    parts = []
    for i, x in enumerate(planes):
        x = np.pad(x, fill, mode="edge")
        if subsample and i:
            x = x.reshape(x.shape[0] // 2, 2, x.shape[1] // 2, 2).mean((1, 3))
        by, bx = x.shape[0] // 8, x.shape[1] // 8
        blocks = x.reshape(by, 8, bx, 8).transpose(0, 2, 1, 3).reshape(-1, 64) - 128
        coefs = np.rint(blocks.astype(np.float32) @ BASIS.T / quant).astype(np.int32).reshape(by, bx, 64)
        f = 2 if subsample and not i else 1
        parts.append(Component(coefs, f, f, quant))
    return Image(width, height, parts)
