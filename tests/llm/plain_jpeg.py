"""A progressive JPEG reader bit by bit, after the text of the standard, to hold the array one against."""

import math
import struct


class Bits:
    def __init__(self, data):
        self.data, self.at = data.replace(b"\xff\x00", b"\xff"), 0

    def bit(self):
        byte = self.data[self.at >> 3]
        self.at += 1
        return byte >> (7 - (self.at - 1 & 7)) & 1

    def number(self, n):
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out

    def signed(self, n):
        x = self.number(n)
        return x if n == 0 or x >= 1 << (n - 1) else x - (1 << n) + 1

    def symbol(self, table):
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bit()
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")


def codes(counts, symbols):
    out, code, at = {}, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            out[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def refine(block, bits, table, ss, se, one, run_left):
    """One block of a scan that refines AC coefficients; the blocks that a run still covers."""
    k = ss
    if run_left == 0:
        while k <= se:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            new = 0
            if size:
                new = one if bits.bit() else -one
            elif zeros < 15:
                run_left = (1 << zeros) + bits.number(zeros)
                break
            while k <= se:
                if block[k]:
                    if bits.bit():
                        block[k] += one if block[k] > 0 else -one
                elif zeros == 0:
                    block[k] = new
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
    if run_left:
        for j in range(k, se + 1):
            if block[j] and bits.bit():
                block[j] += one if block[j] > 0 else -one
        run_left -= 1
    return run_left


def read(data):
    """(width, height, comment, [(h, v, rows of blocks of 64 coefficients in zigzag order, quantization)])."""
    at, tables, quant, comment = 2, {}, {}, b""
    while True:
        marker, = struct.unpack_from(">H", data, at)
        if marker == 0xFFD9:
            return width, height, comment, [(c["h"], c["v"], c["blocks"], quant[c["q"]]) for c in parts]
        size, = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFFFE:
            comment = body
        elif marker == 0xFFDB:
            quant[body[0] & 15] = struct.unpack(">64H", body[1:])
        elif marker == 0xFFC4:
            tables[body[0]] = codes(body[1:17], body[17:])
        elif marker == 0xFFC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(n)]
            hmax, vmax = max(c["h"] for c in parts), max(c["v"] for c in parts)
            across, down = math.ceil(width / 8 / hmax), math.ceil(height / 8 / vmax)
            for c in parts:
                c["blocks"] = [[[0] * 64 for _ in range(across * c["h"])] for _ in range(down * c["v"])]
                c["wide"], c["high"] = math.ceil(width * c["h"] / hmax / 8), math.ceil(height * c["v"] / vmax / 8)
        elif marker == 0xFFDA:
            chosen = [(next(c for c in parts if c["id"] == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            ss, se, approx = body[-3:]
            one, first = 1 << (approx & 15), approx >> 4 == 0
            end = at
            while not (data[end] == 0xFF and data[end + 1]):
                end += 1
            bits, at = Bits(data[at:end]), end
            if len(chosen) > 1:
                order = [(c, t, my * c["v"] + v, mx * c["h"] + h) for my in range(down) for mx in range(across) for c, t in chosen for v in range(c["v"]) for h in range(c["h"])]
            else:
                (c, t), = chosen
                order = [(c, t, y, x) for y in range(c["high"]) for x in range(c["wide"])]
            before, run_left = {}, 0
            for c, t, y, x in order:
                block = c["blocks"][y][x]
                if ss == 0 and first:
                    before[c["id"]] = before.get(c["id"], 0) + bits.signed(bits.symbol(tables[t >> 4]))
                    block[0] = before[c["id"]] * one
                elif ss == 0:
                    block[0] += one * bits.bit()
                elif not first:
                    run_left = refine(block, bits, tables[16 | t & 15], ss, se, one, run_left)
                elif run_left:
                    run_left -= 1
                else:
                    k = ss
                    while k <= se:
                        symbol = bits.symbol(tables[16 | t & 15])
                        zeros, size = symbol >> 4, symbol & 15
                        if size:
                            k += zeros
                            block[k] = bits.signed(size) * one
                        elif zeros < 15:
                            run_left = (1 << zeros) + bits.number(zeros) - 1
                            break
                        else:
                            k += 15
                        k += 1
        else:
            raise ValueError(hex(marker))


def zigzag():
    y = x = 0
    for _ in range(64):
        yield y, x
        if (y + x) % 2 == 0:
            y, x = (y, x + 1) if y == 0 and x < 7 else (y + 1, x) if x == 7 else (y - 1, x + 1)
        else:
            y, x = (y + 1, x) if x == 0 and y < 7 else (y, x + 1) if y == 7 else (y + 1, x - 1)


def plane(blocks, quant):
    """Rows of samples 0..255."""
    wave = [[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)]
    out = [[0] * (8 * len(blocks[0])) for _ in range(8 * len(blocks))]
    for by, row in enumerate(blocks):
        for bx, block in enumerate(row):
            f = {at: c * q for at, c, q in zip(zigzag(), block, quant)}
            half = [[sum(f[v, u] * wave[u][x] for u in range(8)) for x in range(8)] for v in range(8)]
            for y in range(8):
                for x in range(8):
                    s = sum(half[v][x] * wave[v][y] for v in range(8)) + 128
                    out[8 * by + y][8 * bx + x] = min(255, max(0, round(s)))
    return out


def pixels(width, height, parts):
    """Rows of (r, g, b)."""
    hmax, vmax = max(p[0] for p in parts), max(p[1] for p in parts)
    planes = [(vmax // v, hmax // h, plane(blocks, quant)) for h, v, blocks, quant in parts]
    fit = lambda x: min(255, max(0, round(x)))
    out = []
    for j in range(height):
        row = []
        for i in range(width):
            y, cb, cr = (p[j // dv][i // dh] for dv, dh, p in planes)
            row.append((fit(y + 1.402 * (cr - 128)), fit(y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128)), fit(y + 1.772 * (cb - 128))))
        out.append(row)
    return out
