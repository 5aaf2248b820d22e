"""Codecs and reversible filters over the bytes of one unit, and their race.

A filter that can't do its work refuses by returning None; the unit then keeps its
plain bytes.  Whatever a filter made is kept only if it gives the unit back.
"""

from __future__ import annotations

import bz2
import lzma
import re
import struct
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model as M

# --- codecs


def _lzma_chain(length: int, preset: int) -> list[dict]:
    return [{"id": lzma.FILTER_LZMA2, "preset": preset, "dict_size": min(max(length, 4096), M.STORED_MAX), "nice_len": 273}]


def compress(codec: int, param: int, data: bytes) -> bytes:
    if codec == M.STORE:
        return data
    if codec == M.ZSTD:
        return zstandard.ZstdCompressor(level=param, write_content_size=True).compress(data)
    if codec == M.LZMA2:
        return lzma.compress(data, lzma.FORMAT_RAW, filters=_lzma_chain(len(data), param))
    if codec == M.BZ2:
        return bz2.compress(data, 9)
    raise ValueError(f"no such codec: {codec}")


def decompress(codec: int, param: int, data: bytes, length: int) -> bytes:
    """Exactly `length` bytes, or ValueError."""
    if not 0 <= length <= M.CODED_MAX:
        raise ValueError("a declared length is out of bounds")
    try:
        if codec == M.STORE:
            out = bytes(data)
        elif codec == M.ZSTD:
            out = zstandard.ZstdDecompressor().decompress(data, max_output_size=length)
        elif codec == M.LZMA2:
            out = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=_lzma_chain(length, param)).decompress(data, length + 1)
        elif codec == M.BZ2:
            out = bz2.BZ2Decompressor().decompress(data, length + 1)
        else:
            raise ValueError(f"no such codec: {codec}")
    except (lzma.LZMAError, zstandard.ZstdError, OSError, EOFError) as error:
        raise ValueError(f"damaged data: {error}") from error
    if len(out) != length:
        raise ValueError("data ends at another length than declared")
    return out


# --- filters


def delta(data: bytes, distance: int) -> bytes:
    x = np.frombuffer(data, np.uint8)
    out = x.copy()
    out[distance:] -= x[:-distance] if distance < len(x) else 0
    return out.tobytes()


def undelta(data: bytes, distance: int) -> bytes:
    x = np.frombuffer(data, np.uint8)
    pad = -len(x) % distance
    table = np.concatenate([x, np.zeros(pad, np.uint8)]).reshape(-1, distance)
    return np.cumsum(table, axis=0, dtype=np.uint8).tobytes()[: len(x)]


def _sites(data: bytes) -> Iterator[int]:
    """Places that may hold a call's or jump's operand: after E8 or E9, or 0F 80 to 0F 8F.

    Whoever walks them passes over those whose opcode ends inside an operand.
    """
    x = np.frombuffer(data, np.uint8)
    found = (x == 0xE8) | (x == 0xE9)
    found[1:] |= (x[:-1] == 0x0F) & ((x[1:] & 0xF0) == 0x80)
    yield from (np.flatnonzero(found) + 1).tolist()


def x86(data: bytes) -> bytes:
    """Relative targets of E8 and E9 become absolute, if they lie inside the buffer."""
    return _turn(data, 1)


def unx86(data: bytes) -> bytes:
    return _turn(data, -1)


def _turn(data: bytes, sign: int) -> bytes:
    out, size, at = bytearray(data), len(data), 0
    # Targets map onto themselves modulo the buffer's size, so the way back finds the same sites.
    while at + 5 <= size:
        if out[at] in (0xE8, 0xE9):
            value = struct.unpack_from("<i", out, at + 1)[0]
            end = at + 5
            if sign > 0 and -end <= value < size:
                struct.pack_into("<i", out, at + 1, value + end if value < size - end else value - size)
            elif sign < 0:
                if value >= 0 and value < size:
                    struct.pack_into("<i", out, at + 1, value - end)
                elif value < 0 and value + end >= 0:
                    struct.pack_into("<i", out, at + 1, value + size)
            at += 5
        else:
            at += 1
    return bytes(out)


def x86_split(data: bytes) -> bytes | None:
    """Code, targets and flags apart: `<code length><site count>` code, big-endian targets, one bit per site."""
    code, targets, flags, done, free = bytearray(), bytearray(), [], 0, 0
    for at in _sites(data):
        if at <= free or at + 4 > len(data):
            continue
        free = at + 4
        target = free + struct.unpack_from("<i", data, at)[0]
        inside = 0 <= target < len(data)
        flags.append(inside)
        if inside:
            code += data[done:at]
            targets += struct.pack(">I", target)
            done = free
    code += data[done:]
    if not targets:
        return None
    return struct.pack("<II", len(code), len(flags)) + bytes(code) + bytes(targets) + np.packbits(np.array(flags, bool)).tobytes()


def unx86_split(data: bytes, length: int) -> bytes:
    """The code's sites are those of the whole: a target inside a unit has a top byte that completes no opcode."""
    n, sites = struct.unpack_from("<II", data)
    code, marks = data[8 : 8 + n], (sites + 7) // 8
    flags = np.unpackbits(np.frombuffer(data, np.uint8, marks, len(data) - marks))[:sites].tolist()
    moved = sum(flags)
    targets = struct.unpack_from(f">{moved}I", data, 8 + n)
    out, done, free, taken, site = [], 0, 0, 0, 0
    for at in _sites(code):
        place = at + 4 * taken
        if at <= free or place + 4 > length:
            continue
        if site >= sites:
            raise ValueError("more sites than flags")
        if flags[site]:
            out += [code[done:at], struct.pack("<i", targets[taken] - place - 4)]
            taken, done, free = taken + 1, at, at
        else:
            free = at + 4
        site += 1
    if site != sites:
        raise ValueError("more flags than sites")
    return b"".join([*out, code[done:]])


def wav_predict(data: bytes) -> bytes | None:
    """16- or 24-bit integer PCM: the wrapper as it is, then each channel's second differences as split byte planes."""
    found = wav_probe(data)
    if found is None:
        return None
    width, channels, first = found["bits"] // 8, found["channels"], found["data"]
    size = found["size"] - found["size"] % (width * channels)
    wide = np.zeros((size // width, 4), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, size, first).reshape(-1, width)
    samples = wide.view("<u4").reshape(-1, channels)
    for _ in range(2):
        samples = np.diff(samples, axis=0, prepend=np.zeros((1, channels), np.uint32))
    folded = ((samples << 1) ^ (0 - (samples >> np.uint32(found["bits"] - 1) & 1))).T.reshape(-1)
    planes = folded.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()
    # The width stands above the number of channels, 0 meaning two bytes.
    return struct.pack("<III", first, size, channels | (width << 8 if width != 2 else 0)) + data[:first] + data[first + size :] + planes


def unwav_predict(data: bytes, length: int) -> bytes:
    first, size, shape = struct.unpack_from("<III", data)
    channels, width = shape & 0xFF, shape >> 8 or 2
    if size > length or first + size > length or not 1 <= channels <= 8 or width not in (2, 3) or size % (width * channels):
        raise ValueError("a wrapper's sizes don't fit")
    rest, limit = length - size, np.uint32((1 << 8 * width) - 1)
    wide = np.zeros((size // width, 4), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, size, 12 + rest).reshape(width, -1).T
    folded = wide.view("<u4").reshape(channels, -1).T
    samples = (folded >> 1) ^ (0 - (folded & 1))
    for _ in range(2):
        samples = np.cumsum(samples, axis=0, dtype=np.uint32)
    plain = np.ascontiguousarray(samples & limit).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    return data[12 : 12 + first] + plain + data[12 + first : 12 + rest]


def wav_probe(data: bytes) -> dict | None:
    """The format and data chunk of a RIFF WAVE file of 16- or 24-bit integer PCM with at most 8 channels."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, shape = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(data):
            tag, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if tag == 0xFFFE and size >= 40:
                tag = struct.unpack_from("<H", data, at + 32)[0]
            if tag != 1 or bits not in (16, 24) or not 1 <= channels <= 8 or not 0 < rate <= 655_350 or align != channels * bits // 8:
                return None
            shape = {"channels": channels, "rate": rate, "bits": bits}
        elif name == b"data":
            return None if shape is None else shape | {"data": at + 8, "size": min(size, len(data) - at - 8)}
        at += 8 + size + size % 2
    return None


def _gzip_head(data: bytes, at: int) -> int | None:
    """Where the deflate stream of the gzip member at `at` begins."""
    if data[at : at + 3] != b"\x1f\x8b\x08" or len(data) < at + 18:
        return None
    flags, begin = data[at + 3], at + 10
    if flags & 4:
        begin += 2 + struct.unpack_from("<H", data, begin)[0]
    for bit in (8, 16):
        if flags & bit:
            begin = data.find(b"\0", begin) + 1
            if not begin:
                return None
    return begin + 2 * bool(flags & 2)


def _deflated(data: bytes, at: int) -> int | None:
    """The length of the raw deflate stream that begins at `at`; what it holds is thrown away piece by piece."""
    reader, fed = zlib.decompressobj(-15), at
    try:
        while not reader.eof:
            piece = reader.unconsumed_tail or data[fed : fed + (1 << 16)]
            if not reader.unconsumed_tail:
                fed += len(piece)
            if not piece:
                return None
            reader.decompress(piece, 1 << 20)
    except zlib.error:
        return None
    return fed - len(reader.unused_data) - at


def _gzip_streams(data: bytes) -> list[tuple[int, int, str]]:
    """One stream for each member of a gzip file."""
    out, at = [], 0
    while (begin := _gzip_head(data, at)) is not None and (length := _deflated(data, begin)):
        if length >= 64:
            out.append((begin, length, "gzip"))
        at = begin + length + 8
    return out


def _png_parts(data: bytes) -> list[tuple[int, int]]:
    """(offset, length) of what the IDAT chunks of a PNG file hold."""
    at, found = 8, []
    while at + 12 <= len(data):
        size = struct.unpack_from(">I", data, at)[0]
        if data[at + 4 : at + 8] == b"IDAT":
            found.append((at + 8, size))
        at += 12 + size
    return found


def _png_streams(data: bytes) -> list[tuple[int, int, str]]:
    """The stream of a PNG file with one IDAT chunk, without its zlib wrapper; `png_join` opens one cut into several."""
    found = _png_parts(data)
    if len(found) != 1 or found[0][1] < 70 or found[0][0] + found[0][1] > len(data):
        return []
    begin, size = found[0]
    return [(begin + 2, size - 6, "png")] if data[begin] & 0x0F == 8 else []


def png_join(data: bytes) -> bytes | None:
    """A PNG file with several IDAT chunks in a row: their contents joined and opened, what stood between them behind.

    `<parts><first><part lengths>`, then what `inflate` makes of the joined file.
    """
    parts = _png_parts(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else []
    if len(parts) < 2 or any(a + n + 12 != b for (a, n), (b, _) in zip(parts, parts[1:])) or sum(parts[-1]) > len(data):
        return None
    first, size = parts[0][0], sum(n for _, n in parts)
    if size < 70 or data[first] & 0x0F != 8:
        return None
    joined = data[:first] + b"".join(data[a : a + n] for a, n in parts) + b"".join(data[a + n : a + n + 12] for a, n in parts[:-1]) + data[sum(parts[-1]) :]
    made = inflate(joined, [(first + 2, size - 6, "png")])
    return None if made is None else struct.pack("<II", len(parts), first) + np.array([n for _, n in parts], "<u4").tobytes() + made


def unpng_join(data: bytes, length: int) -> bytes:
    count, first = struct.unpack_from("<II", data)
    sizes = np.frombuffer(data, "<u4", count, 8).tolist()
    joined, out = deflate_again(data[8 + 4 * count :], length), []
    body, gap = first, first + sum(sizes)
    for i, n in enumerate(sizes):
        out.append(joined[body : body + n])
        body += n
        if i + 1 < count:
            out.append(joined[gap : gap + 12])
            gap += 12
    return joined[:first] + b"".join(out) + joined[gap:]


def container_streams(data: bytes, depth: int = 0) -> list[tuple[int, int, str]]:
    """(offset, length, kind) of the deflate streams inside gzip, PNG, zip and PDF files, in order."""
    if data[:2] == b"\x1f\x8b":
        return _gzip_streams(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png_streams(data)
    if data[:4] == b"PK\3\4":
        return _zip_streams(data, depth)
    if data[:5] == b"%PDF-":
        return _pdf_streams(data)
    return []


def _zip_streams(data: bytes, depth: int) -> list[tuple[int, int, str]]:
    end = data.rfind(b"PK\5\6")
    if end < 0 or end + 22 > len(data):
        return []
    count, at, out = struct.unpack_from("<H", data, end + 10)[0], struct.unpack_from("<I", data, end + 16)[0], []
    for _ in range(count):
        if data[at : at + 4] != b"PK\1\2" or at + 46 > len(data):
            break
        method, packed, name, extra, note, local = struct.unpack_from("<H", data, at + 10)[0], struct.unpack_from("<I", data, at + 20)[0], *struct.unpack_from("<HHH", data, at + 28), struct.unpack_from("<I", data, at + 42)[0]
        if local + 30 <= len(data) and data[local : local + 4] == b"PK\3\4" and packed != 0xFFFFFFFF:
            body = local + 30 + sum(struct.unpack_from("<HH", data, local + 26))
            if method == 8 and packed >= 64 and body + packed <= len(data):
                out.append((body, packed, "zip"))
            elif method == 0 and depth < 3 and packed >= 64:
                out += [(body + a, n, kind) for a, n, kind in container_streams(data[body : body + packed], depth + 1)]
        at += 46 + name + extra + note
    return sorted(out)


def _pdf_end(data: bytes, begin: int, head: bytes) -> int:
    """Where a stream ends: after its direct length if that leads to its end mark, else at the next such mark."""
    told = re.search(rb"/Length\s+(\d{1,10})(?!\d|\s+\d+\s+R)", head)
    if told and data[begin + int(told[1]) : begin + int(told[1]) + 11].lstrip(b"\r\n").startswith(b"endstream"):
        return begin + int(told[1])
    return data.find(b"endstream", begin)


def _pdf_streams(data: bytes) -> list[tuple[int, int, str]]:
    out, at = [], 0
    while (at := data.find(b"stream", at)) >= 0:
        begin = at + 6
        if data[max(0, at - 3) : at] == b"end":
            at = begin
            continue
        begin += 2 if data[begin : begin + 2] == b"\r\n" else data[begin : begin + 1] == b"\n"
        head = data[max(0, at - 16_384) : at]
        head = head[head.rfind(b"obj") :]
        end = _pdf_end(data, begin, head)
        if end > begin and b"/FlateDecode" in head and data[begin] & 0x0F == 8 and end - begin > 70:
            out.append((begin + 2, end - begin - 2, "pdf"))
        at = max(begin, end)
    return out


def inflate(data: bytes, streams: list[tuple[int, int, str]] | None = None) -> bytes | None:
    """Deflate streams opened: only those that a level, memory size and strategy of zlib gives back exactly."""
    opened = []
    for at, size, _ in container_streams(data) if streams is None else streams:
        stream = zlib.decompressobj(-15)
        try:
            raw = stream.decompress(data[at : at + size], M.CODED_MAX)
        except zlib.error:
            continue
        used = size - len(stream.unused_data)
        if not stream.eof or used < 64:
            continue
        packed = data[at : at + used]
        for level, memory, strategy in [(6, 8, 0), (9, 8, 0), (1, 8, 0), (6, 9, 0), (9, 9, 0), *((x, 8, 0) for x in (2, 3, 4, 5, 7, 8)), (6, 8, 1), (9, 9, 1)]:
            again = zlib.compressobj(level, zlib.DEFLATED, -15, memory, strategy)
            if again.compress(raw) + again.flush() == packed:
                opened.append((at, used, raw, level, memory, strategy))
                break
    if not opened:
        return None
    out, done = bytearray(struct.pack("<I", len(opened))), 0
    gaps, raws = bytearray(), bytearray()
    for at, used, raw, *how in opened:
        out += struct.pack("<IIIBBB", at - done, used, len(raw), *how)
        gaps += data[done:at]
        raws += raw
        done = at + used
    return bytes(out) + struct.pack("<I", len(gaps)) + bytes(gaps) + bytes(raws) + data[done:]


def deflate_again(data: bytes, length: int) -> bytes:
    n = struct.unpack_from("<I", data)[0]
    streams = [struct.unpack_from("<IIIBBB", data, 4 + 15 * i) for i in range(n)]
    at = 4 + 15 * n
    gap = at + 4
    raw = gap + struct.unpack_from("<I", data, at)[0]
    out = bytearray()
    for before, used, size, level, memory, strategy in streams:
        out += data[gap : gap + before]
        gap += before
        again = zlib.compressobj(level, zlib.DEFLATED, -15, memory, strategy)
        packed = again.compress(data[raw : raw + size]) + again.flush()
        if len(packed) != used or len(out) > length:
            raise ValueError("a stream doesn't pack as it did")
        out += packed
        raw += size
    return bytes(out) + data[raw:]


#: MPEG audio Layer III bit rates in kbit/s by version (1, 2 and 2.5) and rates in Hz (fixed values).
_MP3_KBIT = {3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
_MP3_HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def mp3_frame(data: bytes, at: int) -> tuple[int, int, bool] | None:
    """(frame length, side information length, checksum) of a Layer III frame at `at`."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE6 != 0xE2:
        return None
    version, rate, hertz = data[at + 1] >> 3 & 3, data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version == 1 or rate in (0, 15) or hertz == 3:
        return None
    size = (144 if version == 3 else 72) * _MP3_KBIT[3 if version == 3 else 2][rate] * 1000 // _MP3_HZ[version][hertz] + (data[at + 2] >> 1 & 1)
    mono = data[at + 3] >> 6 == 3
    return size, (17 if mono else 32) if version == 3 else (9 if mono else 17), not data[at + 1] & 1


def mp3_planes(data: bytes) -> bytes | None:
    """Frames apart by part: what lies between, headers by column, checksums, side information by column, the rest."""
    frames, at = [], 0
    while at < len(data) - 4:
        frame = mp3_frame(data, at)
        if frame and at + frame[0] <= len(data) and frame[0] >= 4 + 2 * frame[2] + frame[1]:
            after = at + frame[0]
            if after >= len(data) - 4 or mp3_frame(data, after) or (frames and frames[-1][0] + frames[-1][1] == at):
                frames.append((at, *frame))
                at = after
                continue
        at += 1
    if len(frames) < 8 or len({side for _, _, side, _ in frames}) != 1:
        return None
    raw, heads, sums, sides, rest, done = bytearray(), [], bytearray(), [], bytearray(), 0
    gaps = []
    for a, size, side, checked in frames:
        gaps.append(a - done)
        raw += data[done:a]
        body = a + 4 + 2 * checked
        heads.append(data[a : a + 4])
        sums += data[a + 4 : body]
        sides.append(data[body : body + side])
        rest += data[body + side : a + size]
        done = a + size
    raw += data[done:]
    columns = lambda rows: np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1).T.tobytes()
    return struct.pack("<IIII", len(frames), len(raw), len(sums), len(sides[0])) + np.array(gaps, "<u4").tobytes() + bytes(raw) + columns(heads) + bytes(sums) + columns(sides) + bytes(rest)


def unmp3_planes(data: bytes, length: int) -> bytes:
    n, raw_size, sums_size, side = struct.unpack_from("<IIII", data)
    gaps = np.frombuffer(data, "<u4", n, 16).tolist()
    raw = 16 + 4 * n
    head = raw + raw_size
    sums = head + 4 * n
    sides = sums + sums_size
    rest = sides + side * n
    heads = np.frombuffer(data, np.uint8, 4 * n, head).reshape(4, n).T
    side_rows = np.frombuffer(data, np.uint8, side * n, sides).reshape(side, n).T
    out = bytearray()
    for i in range(n):
        out += data[raw : raw + gaps[i]]
        raw += gaps[i]
        top = heads[i].tobytes()
        size, _, checked = mp3_frame(top, 0)
        check = data[sums : sums + 2 * checked]
        sums += 2 * checked
        body = size - 4 - 2 * checked - side
        out += top + check + side_rows[i].tobytes() + data[rest : rest + body]
        rest += body
        if len(out) > length:
            raise ValueError("planes hold more than declared")
    return bytes(out) + data[raw : 16 + 4 * n + raw_size]


def apply_filter(kind: int, data: bytes) -> bytes | None:
    if kind == M.PLAIN:
        return data
    if M.DELTA_1 <= kind <= M.DELTA_1 + 31:
        return delta(data, kind - 1)
    return {M.X86: x86, M.X86_SPLIT: x86_split, M.MP3_PLANES: mp3_planes, M.WAV_PREDICT: wav_predict, M.INFLATE: inflate, M.PNG_JOIN: png_join}[kind](data)


def undo_filter(kind: int, data: bytes, length: int) -> bytes:
    if kind == M.PLAIN:
        return data
    if M.DELTA_1 <= kind <= M.DELTA_1 + 31:
        return undelta(data, kind - 1)
    if kind == M.X86:
        return unx86(data)
    undo: dict[int, Callable[[bytes, int], bytes]] = {M.X86_SPLIT: unx86_split, M.MP3_PLANES: unmp3_planes, M.WAV_PREDICT: unwav_predict, M.INFLATE: deflate_again, M.PNG_JOIN: unpng_join}
    if kind not in undo:
        raise ValueError(f"no such filter: {kind}")
    return undo[kind](data, length)


def proven(kind: int, data: bytes) -> bytes | None:
    """What the filter makes of `data`, if it gives `data` back and stays within bounds."""
    try:
        made = apply_filter(kind, data)
        if made is None or len(made) > M.CODED_MAX or undo_filter(kind, made, len(data)) != data:
            return None
    except (ValueError, struct.error, IndexError, TypeError):
        return None
    return made


# --- what a unit is


def entropy(data: bytes, distance: int = 0) -> float:
    """Order-0 entropy, in bits a byte, of the bytes or of their differences at a distance."""
    x = np.frombuffer(data, np.uint8)
    if distance:
        x = x[distance:] - x[:-distance]
    if not len(x):
        return float("inf") if distance else 0.0
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    return float(abs(-(p * np.log2(p)).sum()))


def stride(data: bytes) -> int:
    """The record width with the least entropy of differences, 0 if none takes 3 % off; at least 4096 bytes."""
    if len(data) < M.CONFIDENT:
        return 0
    plain = entropy(data)
    scores = [entropy(data, d) for d in range(1, M.DELTA_MAX + 1)]
    best = int(np.argmin(scores))
    return best + 1 if scores[best] < 0.97 * plain else 0


_PACKED = (b"Rar!\x1a\x07", b"7z\xbc\xaf\x27\x1c", b"\xfd7zXZ\0", b"\x28\xb5\x2f\xfd")


def classify(head: bytes) -> tuple[str, int]:
    """(kind, filter) of a unit from its first bytes."""
    if head.startswith(_PACKED) or head[4:8] == b"ftyp":
        return "store", M.PLAIN
    if head.startswith((b"PK\3\4", b"\x89PNG", b"\x1f\x8b", b"%PDF-")):
        return "container", M.INFLATE
    if head.startswith(b"\xff\xd8\xff"):
        return "jpeg", M.PLAIN
    if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        return "wav", M.WAV_PREDICT
    if is_mp3(head):
        return "mp3", M.MP3_PLANES
    if head.startswith((b"MZ", b"\x7fELF", b"\xcf\xfa\xed\xfe")):
        return "executable", M.X86_SPLIT
    sample = head[: 1 << 20]
    try:
        text = sample.decode()
    except UnicodeDecodeError as error:
        text = sample[: error.start].decode() if error.start > len(sample) - 4 else None
    if text is not None and (not text or sum(c.isprintable() or c in "\t\r\n" for c in text[:4096]) >= 0.95 * len(text[:4096])):
        return "text", M.PLAIN
    if len(zstandard.ZstdCompressor(level=1).compress(sample)) > 0.97 * len(sample):
        return "store", M.PLAIN
    width = stride(sample)
    if width:
        plain, moved = (len(lzma.compress(x, lzma.FORMAT_RAW, filters=_lzma_chain(len(x), 2))) for x in (sample, delta(sample, width)))
        if moved <= 0.98 * plain:
            return "binary", M.DELTA_1 + width - 1
    return "binary", M.PLAIN


def is_mp3(head: bytes) -> bool:
    """Whether three Layer III frames stand in a row at the start, or after an ID3v2 tag that ends within `head`."""
    at = 0
    if head[:3] == b"ID3" and len(head) >= 10:
        if max(head[6:10]) >= 0x80 or head[3] == 0xFF:
            return False
        at = 10 + sum(x << s for x, s in zip(head[6:10], (21, 14, 7, 0))) + 10 * bool(head[5] & 0x10)
    for _ in range(3):
        frame = mp3_frame(head, at)
        if frame is None or not frame[0]:
            return False
        at += frame[0]
    return True


def field(kind: str, level: str) -> list[tuple[int, int]]:
    """The codecs that race for a unit, in the order that breaks ties."""
    if kind in ("store", "jpeg"):
        return [(M.STORE, 0)]
    zstd = (M.ZSTD, M.ZSTD_LEVELS[level])
    if level == "fast":
        return [zstd]
    if level == "normal":
        return [zstd, (M.BZ2, 9)]
    return [(M.LZMA2, M.LZMA_PRESETS[level]), zstd, (M.BZ2, 9)]


def spread(data: bytes, runs: int = 8, share: int = 16) -> bytes:
    run, step = len(data) // (runs * share), len(data) // runs
    return b"".join(data[step * i : step * i + run] for i in range(runs))


def pack(data: bytes, level: str = "normal", vote: tuple[str, int] | None = None) -> tuple[int, int, int, int, bytes]:
    """(codec, param, filter, filtered length or 0, packed bytes) of a unit: the smallest form that gives it back.

    `vote` is the (kind, filter) of most of its bytes, if its files are large enough to tell; else its head tells.
    """
    kind, wanted = vote or classify(data)
    if wanted == M.INFLATE and len(_png_parts(data) if data[:4] == b"\x89PNG" else ()) > 1:
        wanted = M.PNG_JOIN
    made = proven(wanted, data)
    if made is None:
        wanted, made = M.PLAIN, data
    racers = field(kind, level)
    if len(racers) >= 3 and len(made) >= 4 << 20:
        sizes = [len(compress(c, p, spread(made))) for c, p in racers]
        kept = [x for x, n in zip(racers, sizes) if x[0] == M.BZ2 or n * 100 <= min(sizes) * 115]
        racers = kept or racers
    codec, param, coded = min(((c, p, compress(c, p, made)) for c, p in racers), key=lambda x: len(x[2]))
    if min(len(coded), len(made)) >= len(data):
        return M.STORE, 0, M.PLAIN, 0, data
    if len(made) < len(coded):
        codec, param, coded = M.STORE, 0, made
    return codec, param, wanted, 0 if len(made) == len(data) else len(made), coded


def unpack(codec: int, param: int, kind: int, filtered: int, unpacked: int, packed: bytes) -> bytes:
    if max(len(packed), unpacked) > M.STORED_MAX:
        raise ValueError("a unit is out of bounds")
    out = undo_filter(kind, decompress(codec, param, packed, filtered or unpacked), unpacked)
    if len(out) != unpacked:
        raise ValueError("a unit has another length than declared")
    return out


# --- over DataFrames


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def batched(rows: Iterator[dict], schema: pa.Schema, *held: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches that end once their columns `held` have `limit` bytes, or at 1000 rows."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += sum(len(row[x] or b"") for x in held)
        if size >= limit or len(kept) == 1000:
            yield pa.RecordBatch.from_pylist(kept, schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema)


_PACKED_UNIT = pa.schema([("unit", pa.int64()), ("hash", pa.string()), *((x, pa.int64()) for x in ("packed", "unpacked", "filtered")), *((x, pa.int32()) for x in ("codec", "param", "filter")), ("data", pa.binary())])


def pack_units(units: DataFrame, level: str = "normal") -> DataFrame:
    """(unit, data, and if there are votes kind, filter) -> (unit, hash, packed, unpacked, filtered, codec, param, filter, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def packed_rows() -> Iterator[dict]:
            for row in _rows(batches):
                data = row["data"] or b""
                codec, param, kind, filtered, packed = pack(data, level, (row["kind"], row["filter"]) if row["kind"] is not None else None)
                yield {"unit": row["unit"], "hash": hashlib.sha256(data).hexdigest()[:32], "packed": len(packed), "unpacked": len(data), "filtered": filtered, "codec": codec, "param": param, "filter": kind, "data": packed}

        yield from batched(packed_rows(), _PACKED_UNIT, "data")

    voted = "kind" in units.columns
    given = units.select("unit", "data", *(["kind", "filter"] if voted else [F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("filter")]))
    return given.mapInArrow(run, "unit long, hash string, packed long, unpacked long, filtered long, codec int, param int, filter int, data binary")


def unpack_units(units: DataFrame) -> DataFrame:
    """Packed units -> (unit, data, why): the bytes, or why they can't be had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def opened() -> Iterator[dict]:
            for row in _rows(batches):
                data, why = None, None
                try:
                    if row["data"] is None:
                        raise ValueError("its bytes are missing")
                    data = unpack(row["codec"], row["param"], row["filter"], row["filtered"], row["unpacked"], row["data"])
                    if hashlib.sha256(data).hexdigest()[:32] != row["hash"]:
                        raise ValueError("its bytes differ from its hash")
                except (ValueError, struct.error, IndexError) as error:
                    data, why = None, str(error)
                yield {"unit": row["unit"], "data": data, "why": why}

        yield from batched(opened(), pa.schema([("unit", pa.int64()), ("data", pa.binary()), ("why", pa.string())]), "data")

    return units.select("unit", "hash", "unpacked", "filtered", "codec", "param", "filter", "data").mapInArrow(run, "unit long, data binary, why string")


def race_table(units: DataFrame, level: str = "max") -> DataFrame:
    """(unit, place, codec, param, coded): one row, and so possibly one task, for each unit and codec that races for it."""
    racers = [(i, c, p) for i, (c, p) in enumerate(field("binary", level))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(compress(c, p, d or b"")) for c, p, d in zip(batch.column("codec").to_pylist(), batch.column("param").to_pylist(), batch.column("data").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("unit", "place", "codec", "param")), pa.array(sizes, pa.int64())], ["unit", "place", "codec", "param", "coded"])

    every = units.select("unit", "data", F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("codec"), F.lit(p).alias("param")) for i, c, p in racers])).alias("r"))
    return every.select("unit", "r.place", "r.codec", "r.param", "data").mapInArrow(run, "unit long, place int, codec int, param int, coded long")


def race(units: DataFrame, level: str = "max") -> DataFrame:
    """The winner of each unit: least bytes, the earliest in the field among equals."""
    best = race_table(units, level).groupBy("unit").agg(F.min(F.struct("coded", "place", "codec", "param")).alias("w"))
    return best.select("unit", "w.codec", "w.param", "w.coded")


_RACED = pa.schema([("unit", pa.int64()), ("kind", pa.string()), ("filter", pa.int32()), ("unpacked", pa.int64()), ("fed", pa.int64()), ("codec", pa.int32()), ("param", pa.int32()), ("coded", pa.int64()), ("ms", pa.float64())])


def tourney(units: DataFrame, level: str) -> DataFrame:
    """(unit, data, filter) -> (unit, kind, filter, unpacked, fed, codec, param, coded, ms): each codec's run over a unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def raced() -> Iterator[dict]:
            for row in _rows(batches):
                data = row["data"] or b""
                kind, _ = classify(data)
                fed = apply_filter(row["filter"], data)
                fed = data if fed is None else fed
                for codec, param in field(kind, level):
                    begun = time.perf_counter()
                    coded = len(compress(codec, param, fed))
                    yield {"unit": row["unit"], "kind": kind, "filter": row["filter"], "unpacked": len(data), "fed": len(fed), "codec": codec, "param": param, "coded": coded, "ms": (time.perf_counter() - begun) * 1000}

        yield from batched(raced(), _RACED)

    return units.select("unit", "data", "filter").mapInArrow(run, "unit long, kind string, filter int, unpacked long, fed long, codec int, param int, coded long, ms double")
