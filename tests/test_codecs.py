"""Codecs and filters give back what they were given, and refuse what they can't."""

import gzip
import io
import math
import random
import struct
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moraine import model as M
from moraine.operators import codecs as C


def _wav(bits=16, tag=1, tail=b"tail"):
    frames = b"".join(struct.pack("<hh", int(9000 * math.sin(i / 30)), int(8000 * math.cos(i / 40))) for i in range(4000))
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, tag, 2, 44100, 176400, 4, bits) + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(frames)) + frames
    return b"RIFF" + struct.pack("<I", 99) + body + tail


def _mp3(n=40):
    return b"ID3junk" + b"".join(b"\xff\xfb\x90\x00" + bytes((i * k) % 251 for k in range(413)) for i in range(n)) + b"TAG"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([M.ZSTD, M.LZMA2, M.BZ2, M.STORE]))
def test_codecs_round_trip(data, codec):
    param = {M.ZSTD: 3, M.LZMA2: 2}.get(codec, 0)
    packed = C.compress(codec, param, data)
    assert C.decompress(codec, param, packed, len(data)) == data
    assert packed == C.compress(codec, param, data)


@pytest.mark.parametrize("codec", [M.ZSTD, M.LZMA2, M.BZ2, M.STORE])
def test_codecs_hold_to_the_declared_length(codec):
    packed = C.compress(codec, 3, b"some text " * 50)
    for length in (0, 499, 501):
        with pytest.raises(ValueError):
            C.decompress(codec, 3, packed, length)


def test_unknown_ids_are_refused():
    for codec in (M.PPMD, M.BWT, 200):
        with pytest.raises(ValueError):
            C.decompress(codec, 0, b"x", 1)
    with pytest.raises(ValueError):
        C.undo_filter(34, b"x", 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0xE8, 0xE9, 0x0F, 0x85, 0, 1, 0xFF]), max_size=400).map(bytes), st.integers(1, 32))
def test_filters_round_trip(data, distance):
    assert C.undelta(C.delta(data, distance), distance) == data
    assert C.unx86(C.x86(data)) == data
    made = C.proven(M.X86_SPLIT, data)
    assert made is None or C.undo_filter(M.X86_SPLIT, made, len(data)) == data


def test_delta_example():
    assert list(C.delta(bytes([10, 20, 13, 25, 16]), 2)) == [10, 20, 3, 5, 3]


def test_x86_split_moves_targets():
    rng = random.Random(1)
    code = b"".join(bytes(rng.randrange(0x70) for _ in range(9)) + b"\xe8" + rng.randrange(-2000, 40000).to_bytes(4, "little", signed=True) for _ in range(2000))
    assert C.proven(M.X86_SPLIT, code) is not None


def test_wav_predicts_and_refuses():
    good = _wav()
    made = C.proven(M.WAV_PREDICT, good)
    assert made is not None and len(C.compress(M.ZSTD, 3, made)) < len(C.compress(M.ZSTD, 3, good)) / 2
    assert C.wav_predict(_wav(bits=32)) is None and C.wav_predict(_wav(tag=3)) is None and C.wav_predict(b"RIFF") is None


def test_mp3_planes():
    assert C.proven(M.MP3_PLANES, _mp3()) is not None
    assert C.mp3_planes(_mp3(3)) is None


def test_deflate_is_opened_and_closed_again():
    text = b"text that repeats itself and repeats itself " * 300
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("a.txt", text)
        out.writestr("b.txt", text[::-1])
    for data in (gzip.compress(text, 6), held.getvalue()):
        made = C.proven(M.INFLATE, data)
        assert made is not None and len(made) > len(data)
    assert C.inflate(gzip.compress(text, 6)[:-40]) is None
    assert C.inflate(b"\x1f\x8b\x08") is None


def test_pack_keeps_the_smallest_form():
    rng = random.Random(2)
    noise = bytes(rng.randrange(256) for _ in range(20_000))
    assert C.pack(noise)[:4] == (M.STORE, 0, M.PLAIN, 0)
    records = b"".join(struct.pack("<IHHI", i * 7, i % 9, 1, i * 3) for i in range(3000))
    codec, param, kind, filtered, packed = C.pack(records, "max")
    assert M.DELTA_1 <= kind <= M.DELTA_1 + 31 and filtered == 0 and len(packed) < len(records) / 10
    assert C.unpack(codec, param, kind, filtered, len(records), packed) == records
    for data in (b"", b"x", _wav(), _mp3(), gzip.compress(b"abc" * 4000)):
        for level in ("fast", "normal", "max"):
            *how, packed = C.pack(data, level)
            assert C.unpack(*how, len(data), packed) == data and len(packed) <= len(data)


def test_damage_is_an_error():
    codec, param, kind, filtered, packed = C.pack(b"some words " * 500)
    with pytest.raises(ValueError):
        C.unpack(codec, param, kind, filtered, 5500, packed[:-5])
    with pytest.raises(ValueError):
        C.unpack(codec, param, kind, filtered, M.STORED_MAX + 1, packed)


def test_strides():
    assert C.stride(b"".join(struct.pack("<III", i, 2 * i, 7) for i in range(1000))) in (4, 8, 12)
    assert C.stride(b"short") == 0 and C.entropy(b"") == 0.0 and C.entropy(bytes(range(256))) == 8.0


def test_streams_of_concatenated_gzip_and_png():
    import gzip
    import struct
    import zlib

    from moraine.operators import codecs as C

    texts = [bytes(f"line {n} of member {m}\n" * 1, "ascii") for m in range(2) for n in range(200)]
    members = [gzip.compress(b"".join(texts[:200])), gzip.compress(b"".join(texts[200:]))]
    data = b"".join(members)
    found = C.container_streams(data)
    assert [zlib.decompress(data[a : a + n], -15) for a, n, _ in found] == [b"".join(texts[:200]), b"".join(texts[200:])]
    assert C.container_streams(data[:-20])[:1] == found[:1] and C.container_streams(b"\x1f\x8b\x08" + b"x" * 40) == []

    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    pixels = bytes(range(256)) * 40
    packed = zlib.compress(pixels)
    head = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 40, 8, 6, 0, 0, 0))
    png = head + chunk(b"IDAT", packed) + chunk(b"IEND", b"")
    ((at, n, kind),) = C.container_streams(png)
    assert kind == "png" and zlib.decompress(png[at : at + n], -15) == pixels
    assert C.container_streams(head + chunk(b"IDAT", packed[:90]) + chunk(b"IDAT", packed[90:])) == []


def test_mp3_is_told_by_a_chain_of_frames():
    from moraine.operators import codecs as C

    frame = b"\xff\xfb\x90\x00"
    whole = frame + bytes(C.mp3_frame(frame, 0)[0] - 4)
    tag = b"ID3\x04\x00\x00\x00\x00\x01\x00" + bytes(128)
    assert C.is_mp3(whole * 3) and C.is_mp3(tag + whole * 3)
    assert not any(C.is_mp3(x) for x in (b"", b"ID3", b"ID3 is a format of tags, and this is a text about it. " * 40, whole * 2, tag + b"text", b"ID3\x04\x00\x00\xff\x00\x01\x00" + whole * 3))
    assert C.classify(b"ID3 is a format of tags, and this is a text about it. " * 40)[0] == "text"


def _near_calls(rng, n=3000, last=None):
    """Code with calls and far jumps, some operands ending in an opcode's first or last byte."""
    out = bytearray()
    for _ in range(n):
        out += bytes(rng.randrange(256) for _ in range(rng.randrange(6))) + rng.choice([b"\xe8", b"\xe9", b"\x0f\x84", b"\x0f\x8f"])
        out += rng.randrange(-3000, 9000).to_bytes(4, "little", signed=True) if rng.random() < 0.7 else bytes(rng.randrange(256) for _ in range(3)) + rng.choice([b"\xe8", b"\x0f", b"\x85"])
    return bytes(out)


def test_x86_split_takes_real_code():
    for seed in range(5):
        code = _near_calls(random.Random(seed))
        made = C.x86_split(code)
        assert made is not None and C.unx86_split(made, len(code)) == code
    for name in ("/bin/ls", "/bin/bash"):
        try:
            real = open(name, "rb").read()
        except OSError:
            continue
        made = C.proven(M.X86_SPLIT, real)
        assert made is not None and len(C.compress(M.LZMA2, 2, made)) < len(C.compress(M.LZMA2, 2, real))
    made = C.x86_split(_near_calls(random.Random(9)))
    with pytest.raises((ValueError, struct.error)):
        C.unx86_split(made[:-300], 10)


@pytest.mark.parametrize("channels, extra", [(1, 0), (2, 0), (2, 5)])
def test_24_bit_sound_is_predicted(channels, extra):
    samples = [int(4_000_000 * math.sin(i / 50 + c)) for i in range(5000) for c in range(channels)]
    frames = b"".join((x & 0xFFFFFF).to_bytes(3, "little") for x in samples) + bytes(extra)
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, 48_000, 48_000 * 3 * channels, 3 * channels, 24) + b"data" + struct.pack("<I", len(frames)) + frames
    data = b"RIFF" + struct.pack("<I", len(head)) + head
    made = C.proven(M.WAV_PREDICT, data)
    assert made is not None and len(C.compress(M.ZSTD, 3, made)) < len(C.compress(M.ZSTD, 3, data)) * 0.7


def test_png_in_several_chunks_is_opened():
    import zlib

    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    packed = zlib.compress(b"".join(bytes([i % 251, i % 7, 0, 255]) for i in range(30_000)), 9)
    cut = [packed[i : i + 100] for i in range(0, len(packed), 100)]
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + b"".join(chunk(b"IDAT", x) for x in cut) + chunk(b"IEND", b"")
    made = C.proven(M.PNG_JOIN, png)
    assert len(cut) > 2 and made is not None and len(made) > len(png)
    codec, param, kind, filtered, small = C.pack(png)
    assert C.unpack(codec, param, kind, filtered, len(png), small) == png and kind == M.PNG_JOIN
    assert C.png_join(png[:-300]) is None and C.png_join(b"\x89PNG") is None
    apart = png.replace(chunk(b"IDAT", cut[1]), chunk(b"IDAT", cut[1]) + chunk(b"tEXt", b"x"))
    assert C.png_join(apart) is None


def test_pdf_streams_end_after_their_direct_length():
    import zlib

    for text in (b"".join(b"word %d in a page " % i for i in range(400)), bytes(range(256)) * 30 + b"endstream in a text"):
        body = zlib.compress(text, 0 if b"endstream" in text else 6)
        for told in (b"/Length %d" % len(body), b"/Length 9 0 R"):
            pdf = b"%PDF-1.4\n1 0 obj\n<< " + told + b" /Filter /FlateDecode >>\nstream\n" + body + b"\nendstream\nendobj\n"
            found = C.container_streams(pdf)
            if b"R" not in told:
                (at, n, _), = found
                assert zlib.decompress(pdf[at - 2 : at + n]) == text and n == len(body) - 2
            elif b"endstream" not in text:
                assert len(found) == 1


def test_votes_decide_a_units_filter():
    records = b"".join(struct.pack("<IHHI", i * 7, i % 9, 1, i * 3) for i in range(3000))
    for vote, kind in ((("binary", M.DELTA_1 + 11), M.DELTA_1 + 11), (("binary", M.PLAIN), M.PLAIN)):
        *how, packed = C.pack(records, "fast", vote)
        assert how[2] == kind and C.unpack(*how, len(records), packed) == records
