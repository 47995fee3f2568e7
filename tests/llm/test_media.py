import hashlib
import random
import struct
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 8))
def test_lzw_round_trip(data, repeat):
    data = data * repeat
    assert media.lzw_decoded(media.lzw_encoded(data), 8, len(data)) == data


def test_lzw_round_trip_over_many_clear_codes():
    r = random.Random(1)
    for data in (bytes(r.randrange(256) for _ in range(30000)), b"ab" * 30000, bytes(60000), " ".join(r.choice(["the", "of", "then"]) + str(r.randrange(99)) for _ in range(9000)).encode()):
        assert media.lzw_decoded(media.lzw_encoded(data), 8, len(data)) == data


def plain_lzw(samples, least):
    """A bit-by-bit encoder that never clears its full table."""
    clear, end = 1 << least, (1 << least) + 1
    out, width, known, nxt = [(clear, least + 1)], least + 1, {(i,): i for i in range(clear)}, end + 1
    w = ()
    for s in samples:
        if (*w, s) in known:
            w = (*w, s)
            continue
        out.append((known[w], width))
        if nxt < 4096:
            known[(*w, s)] = nxt
            if nxt == 1 << width and width < 12:
                width += 1
            nxt += 1
        w = (s,)
    out += [(known[w], width)]
    if nxt == 1 << width and width < 12:
        width += 1
    out.append((end, width))
    bits = "".join(format(c, f"0{n}b")[::-1] for c, n in out)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


def test_decoder_takes_other_code_sizes_and_deferred_clears():
    r = random.Random(2)
    for least in (2, 3, 5, 8):
        samples = [r.randrange(1 << least) for _ in range(40000 if least == 8 else 3000)]
        assert list(media.lzw_decoded(plain_lzw(samples, least), least, len(samples))) == samples


def test_disposal_transparency_interlace_and_palettes():
    def frame(x, y, rows, dispose, clear=None, palette=b"", lace=False):
        h, w = len(rows), len(rows[0])
        order = [r for a, s in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, h, s)] if lace else range(h)
        flat = [v for r in order for v in rows[r]]
        flags = (0x80 | (len(palette) // 3).bit_length() - 2 if palette else 0) | (0x40 if lace else 0)
        return b"\x21\xf9\x04" + struct.pack("<BHBB", dispose << 2 | (clear is not None), 7, clear or 0, 0) + b"\x2c" + struct.pack("<HHHHB", x, y, w, h, flags) + palette + b"\x02" + media._blocks(plain_lzw(flat, 2))

    shared = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    gif = b"GIF89a" + struct.pack("<HHBBB", 3, 3, 0x81, 0, 0) + shared
    gif += frame(0, 0, [[1, 1, 1]] * 3, 1) + frame(1, 1, [[2, 0]], 2, clear=0) + frame(0, 0, [[3]], 3) + frame(2, 2, [[1]], 1, palette=bytes([9, 9, 9] * 2 + [7, 7, 7] * 2)) + frame(0, 0, [[0, 0, 0], [1, 1, 1], [2, 2, 2]], 0, lace=True) + b"\x3b"
    red, green, blue, none = 0xFFFF0000, 0xFF00FF00, 0xFF0000FF, 0
    shown = [f.canvas.tolist() for f in (media.Frame(g.start_ms, g.delay_ms, g.box, g.canvas.copy()) for g in media.gif_frames(gif))]
    assert shown[0] == [[red] * 3] * 3
    assert shown[1] == [[red] * 3, [red, green, red], [red] * 3]
    assert shown[2] == [[blue, red, red], [red, none, none], [red] * 3]
    assert shown[3] == [[red] * 3, [red, none, none], [red, red, 0xFF090909]]
    assert shown[4] == [[0xFF000000] * 3, [red] * 3, [green] * 3]
    times = [(f.start_ms, f.delay_ms) for f in media.gif_frames(gif)]
    assert times[:2] == [(0, 70), (70, 70)]
    assert media.histogram(np.array([[red, blue, none, none]], np.uint32))[[0x30, 0x03, 0]].tolist() == [1, 1, 2]


def test_texts_round_trip(spark):
    texts = [None, "", "a", "x" * 576, "é" * 577, "long text 𝄞 " * 9000, "a"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "a", 1)], "doc_id long, text string, media int")
    m = media.encoded(df)
    got = {r.id: r for r in media.summaries(m).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        g = got[i]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
    assert got[2].feature == got[6].feature == got[None].feature != got[3].feature
    fr = media.frames(m).where("id = 5").orderBy("frame").collect()
    assert len(fr) == got[5].frames and sum(map(sum, (f.histogram for f in fr))) == 576 * 64 * len(fr) and fr[1].start_ms == 40
    assert media.summaries(media.encoded(df.limit(0))).count() == 0


def test_broken_and_null_media_have_defined_results(spark):
    whole = media.gif_of(b"\x07" * 576, 3)
    wide = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"
    cases = {1: whole, 2: whole[:-40], 3: b"not a gif", 4: None, 5: b"", 6: wide, 7: whole[:-1]}
    m = spark.createDataFrame(list(cases.items()), "id long, media binary")
    fr = {}
    for r in media.frames(m).collect():
        fr.setdefault(r.id, []).append((r.frame, r.error is None))
    assert fr == {1: [(0, True)], 2: [(None, False)], 3: [(None, False)], 5: [(None, False)], 6: [(None, False)], 7: [(0, True)]}
    got = {r.id: r for r in media.summaries(m).collect()}
    assert got[1].n_bytes == 3 and got[1].timed[0].histogram[0] == 576 and got[1].error is None
    assert got[4].frames is None and got[4].error is None and got[2].error and got[2].frames is None and got[3].media_bytes == 9
