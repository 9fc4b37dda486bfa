"""BPE, motion JPEG and the quality network against libraries, round trips and held-out rows."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm import byte_bpe, media, quality_cnn

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
OWN = byte_bpe.loaded(PATH, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=OWN.ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab é\n\u00a0\u2009\x1c'st!12日😀", max_size=60)))
def test_bpe_equals_the_library_and_decodes(text):
    ids = OWN.encode(text)
    assert ids == LIBRARY.encode_ordinary(text) and OWN.decode(ids) == text.encode()


def test_bpe_long_piece_and_frames(spark):
    assert OWN.encode("ab" * 30_000) == LIBRARY.encode_ordinary("ab" * 30_000)
    frame = spark.createDataFrame([(1, "héllo wörld"), (1, "héllo wörld"), (None, None), (2, "")], "doc_id long, text string").selectExpr("*", "0 as ids", "1 as _text")
    got = sorted((str(r.doc_id), list(r.ids), bytes(r.decoded)) for r in byte_bpe.encode_texts(frame, PATH, public_tokenizers.PATTERN).collect())
    ids = LIBRARY.encode_ordinary("héllo wörld")
    assert got == [("1", ids, "héllo wörld".encode())] * 2 + [("2", [], b""), ("None", [], b"")]
    assert byte_bpe.encode_texts(frame.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000))
def test_media_round_trip(data):
    payload = media.payload_of(data)
    assert len(payload) % 576 == 0 and payload.startswith(data) and set(payload[len(data) :]) <= {255}
    frames, rate = media.read_avi(media.write_avi(media.write_frames(payload)))
    coefficients, shown = media.decode_frames(frames)
    assert media.payload_from(coefficients) == payload and rate == 25 and shown.shape == (len(frames), 24, 24)
    shots = media.find_shots(shown)
    assert shots[0][0] == 0 and shots[-1][1] == len(frames) and all(a[1] == b[0] for a, b in zip(shots, shots[1:]))


def test_media_finds_cuts_and_refuses_broken_files(spark):
    dark, light = np.zeros((24, 24), np.uint8), np.full((24, 24), 200, np.uint8)
    assert media.find_shots(np.stack([dark] * 5 + [light] * 4 + [dark] * 3)) == [(0, 5), (5, 9), (9, 12)]
    file = media.write_avi(media.write_frames(bytes(576)))
    for broken in (b"", b"RIFF", file[:60], file.replace(b"MJPG", b"XVID", 1), file[:-4] + struct.pack("<I", 1 << 30)):
        with pytest.raises((ValueError, struct.error)):
            media.decode_frames(media.read_avi(broken)[0] or [b""])
    broken = spark.createDataFrame([(1, bytearray(file)), (2, bytearray(file[:60])), (3, None)], "doc_id long, media binary").selectExpr("*", "1 as clips", "2 as _file")
    got = {r.doc_id: (len(r.clips), r.error is None) for r in media.file_clips(broken).collect()}
    assert got == {1: (1, True), 2: (0, False), 3: (0, False)}
    frame = spark.createDataFrame([(1, "x" * 3000), (1, "x" * 3000), (None, None)], "doc_id long, text string").selectExpr("*", "1 as media")
    made = media.media_columns(frame).collect()
    assert len({bytes(r.media) for r in made}) == 2 and sum(len(r.payload) for r in made) == 2 * 3456 + 576
    clips = media.clip_rows(media.media_columns(frame)).collect()
    assert {(r.clip, r.start_frame) for r in clips} >= {(0, 0)}
    assert media.media_columns(frame.limit(0)).count() == 0


def plain_inverse(block):
    """The cosine sum of the standard, sample by sample."""
    order, r, c, up = [], 0, 0, True
    for _ in range(64):
        order.append((r, c))
        if up:
            r, c, up = (r, c + 1, False) if r == 0 and c < 7 else (r + 1, c, False) if c == 7 else (r - 1, c + 1, True)
        else:
            r, c, up = (r + 1, c, True) if c == 0 and r < 7 else (r, c + 1, True) if r == 7 else (r + 1, c - 1, False)
    out = np.zeros((8, 8))
    for value, (v, u) in zip(block, order):
        scale = (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4
        for y in range(8):
            for x in range(8):
                out[y, x] += scale * value * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    return np.clip(np.rint(out + 128), 0, 255)


def test_samples_equal_the_plain_cosine_sum():
    rng = np.random.default_rng(5)
    payload = rng.integers(0, 256, 1152, dtype=np.uint8).tobytes()
    coefficients, shown = media.decode_frames(media.write_frames(payload))
    for frame, by, bx in ((0, 0, 0), (0, 1, 2), (1, 2, 1)):
        block = coefficients[9 * frame + 3 * by + bx]
        assert np.abs(shown[frame, 8 * by : 8 * by + 8, 8 * bx : 8 * bx + 8] - plain_inverse(block)).max() <= 1


def foreign_frame(blocks, width, height, steps, restart, colours):
    """A frame by another writer: codes of several lengths, runs, quantisation, prediction, colours of half resolution."""
    sizes = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    dc = {s: (4, i) for i, s in enumerate(sizes)}
    symbols = [0x00, 0xF0, *[16 * run + size for run in range(16) for size in range(1, 9)]]
    ac = {s: (3, 0) if i == 0 else (9, 128 + i) for i, s in enumerate(symbols)}

    def table(kind, codes):
        by = sorted(codes.items(), key=lambda x: x[1])
        counts = [sum(length == n for _, (length, _) in by) for n in range(1, 17)]
        return media._segment(0xC4, bytes([kind, *counts, *[s for s, _ in by]]))

    # Codes as the standard derives them from counts per length.
    def derived(codes):
        out, code = {}, 0
        for n in range(1, 17):
            for s, (length, _) in sorted(codes.items(), key=lambda x: x[1]):
                if length == n:
                    out[s] = (n, code)
                    code += 1
            code *= 2
        return out

    dc_codes, ac_codes = derived(dc), derived(ac)
    bits, scan, before, turn = "", b"", [0] * 3, 0

    def number(v):
        n = abs(int(v)).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def put(block, which):
        nonlocal bits
        n, tail = number(int(block[0]) - before[which])
        before[which] = int(block[0])
        bits += format(dc_codes[n][1], f"0{dc_codes[n][0]}b") + tail
        last = max([i for i in range(1, 64) if block[i]], default=0)
        run = 0
        for v in block[1 : last + 1]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                bits += format(ac_codes[0xF0][1], f"0{ac_codes[0xF0][0]}b")
                run -= 16
            n, tail = number(int(v))
            bits += format(ac_codes[16 * run + n][1], f"0{ac_codes[16 * run + n][0]}b") + tail
            run = 0
        if last < 63:
            bits += format(ac_codes[0][1], f"0{ac_codes[0][0]}b")

    def flush():
        nonlocal bits, scan
        bits += "1" * (-len(bits) % 8)
        scan += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
        bits = ""

    rows, columns = blocks.shape[:2]
    step = 2 if colours else 1
    units = [(r, c) for r in range(0, rows, step) for c in range(0, columns, step)]
    for at, (r, c) in enumerate(units):
        if restart and at and at % restart == 0:
            flush()
            scan += bytes((0xFF, 0xD0 + turn % 8))
            turn += 1
            before[:] = [0] * 3
        for y in range(step):
            for x in range(step):
                put(blocks[r + y, c + x], 0)
        if colours:
            put([5, 0, 3] + [0] * 61, 1)
            put([-7] + [0] * 63, 2)
    flush()
    parts = [(1, 0x22 if colours else 0x11, 0), *([(2, 0x11, 0), (3, 0x11, 0)] if colours else [])]
    head = b"\xff\xd8" + media._segment(0xE0, b"JFIF\0") + media._segment(0xDB, bytes([0, *steps]))
    head += media._segment(0xC0, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes(p) for p in parts))
    head += table(0x01, dc) + table(0x12, ac) + (media._segment(0xDD, struct.pack(">H", restart)) if restart else b"")
    head += media._segment(0xDA, bytes([len(parts), *[x for p in parts for x in (p[0], 0x12)], 0, 63, 0]))
    return head + scan + b"\xff\xd9"


@pytest.mark.parametrize("colours", [False, True])
@pytest.mark.parametrize("restart", [0, 2])
def test_frames_of_another_writer_decode(colours, restart):
    rng = np.random.default_rng(3)
    blocks = np.where(rng.random((4, 6, 64)) < 0.1, rng.integers(-40, 41, (4, 6, 64)), 0)
    blocks[:, :, 0] = rng.integers(-60, 60, (4, 6))
    steps = [int(x) for x in rng.integers(1, 20, 64)]
    frame = foreign_frame(blocks, 43, 30, steps, restart, colours)
    coefficients, shown = media.decode_frames([frame, frame])
    assert shown.shape == (2, 30, 43) and (coefficients[:24] == blocks.reshape(-1, 64)).all()
    want = plain_inverse(blocks[1, 2] * np.array(steps))
    assert np.abs(shown[1, 8:16, 16:24] - want).max() <= 1
    with pytest.raises(ValueError):
        media.payload_from(coefficients)


def rows(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(int(rng.integers(5, 400)))]
        good = rng.random() < 0.7
        out.append((i, " ".join(words) if good else "%%% ".join(words), int(good)))
    return out


def test_network_learns_and_scores_alike(spark):
    data = rows(500, 1)
    docs = spark.createDataFrame([r[:2] for r in data] + [(None, None), (9001, ""), (3, data[3][1])], "doc_id long, text string").selectExpr("*", "1 as score", "'x' as _text")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in data] + [(None, 1, 0), (7, None, 0), (8, 5, 0)], "doc_id long, quality int, toxic int")
    net = quality_cnn.fit(docs, labels)
    got = quality_cnn.score_quality(docs, net).collect()
    assert len(got) == 503 and all(0 <= r.score <= 1 for r in got)
    truth = {r[0]: r[2] for r in data}
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held) / len(held) > 0.95
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert quality_cnn.score_quality(docs.limit(0), net).count() == 0
    alone = quality_cnn.fit(docs.limit(0), labels)
    assert quality_cnn.score(np.zeros(0, np.uint8), alone) == 0.5


def test_network_tells_words_from_one_word_repeated():
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(3, 9))))
    texts, labels = [], []
    for i in range(400):
        good = i % 5 != 0
        texts.append(" ".join(word() for _ in range(80)) if good else (word() + " ") * 80)
        labels.append(float(good))
    net = quality_cnn.train([t.encode() for t in texts[:300]], np.array(labels[:300]))
    got = [quality_cnn.score(np.frombuffer(t.encode(), np.uint8), net) >= 0.3 for t in texts[300:]]
    assert np.mean(np.array(got) == (np.array(labels[300:]) > 0)) >= 0.97


def test_network_sees_the_end_of_a_long_text():
    data = rows(300, 2)
    net = quality_cnn.train([r[1].encode() for r in data], np.array([r[2] for r in data], float), epochs=6)
    good = np.frombuffer((" ".join(r[1] for r in data if r[2])[:40_000]).encode(), np.uint8)
    bad = np.frombuffer((" ".join(r[1] for r in data if not r[2])[:4_000]).encode(), np.uint8)
    assert quality_cnn.score(np.concatenate([good, bad]), net) < quality_cnn.score(good, net)


def plain_score(text, net):
    """The network position by position: filters of 8 bytes at every second byte, overlapping chunks of 256 positions."""
    text = text + b"\0" * max(0, 8 - len(text))
    starts = list(range(0, len(text) - 7, 2))
    if starts[-1] != len(text) - 8:
        starts.append(len(text) - 8)
    rows = [np.maximum(0, net.bias + sum(net.taps[tap][text[s + tap]] for tap in range(8))) for s in starts]

    def echo(block):
        window = range(max(0, 16 * block - 32), min(len(text), 16 * block + 16))
        return max(sum(i >= lag and text[i] == text[i - lag] for i in window) / 24 for lag in range(2, 18)) ** 2

    halves = []
    for a in range(0, len(rows), 128):
        blocks = [b for b in range(a // 8, a // 8 + 16) if 16 * b < len(text)]
        halves.append(np.append(np.max(rows[a : a + 128], 0), max([echo(b) for b in blocks], default=0)))
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:])] or halves
    x = np.concatenate([np.max(chunks, 0), np.mean(chunks, 0)])
    return 1 / (1 + np.exp(-(x @ net.dense + net.offset)))


def test_scores_equal_the_plain_network_and_do_not_depend_on_segments(monkeypatch):
    data = rows(60, 3)
    net = quality_cnn.train([r[1].encode() for r in data], np.array([r[2] for r in data], float), epochs=2)
    rng = np.random.default_rng(0)
    long = rng.integers(32, 127, 9_001, dtype=np.uint8).tobytes()
    for text in (b"", b"Mentpa " * 60, b"x", b"1234567", b"12345678", b"123456789", data[0][1].encode(), long[:513], long[:520], long[:777], long):
        assert abs(quality_cnn.score(np.frombuffer(text, np.uint8), net) - plain_score(text, net)) < 1e-5
    huge = np.frombuffer((long * 240)[: (2 << 20) + 77], np.uint8)
    whole = quality_cnn.score(huge, net)
    for segment in (quality_cnn.HOP, 1024 * quality_cnn.HOP, len(huge) // quality_cnn.HOP * quality_cnn.HOP):
        monkeypatch.setattr(quality_cnn, "SEGMENT", segment)
        assert quality_cnn.score(huge, net) == whole


def test_very_long_texts(spark):
    text = "héllo wörld 12 " * 150_000
    frame = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    made = {r.doc_id: (r.n_bytes, bytes(r.payload[: r.n_bytes]).decode()) for r in media.media_columns(frame).select("doc_id", "n_bytes", "payload").collect()}
    assert made == {1: (len(text.encode()), text), 2: (5, "short")}
    coded = {r.doc_id: bytes(r.decoded).decode() for r in byte_bpe.encode_texts(frame, PATH, public_tokenizers.PATTERN).select("doc_id", "decoded").collect()}
    assert coded == {1: text, 2: "short"}
