"""MPEG audio round trips, and near-duplicate components against brute force."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest

from tessarine.llm import minhash, mpeg_audio


def test_round_trip(docs, none, texts_list):
    rows = {r.doc_id: r for r in mpeg_audio.media_digests(mpeg_audio.to_media(docs)).collect()}
    assert sorted(rows) == list(range(len(texts_list)))
    for i, t in enumerate(texts_list):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stream = mpeg_audio.write_stream(payload, len(raw))
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest())
        n = len(payload) // 576
        assert f"samples={n * 576};frames={n};table={n};bad_checks=0;skipped=0" in r.feature
    assert mpeg_audio.media_digests(mpeg_audio.to_media(none)).count() == 0


def test_reader_resynchronises_and_verifies():
    payload = bytes(random.Random(2).randrange(256) for _ in range(576 * 9))
    stream = mpeg_audio.write_stream(payload, len(payload))
    whole = mpeg_audio.read_stream(stream)
    assert mpeg_audio.read_payload(stream, whole) == payload
    assert len(whole["table"]["toc"]) == 100 and whole["tags"]["TLEN"] == str(9 * 36)
    cut = int(whole["offsets"][4])
    hurt = stream[:cut] + b"\xff\xf2junk\xff\xffjunk" + stream[cut:]
    got = mpeg_audio.read_stream(hurt)
    assert got["skipped"] == 12 and len(got["offsets"]) == 9 and mpeg_audio.read_payload(hurt, got) == payload
    flipped = bytearray(stream)
    flipped[cut + 8] ^= 1  # side information
    assert mpeg_audio.read_stream(bytes(flipped))["bad_checks"] == 1
    gone = stream[:cut] + stream[cut + 648 * 2 :]
    assert len(mpeg_audio.read_stream(gone)["offsets"]) == 7
    assert mpeg_audio.read_stream(b"")["samples"] == 0 and mpeg_audio.read_stream(b"no audio \xff\xfb here")["samples"] == 0


def test_reader_keeps_the_frame_before_foreign_bytes():
    payload = bytes(random.Random(3).randrange(256) for _ in range(576 * 9))
    stream = mpeg_audio.write_stream(payload, len(payload))
    cut, last = (int(mpeg_audio.read_stream(stream)["offsets"][k]) for k in (4, 8))
    tag = b"APETAGEX" + bytes(24)
    for hurt, skipped in [(stream[:cut] + tag + stream[cut:], 32), (stream[: last + 648] + tag + stream[last + 648 :], 32), (stream[:-128] + tag, 32)]:
        got = mpeg_audio.read_stream(hurt)
        assert got["skipped"] == skipped and len(got["offsets"]) == 9 and mpeg_audio.read_payload(hurt, got) == payload
    two = stream + stream  # a tag of 128 bytes, one in front and a table frame of 144 between
    got = mpeg_audio.read_stream(two)
    assert (got["sizes"] == 648).sum() == 18 and mpeg_audio.read_payload(two, got) == payload * 2
    # torn: the frame is lost, the one that begins within it is not
    torn = stream[: cut + 300] + stream[cut + 648 :]
    assert mpeg_audio.read_payload(torn, mpeg_audio.read_stream(torn)) == payload[: 576 * 4] + payload[576 * 5 :]
    plain = bytes.fromhex("fffb9064") + bytes(413)
    other = bytes.fromhex("fffba064") + bytes(518)
    for frames, n in [(plain * 5, 5), (plain * 4 + other, 5)]:
        got = mpeg_audio.read_stream(frames + tag)
        assert (len(got["offsets"]), got["samples"], got["skipped"]) == (n, n * 1152, 32)
    got = mpeg_audio.read_stream(plain * 3 + plain[:200] + plain * 3 + tag)
    assert got["offsets"].tolist() == [0, 417, 834, 1451, 1868, 2285]
    assert len(mpeg_audio.read_stream(b"junk" + plain + b"junk")["offsets"]) == 0  # no evidence


def test_reader_reads_vbri():
    plain = bytes.fromhex("fffb9064") + bytes(413)
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 2085, 4, 2, 3, 2, 2) + struct.pack(">HH", 278, 279)
    got = mpeg_audio.read_stream(plain[:36] + table + plain[36 + len(table) :] + plain * 4)
    assert got["table"] == {"kind": "VBRI", "frames": 4, "bytes": 2085, "toc": [834, 837], "frames_a_step": 2}
    assert got["table_frame"] == (0, 417) and got["offsets"].tolist() == [417, 834, 1251, 1668] and got["samples"] == 4 * 1152


def test_tables_stay_within_their_frame():
    short = bytes.fromhex("fff314c0")  # MPEG-2, 8 kbit/s, 24 kHz, mono: 24 bytes
    frame = short + bytes(9) + b"Xing" + struct.pack(">I", 7)[:7]
    got = mpeg_audio.read_stream(frame[:24] + short + bytes(20) + short + bytes(20))
    assert got["table"] is None or "toc" not in got["table"]
    tight = short + bytes(9) + b"Xing" + struct.pack(">I", 1)
    got = mpeg_audio.read_stream((tight + bytes(24))[:24] + (short + bytes(20)) * 2)
    assert got["samples"] in (2 * 576, 3 * 576)


def test_no_bytes_make_the_reader_fail():
    r = random.Random(11)
    stream = mpeg_audio.write_stream(bytes(range(256)) * 9, 2304)
    heads = [bytes([0xFF, r.randrange(0xE0, 256), r.randrange(256), r.randrange(256)]) for _ in range(200)]
    for k in range(400):
        if k % 2:
            hurt = bytearray(stream)
            for _ in range(r.randint(1, 30)):
                hurt[r.randrange(len(hurt))] = r.choice([0, 255, 0xF2, r.randrange(256)])
            data = bytes(hurt[r.randrange(300) : len(hurt) - r.randrange(300)])
        else:
            data = b"".join(r.choice(heads) + bytes(r.randrange(256) for _ in range(r.choice([0, 20, 32, 100]))) + r.choice([b"", b"Xing\0\0\0\7", b"Info\0\0\0\1", b"VBRI", b"ID3\3\0\0\0\0\1\1TXXX"]) for _ in range(30))
        got = mpeg_audio.read_stream(data)
        assert got["samples"] >= 0 and 0 <= got["bad_checks"] <= got["checks"] and got["skipped"] <= len(data)
        assert all(0 <= a and a + b <= len(data) for a, b in zip(got["offsets"], got["sizes"], strict=True))


@pytest.mark.parametrize("head,allocation", [("fffe90c0", 16), ("fffe9000", 32), ("fffe9060", 22), ("fffc90c0", None), ("fffc9000", None), ("fff490c0", None)])
def test_checksums_of_layers_one_and_two(head, allocation):
    header = bytes.fromhex(head)
    info = mpeg_audio.parse_header(header)
    r = random.Random(7)
    body = bytes(r.randrange(256) for _ in range(info["size"] - 6))
    if allocation:  # whole bytes in layer I
        want = int(mpeg_audio.crc16(np.frombuffer(header[2:] + body[:allocation], np.uint8)[None])[0])
    else:
        want = next(c for c in range(65536) if mpeg_audio._bitwise_right(header + struct.pack(">H", c) + body, info))
    frame = header + struct.pack(">H", want) + body
    got = mpeg_audio.read_stream(frame * 3)
    assert (got["checks"], got["bad_checks"], len(got["offsets"])) == (3, 0, 3)
    hurt = bytearray(frame * 3)
    hurt[info["size"] + 6] ^= 0x10
    assert mpeg_audio.read_stream(bytes(hurt))["bad_checks"] == 1


@pytest.mark.parametrize("head,size,samples", [("fffb9064", 417, 1152), ("fffb9264", 418, 1152), ("fffd9064", 522, 1152), ("ffff9064", 312, 384), ("ffe35064", 144 * 40000 // 11025 // 2, 576)])
def test_headers(head, size, samples):
    got = mpeg_audio.parse_header(bytes.fromhex(head))
    assert (got["size"], got["samples"]) == (size, samples)


def test_media_columns(spark):
    payload = b"x" * 576 * 3
    rows = [(1, mpeg_audio.write_stream(payload, 5)), (2, None), (3, b"")]
    got = {r.doc_id: r for r in mpeg_audio.media_columns(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1].samples == 1728 and len(got[1].frame_offsets) == 3 and got[2].samples is None and got[3].samples == 0


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_sets(rows, k):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        out.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    return out


def brute_components(sets, share=80):
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= share * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i, _ in sets}


def test_sets_are_those_of_brute_force(texts_list):
    import pyarrow as pa

    for k in (1, 4, 5):
        got = [len(s) for _, s in minhash._sets(pa.array([*texts_list, " a  B c D e\x0b", "a b c d E "]), k)]
        assert got == [len(s) for _, s in brute_sets(enumerate([*texts_list, " a  B c D e\x0b", "a b c d E "]), k)]


def near_texts():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 6)))
    out = []
    for g in range(12):
        w = [word() for _ in range(r.choice([3, 12, 40, 90, 200]))]
        out.append(" ".join(w))
        for _ in range(r.choice([1, 3, 25])):
            v = list(w)
            for _ in range(r.randint(0, max(1, len(w) // 30))):
                v[r.randrange(len(v))] = word()
            out.append(" ".join(v) + (" " if r.random() < 0.3 else ""))
            if r.random() < 0.4:
                w = v  # chains
    out += [out[3].upper(), None, "", " \n", out[0], out[0]]
    r.shuffle(out)
    return out


def test_components(spark, none):
    rows = list(enumerate(near_texts()))
    want = brute_components(brute_sets(rows, 4))
    sizes = {i: len(s) for i, s in brute_sets(rows, 4)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = minhash.keep_one_each(df.selectExpr("*", "'x' as label", "1 as a"))
    assert kept.columns == ["doc_id", "text", "label", "a"] and {r.doc_id for r in kept.collect()} == set(want.values())
    assert minhash.near_duplicates(none).count() == 0


def test_one_row_of_a_group_stays_whatever_its_id(spark):
    r = random.Random(12)
    a, b, c, d = (" ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(60)) for _ in range(4))
    near = a + " tail"
    rows = [(5, a), (5, a), (5, near), (7, near), (3, b), (3, c), (2, b), (None, d), (None, d), (None, d + " x"), (8, d), (None, c), (None, None), (None, None), (4, ""), (4, ""), (6, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string").repartition(3)
    kept = minhash.keep_one_each(df)
    assert kept.columns == ["doc_id", "text", "label"]
    got = [(x.doc_id, x.text) for x in kept.collect()]
    fives = [x for x in got if x[0] == 5]
    assert len(fives) == 1 and fives[0][1] in (a, near)
    nulls = [x for x in got if x[0] is None and (x[1] or "").startswith(d)]
    assert len(nulls) == 1
    rest = [x for x in got if x not in fives + nulls]
    assert sorted(rest, key=str) == sorted([(2, b), (None, c), (None, None), (4, ""), (6, "")], key=str)


def test_components_of_a_chain(spark):
    from tessarine.operators.cluster import components

    links = [(i, i + 1) for i in range(0, 60)] + [(200, 100), (100, 200), (7, 7), (300, 299), (299, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 299: 299, 300: 299, 301: 299}


def test_keys_meet_as_often_as_the_formula_says():
    r = np.random.default_rng(4)
    a, b = minhash._coefficients(2 * minhash.SLOTS * minhash.ROWS)
    hits = []
    for _ in range(200):
        common, own = r.integers(0, 2**63, 320, np.uint64), r.integers(0, 2**63, (2, 40), np.uint64)
        x, y = (minhash.slot_keys(np.concatenate([common, o]), a, b, minhash.ROWS) for o in own)
        hits.append((x == y).mean())
    assert abs(np.mean(hits) - 0.8**3) < 0.03


def test_a_family_below_the_limit_is_not_compared_pair_by_pair(spark, monkeypatch):
    r = random.Random(21)
    word = lambda n=5: "".join(r.choice("abcdefghijklm") for _ in range(n))
    template = " ".join(word() for _ in range(200))
    rows = [(i, template + " " + " ".join(word(6) for _ in range(70))) for i in range(300)]
    # among them groups that do link, also across the buckets' leaders
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(0, 60, 3)] + [(2000 + i, rows[i][1] + " " + word()) for i in range(0, 30, 3)]
    pairs = []
    verified = minhash._verified

    def counting(p, *more):
        pairs.append(p.count())
        return verified(p, *more)

    monkeypatch.setattr(minhash, "_verified", counting)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(brute_sets(rows, 4))
    assert sum(pairs) < 30 * len(rows)  # of 54,000 pairs


def test_long_texts_are_read_in_steps():
    import pyarrow as pa

    from tessarine.llm.common import span_hashes

    r = np.random.default_rng(3)
    data = r.integers(0, 256, 500).astype(np.uint8)
    cuts = np.unique(r.integers(0, 500, 40))
    starts, ends = cuts[:-1], np.maximum(cuts[:-1] + 1, cuts[1:] - 1)
    whole = span_hashes(data, starts, ends, minhash._BYTES, minhash._BASE)
    for step in (1, 7, 64):
        assert (span_hashes(data, starts, ends, minhash._BYTES, minhash._BASE, step) == whole).all()
    import resource

    text = " ".join(f"w{i}" for i in range(2_000_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ((_, s),) = minhash._sets(pa.array([text]), 4)
    assert len(s) == 2_000_000 - 3
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 < 15 * len(text)
