"""Media columns: byte payloads as MPEG audio streams, and a reader for any such stream.

The writer lays a payload out in frames of MPEG-2 Layer III, mono, 16 kHz, 144 kbit/s, with checksums: every frame's side
information says that no main data are used, so a player plays silence, and 576 payload bytes travel as ancillary data. In
front are an ID3v2.3 tag and a frame at 32 kbit/s with a Xing table (frames, bytes, 100 seek points); an ID3v1 tag ends it.

The reader takes any stream of MPEG-1, 2 or 2.5, layers I to III: it steps over tags, finds the frame headers again after
foreign bytes, reads the variable-bitrate table (Xing, Info or VBRI; what of it doesn't lie within its frame is left out),
verifies the frames' checksums, and gives the exact duration in samples and every frame's offset. A header counts if another
one or the end follows its frame. Before foreign bytes it counts if the frame's checksum is right or, where there is none, if
the frame directly follows one of its kind; not if another frame begins within it, as then it's a torn one. Free format,
whose headers don't tell a size, isn't read. No bytes whatever make the reader fail.

Nulls: a null text is an empty payload, padded to one unit; equal texts give equal bytes. Streams without a frame have
duration 0. Null media give null fields. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, PAD = 576, 255
_KBIT = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}
_HEADER, _TABLE_HEADER = bytes([0xFF, 0xF2, 0xD8, 0xC0]), bytes([0xFF, 0xF2, 0x48, 0xC0])
_SIDE, _FRAME, _TABLE_FRAME = 9, 648, 144


def _crc_table() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out[i] = c
    return out


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """MPEG audio's checksum of every row of bytes."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ _CRC[(c >> np.uint16(8)) ^ rows[:, k]]
    return c


#: Layer II: bits of the allocation of each subband, by table (see _allocation_bits).
_ALLOCATION = {"a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "low": [4] * 4 + [3] * 7 + [2] * 19}


def _allocation_bits(head: dict) -> list[int]:
    if head["layer"] == 1:
        return [4] * 32
    if head["version"] != 1:
        return _ALLOCATION["low"]
    each, hertz = head["bits"] // 1000 // (1 if head["mono"] else 2), head["hertz"]
    if each <= 48:
        return _ALLOCATION["d" if hertz == 32000 else "c"]
    return _ALLOCATION["a" if hertz == 48000 or each <= 80 else "b"]


def _bitwise_right(frame: bytes, head: dict) -> bool:
    """Whether the checksum of a layer I or II frame is right: it covers the header's second half, the bit allocation and, in
    layer II, which scale factors are shared."""
    bits = int.from_bytes(frame[6:], "big")
    total = 8 * (len(frame) - 6)
    widths, at = _allocation_bits(head), 0
    channels = 1 if head["mono"] else 2
    joint = 4 * ((frame[3] >> 4 & 3) + 1) if frame[3] >> 6 == 1 else len(widths)
    used = 0
    for k, w in enumerate(widths):
        for _ in range(channels if k < joint else 1):
            if at + w > total:
                return False
            if bits >> (total - at - w) & ((1 << w) - 1):
                used += 1 if k < joint else channels
            at += w
    if head["layer"] == 2:
        at += 2 * used
    if at > total:
        return False
    c, covered = 0xFFFF, int.from_bytes(frame[2:4], "big") << at | (bits >> (total - at) if at else 0)
    for k in range(15 + at, -1, -1):
        c = (c << 1 ^ 0x8005 if (c >> 15 ^ covered >> k) & 1 else c << 1) & 0xFFFF
    return c == int.from_bytes(frame[4:6], "big")


def _checked(header: bytes) -> bytes:
    """header, its checksum over an empty side information, and that."""
    rows = np.frombuffer(header[2:] + bytes(_SIDE), np.uint8)[None]
    return header + struct.pack(">H", int(crc16(rows)[0])) + bytes(_SIDE)


_LEAD, _TABLE_LEAD = _checked(_HEADER), _checked(_TABLE_HEADER)


def parse_header(b: bytes) -> dict | None:
    """The fields of four header bytes; None if they are none (free format isn't supported)."""
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer = (25, None, 2, 1)[b[1] >> 3 & 3], 4 - (b[1] >> 1 & 3)
    kbit, rate = b[2] >> 4, b[2] >> 2 & 3
    if version is None or layer == 4 or kbit in (0, 15) or rate == 3 or b[3] & 3 == 2:
        return None
    bits, hertz, pad = _KBIT[(1 if version == 1 else 2, layer)][kbit - 1] * 1000, _RATES[version][rate], b[2] >> 1 & 1
    mono = b[3] >> 6 == 3
    if layer == 1:
        samples, size = 384, (12 * bits // hertz + pad) * 4
    else:
        samples = 576 if layer == 3 and version != 1 else 1152
        size = samples // 8 * bits // hertz + pad
    side = (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return {"version": version, "layer": layer, "bits": bits, "hertz": hertz, "samples": samples, "size": size, "mono": mono, "checked": not b[1] & 1, "side": side if layer == 3 else 0}


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text_frame(name: bytes, text: str) -> bytes:
    body = b"\0" + text.encode("latin-1")
    return name + struct.pack(">IH", len(body), 0) + body


def write_stream(payload: bytes, n_bytes: int) -> bytes:
    """The stream that stores payload, a multiple of UNIT, of which n_bytes count."""
    if len(payload) % UNIT:
        raise ValueError("the payload must be whole units")
    units = len(payload) // UNIT
    frames = np.zeros((units, _FRAME), np.uint8)
    lead = len(_LEAD)
    frames[:, :lead] = np.frombuffer(_LEAD, np.uint8)
    frames[:, lead : lead + UNIT] = np.frombuffer(payload, np.uint8).reshape(units, UNIT)
    audio = _TABLE_FRAME + units * _FRAME
    # seek points: per cent of the duration to 256ths of the bytes
    at = np.arange(100) * (units + 1) // 100
    toc = bytes(np.minimum(255, np.where(at == 0, 0, _TABLE_FRAME + (at - 1) * _FRAME) * 256 // audio).astype(np.uint8))
    table = _TABLE_LEAD + b"Xing" + struct.pack(">III", 7, units, audio) + toc
    text = _text_frame(b"TSSE", "tessarine") + _text_frame(b"TLEN", str(units * 36)) + _text_frame(b"TXXX", f"n_bytes\0{n_bytes}")
    n = len(text)
    tag = b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + text
    return b"".join((tag, table, bytes(_TABLE_FRAME - len(table)), frames.tobytes(), b"TAG" + bytes(124) + b"\xff"))


def read_stream(data: bytes) -> dict:
    """What a stream holds: tags, table, offsets and sizes of the audio frames, samples, hertz, checksums, skipped bytes."""
    at, end = 0, len(data)
    out = {"tags": {}, "table": None, "table_frame": None, "hertz": None, "samples": 0, "checks": 0, "bad_checks": 0, "skipped": 0, "bits": set()}
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        size, p = _syncsafe(data[at + 6 : at + 10]), at + 10
        major, stop = data[at + 3], min(end, at + 10 + _syncsafe(data[at + 6 : at + 10]))
        while p + 10 <= stop and data[p : p + 4].strip(b"\0") and major in (3, 4):
            n = _syncsafe(data[p + 4 : p + 8]) if major == 4 else struct.unpack(">I", data[p + 4 : p + 8])[0]
            if p + 10 + n > stop:
                break
            body = data[p + 10 : p + 10 + n]
            if data[p : p + 1] == b"T" and body[:1] == b"\0":
                out["tags"][data[p : p + 4].decode("latin-1")] = body[1:].decode("latin-1")
            p += 10 + n
        at += 10 + size + (10 if data[at + 5] & 0x10 else 0)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        out["tags"]["ID3v1"] = data[end - 125 : end - 95].split(b"\0")[0].decode("latin-1")
        end -= 128
    raw = np.frombuffer(data, np.uint8)
    offsets, sizes = [], []

    def follows(p: int) -> bool:
        return p == end or parse_header(data[p : p + 4]) is not None

    def kind(head: dict) -> tuple:
        return tuple(head[k] for k in ("version", "layer", "hertz", "mono", "checked"))

    def sums(rows: np.ndarray, head: dict) -> np.ndarray:
        """Whether the frames' checksums are right."""
        if rows.shape[1] < 6 + head["side"]:
            return np.zeros(len(rows), bool)
        if head["layer"] != 3:
            return np.array([_bitwise_right(r.tobytes(), head) for r in rows], bool)
        given = rows[:, 4].astype(np.uint16) << np.uint16(8) | rows[:, 5]
        return crc16(np.concatenate([rows[:, 2:4], rows[:, 6 : 6 + head["side"]]], axis=1)) == given

    def intact(p: int, head: dict, ahead: tuple | None) -> bool:
        """Whether the frame at p counts before foreign bytes; ahead is the kind of the frame that ends at p."""
        stop, verified = p + head["size"], head["checked"]
        if not (sums(raw[None, p:stop], head)[0] if verified else kind(head) == ahead):
            return False
        q = data.find(b"\xff", p + 1, stop)
        while q >= 0:
            inner = parse_header(data[q : q + 4])
            if inner and kind(inner) == kind(head) and q + inner["size"] <= end and (sums(raw[None, q : q + inner["size"]], inner)[0] if verified else follows(q + inner["size"])):
                return False
            q = data.find(b"\xff", q + 1, stop)
        return True

    ahead = None
    while at + 4 <= end:
        head = parse_header(data[at : at + 4])
        if head is None or at + head["size"] > end or not (follows(at + head["size"]) or intact(at, head, ahead)):
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            out["skipped"] += found - at
            at, ahead = found, None
            continue
        size = head["size"]
        # frames of the same header, as many as follow each other
        most = (end - at) // size
        rows = raw[at : at + most * size].reshape(most, size)
        same = (rows[:, :4] == rows[0, :4]).all(1)
        n = int(same.argmin()) if not same.all() else most
        if n > 1 and not follows(at + n * size) and not intact(at + (n - 1) * size, head, kind(head)):
            n -= 1
        rows = rows[:n]
        if head["checked"]:
            out["checks"] += n
            out["bad_checks"] += int((~sums(rows, head)).sum())
        first = 0
        if not offsets and out["table_frame"] is None:
            for p in (at + 4 + head["side"] + 2 * head["checked"], at + 4 + head["side"]):
                if data[p : p + 4] in (b"Xing", b"Info") and p + 8 <= at + size:
                    flags, q, table = struct.unpack(">I", data[p + 4 : p + 8])[0], p + 8, {"kind": data[p : p + 4].decode()}
                    for bit, name, wide in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100)):
                        if flags & bit and q + wide <= at + size:
                            table[name] = data[q : q + wide] if name == "toc" else struct.unpack(">I", data[q : q + 4])[0]
                            q += wide
                    out["table"], out["table_frame"], first = table, (at, size), 1
                    break
            p = at + 36  # wherever the side information ends
            if first == 0 and data[p : p + 4] == b"VBRI" and p + 26 <= at + size:
                n_bytes, frames, entries, scale, width, each = struct.unpack(">IIHHHH", data[p + 10 : p + 26])
                toc = data[p + 26 : min(p + 26 + entries * width, at + size)]
                steps = [int.from_bytes(toc[q : q + width], "big") * scale for q in range(0, len(toc), width)] if width else []
                out["table"], out["table_frame"], first = {"kind": "VBRI", "frames": frames, "bytes": n_bytes, "toc": steps, "frames_a_step": each}, (at, size), 1
        if n > first:
            offsets.append(at + np.arange(first, n, dtype=np.int64) * size)
            sizes.append(np.full(n - first, size, np.int64))
            out["hertz"] = out["hertz"] or head["hertz"]
            out["samples"] += (n - first) * head["samples"]
            out["bits"].add(head["bits"])
        at, ahead = at + n * size, kind(head)
    out["skipped"] += max(0, end - at)
    out["offsets"] = np.concatenate(offsets) if offsets else np.zeros(0, np.int64)
    out["sizes"] = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return out


def read_payload(data: bytes, found: dict) -> bytes:
    """The payload that write_stream() stored, from the frames that read_stream() found."""
    lead = len(_LEAD)
    raw = np.frombuffer(data, np.uint8)
    at = found["offsets"][found["sizes"] == _FRAME]
    if not len(at):
        return b""
    if (np.diff(at) == _FRAME).all():
        return raw[at[0] : at[0] + len(at) * _FRAME].reshape(-1, _FRAME)[:, lead : lead + UNIT].tobytes()
    return raw[at[:, None] + np.arange(lead, lead + UNIT)].tobytes()


def pad(raw: bytes) -> bytes:
    return raw + bytes([PAD]) * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def to_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id and the stream that stores its text."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                raws = [(t.as_py() or "").encode() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([write_stream(pad(r), len(r)) for r in raws], pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, media binary")


SEEK = "doc_id long, hertz int, samples long, n_frames long, bad_checks long, skipped long, table_frames long, frame_offsets array<long>"


def media_columns(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Exact duration and frame offsets of any MPEG audio streams; a null stream gives nulls."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not x.is_valid:
                    rows.append({"doc_id": i})
                    continue
                f = read_stream(x.as_py())
                rows.append({"doc_id": i, "hertz": f["hertz"], "samples": f["samples"], "n_frames": len(f["offsets"]), "bad_checks": f["bad_checks"], "skipped": f["skipped"], "table_frames": (f["table"] or {}).get("frames"), "frame_offsets": f["offsets"].tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("hertz", pa.int32()), *[(k, pa.int64()) for k in ("samples", "n_frames", "bad_checks", "skipped", "table_frames")], ("frame_offsets", pa.list_(pa.int64()))]))

    return media.select(F.col(id_col).cast("long"), F.col(media_col)).mapInArrow(run, SEEK)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(media: DataFrame) -> DataFrame:
    """The digest columns of streams made by to_media(), from the stored bytes alone."""

    def one(data: bytes) -> tuple:
        f = read_stream(data)
        payload = read_payload(data, f)
        seek = zlib.crc32(f["offsets"].astype("<i8").tobytes())
        feature = f"hertz={f['hertz']};samples={f['samples']};frames={len(f['offsets'])};table={(f['table'] or {}).get('frames')};bad_checks={f['bad_checks']};skipped={f['skipped']};seek_crc32={seek}"
        n = int(f["tags"]["TXXX"].split("\0")[1])
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches):
        for batch in batches:
            rows = [one(x.as_py()) for x in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=[x.split()[0] for x in DIGEST.split(", ")])

    return media.mapInArrow(run, DIGEST)


def op6_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    """Every text stored as an MPEG audio stream and read back."""
    return media_digests(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
