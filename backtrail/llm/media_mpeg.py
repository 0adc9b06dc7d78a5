"""MPEG audio columns: a writer that keeps any payload losslessly, and a parser for MPEG 1/2/2.5, layers I to III.

Written streams are valid MPEG-1 layer III, mono, 32 kHz: an ID3v2.3 tag with the payload's length, a frame with a Xing
header (frame and byte counts, seek table), then frames with a CRC whose side information says that no bits belong to
the audio, so each decodes to silence and the rest of the frame is ancillary data, which carries the payload. A last frame
carries none, so that no payload is taken for a tag at the end.

The parser reads ID3v2, APE and ID3v1 tags, finds the first header that is followed by a consistent one, resynchronises
after damage, reads Xing/Info tables (with the encoder's delay and padding, if it names them) and VBRI tables with their
seek points, verifies the CRC-16 of all three layers where a frame has one, and gives the exact duration (samples over rate,
a fraction) with and without what the encoder put in, and the byte offset of each frame as a seek table.

Defined results: a null payload counts as empty; empty or unreadable media have no frames, duration 0 and no payload;
equal texts give equal streams; repeated rows stay repeated, and rows with a null key stay; other columns aren't looked at,
whatever their names; an empty table gives no rows. Of tags with one name the last counts, ID3v2 before ID3v1.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame

from backtrail.llm.common import map_rows

#: Fixed values of the MPEG audio formats (ISO 11172-3, ISO 13818-3): kbit/s by index 1 to 14.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}
VERSION = {0: 25, 2: 2, 3: 1}
LAYER = {1: 3, 2: 2, 3: 1}
CRC_POLYNOMIAL = 0x8005

UNIT = 64  # payloads are padded to a positive multiple of this many bytes
HEAD = 4 + 2 + 17  # header, CRC and side information of a mono MPEG-1 layer III frame


@dataclass(frozen=True)
class Frame:
    version: int
    layer: int
    crc: bool
    kbps: int
    rate: int
    padding: int
    mono: bool
    size: int
    samples: int
    bound: int = 32  # the first subband that both channels share, layers I and II

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


@lru_cache(maxsize=4096)
def frame_header(four: bytes) -> Frame | None:
    """The meaning of four bytes as a frame header; None if they aren't one, or give no fixed size."""
    h = int.from_bytes(four, "big")
    if len(four) < 4 or h >> 21 != 0x7FF:
        return None
    version, layer = VERSION.get(h >> 19 & 3), LAYER.get(h >> 17 & 3)
    index, rate_index = h >> 12 & 15, h >> 10 & 3
    if not version or not layer or index in (0, 15) or rate_index == 3 or h & 3 == 2:
        return None
    family = 1 if version == 1 else 2
    kbps = BITRATES[family, layer if family == 1 or layer == 1 else 2][index - 1]
    rate, padding, mono = RATES[version][rate_index], h >> 9 & 1, h >> 6 & 3 == 3
    if layer == 1:
        samples, size = 384, (12 * kbps * 1000 // rate + padding) * 4
    else:
        samples = 576 if layer == 3 and family == 2 else 1152
        size = samples // 8 * kbps * 1000 // rate + padding
    bound = 4 * ((h >> 4 & 3) + 1) if h >> 6 & 3 == 1 else 32
    return Frame(version, layer, not h >> 16 & 1, kbps, rate, padding, mono, size, samples, bound)


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = c << 1 ^ (CRC_POLYNOMIAL if c & 0x8000 else 0)
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


#: Fixed values of layer II: bits of a subband's allocation, as (bits, subbands) runs; ISO 11172-3 tables B.2a to B.2d, 13818-3 B.1.
ALLOCATION = {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "low": ((4, 4), (3, 7), (2, 19))}


def allocation_bits(f: Frame) -> list[int]:
    """Bits of each subband's allocation in a frame of layer I or II."""
    if f.layer == 1:
        return [4] * 32
    each = f.kbps if f.mono else f.kbps // 2
    if f.version != 1:
        table = "low"
    elif each <= 48:
        table = "d" if f.rate == 32000 else "c"
    else:
        table = "a" if f.rate == 48000 or each <= 80 else "b"
    return [bits for bits, n in ALLOCATION[table] for _ in range(n)]


def protected(body: bytes, f: Frame) -> tuple[int, int]:
    """(bits, how many) that a frame's CRC covers: the header's last 16, then layer III's side information, layer I's
    allocations, or layer II's allocations and scale factor selections."""
    head = int.from_bytes(body[2:4], "big")
    if f.layer == 3:
        return head << 8 * f.side | int.from_bytes(body[6 : 6 + f.side], "big"), 16 + 8 * f.side
    data, at = int.from_bytes(body[6:150].ljust(144, b"\0"), "big"), 0

    def take(n: int) -> int:
        nonlocal at
        at += n
        return data >> 144 * 8 - at & (1 << n) - 1

    used = 0  # channels and subbands with an allocation
    for i, n in enumerate(allocation_bits(f)):
        if f.mono:
            used += take(n) > 0
        elif i < f.bound:
            used += (take(n) > 0) + (take(n) > 0)
        else:
            used += 2 * (take(n) > 0)
    at += 2 * used if f.layer == 2 else 0
    return head << at | data >> 144 * 8 - at, 16 + at


def crc_right(body: bytes, f: Frame) -> bool:
    """Whether the CRC of a frame that has one is right."""
    bits, n = protected(body, f)
    whole = n // 8
    c = crc16((bits >> n - 8 * whole).to_bytes(whole, "big"))
    for i in range(n - 8 * whole - 1, -1, -1):
        c = (c << 1 ^ (CRC_POLYNOMIAL if (c >> 15 ^ bits >> i) & 1 else 0)) & 0xFFFF
    return c == int.from_bytes(body[4:6], "big")


@lru_cache(maxsize=4096)
def _sound(start: bytes) -> bool:
    """crc_right() of a layer III frame with 17 bytes of side information, by its start; written frames have few."""
    return crc16(start[2:4] + start[6:HEAD]) == int.from_bytes(start[4:6], "big")


@lru_cache(maxsize=64)
def _frame_start(index: int) -> bytes:
    """Header, CRC and empty side information of a written frame with a bit rate's index (1 to 14)."""
    header = (0x7FF << 21 | 3 << 19 | 1 << 17 | index << 12 | 2 << 10 | 3 << 6).to_bytes(4, "big")
    side = bytes(17)
    return header + crc16(header[2:] + side).to_bytes(2, "big") + side


#: Bytes of a written frame by bit rate index: 144 * bit rate / 32000 is a whole number for each.
SIZES = [144 * kbps // 32 for kbps in BITRATES[1, 3]]
_ROOM = [s - HEAD for s in SIZES]


def padded(payload: bytes) -> bytes:
    return payload + bytes(UNIT - len(payload) % UNIT if len(payload) % UNIT or not payload else 0)


def write(payload: bytes) -> bytes:
    """A stream whose frames carry the payload, in order and unchanged."""
    frames, at = [], 0
    while at < len(payload):
        left = len(payload) - at
        i = next((i for i, room in enumerate(_ROOM) if room >= left), len(_ROOM) - 1)
        body = payload[at : at + _ROOM[i]]
        frames.append(_frame_start(i + 1) + body.ljust(_ROOM[i], b"\0"))
        at += len(body)
    frames.append(_frame_start(1).ljust(SIZES[0], b"\0"))  # without payload, where read_tags() looks for tags at the end
    body = b"".join(frames)
    total = SIZES[4] + len(body)
    ends, at = [], SIZES[4]
    for f in frames:
        ends.append(at)
        at += len(f)
    seek = bytes(min(255, ends[len(ends) * i // 100] * 256 // total) if ends else 0 for i in range(100))
    xing = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + seek
    first = (_frame_start(5) + xing).ljust(SIZES[4], b"\0")
    text = b"\0payload\0" + str(len(payload)).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    size = bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0))
    return b"ID3\x03\0\0" + size + tag + first + body


@dataclass
class Stream:
    frames: list[tuple[int, Frame]] = field(default_factory=list)
    resyncs: int = 0
    crc_checked: int = 0
    crc_wrong: int = 0
    vbr: dict | None = None
    tags: dict[str, str] = field(default_factory=dict)

    @property
    def samples(self) -> int:
        return sum(f.samples for _, f in self.frames)

    @property
    def duration(self) -> tuple[int, int]:
        """Seconds as (numerator, denominator); frames of several rates are added exactly."""
        from fractions import Fraction

        total = sum((Fraction(n, r) for r, n in _samples_by_rate(self.frames).items()), Fraction(0))
        return total.numerator, total.denominator


def played(s: Stream) -> tuple[int, int]:
    """Seconds as (numerator, denominator) without the encoder's delay and padding, as far as the stream's table names them."""
    from fractions import Fraction

    n, d = s.duration
    if not s.vbr or not s.frames or "delay" not in s.vbr:
        return n, d
    left = max(Fraction(0), Fraction(n, d) - Fraction(s.vbr["delay"] + s.vbr["padding"], s.frames[0][1].rate))
    return left.numerator, left.denominator


def _samples_by_rate(frames) -> dict[int, int]:
    out: dict[int, int] = {}
    for _, f in frames:
        out[f.rate] = out.get(f.rate, 0) + f.samples
    return out


def read_tags(data: bytes) -> tuple[int, int, dict[str, str]]:
    """(where the audio begins, where it ends, the tags found)."""
    start, end, tags = 0, len(data), {}
    while data[start : start + 3] == b"ID3" and len(data) >= start + 10:
        size = 0
        for b in data[start + 6 : start + 10]:
            size = size << 7 | b & 127
        major, at, stop = data[start + 3], start + 10, min(len(data), start + 10 + size)
        while major in (3, 4) and at + 10 <= stop and data[at : at + 1].isalnum():
            name, raw = data[at : at + 4].decode("latin-1"), data[at + 4 : at + 8]
            n = int.from_bytes(raw, "big") if major == 3 else raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]
            value = data[at + 10 : min(stop, at + 10 + n)]
            if name[0] == "T" and value:
                text = value[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1"), "replace").rstrip("\0")
                key, _, rest = text.partition("\0")
                tags[f"TXXX:{key}" if name == "TXXX" else name] = rest if name == "TXXX" else text
            at += 10 + n
        start = start + 10 + size + (10 if data[start + 5] & 16 else 0)
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags.setdefault("TIT2", data[end + 3 : end + 33].decode("latin-1").rstrip("\0 "))
    if end - start >= 32:
        end, found = read_ape(data, end)
        tags = found | tags
    return min(start, len(data)), max(min(end, len(data)), min(start, len(data))), tags


def read_vbr(body: bytes, f: Frame) -> dict | None:
    """The Xing, Info or VBRI table in a layer III frame, if it has one. seek: of Xing 100 places in 256ths of the stream, of
    VBRI the bytes before each point, which are so many frames (every) apart."""
    at = 4 + 2 * f.crc + f.side
    kind = body[at : at + 4]
    number = lambda i, n: int.from_bytes(body[i : i + n], "big")
    if kind in (b"Xing", b"Info"):
        flags, at, out = number(at + 4, 4), at + 8, {"kind": kind.decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = number(at, 4)
                at += 4
        if flags & 4:
            out["seek"] = list(body[at : at + 100])
            at += 100
        at += 4 if flags & 8 else 0
        if body[at : at + 4] in (b"LAME", b"Lavf", b"Lavc") and len(body) >= at + 24:
            both = number(at + 21, 3)
            out |= {"encoder": body[at : at + 9].decode("latin-1").rstrip("\0 "), "delay": both >> 12, "padding": both & 0xFFF}
        return out
    if body[36:40] == b"VBRI":
        entries, scale, width, every = (number(54 + 2 * i, 2) for i in range(4))
        sizes = [number(62 + i * width, width) * scale for i in range(entries) if 62 + (i + 1) * width <= len(body)]
        return {"kind": "VBRI", "delay": number(42, 2), "padding": 0, "bytes": number(46, 4), "frames": number(50, 4), "every": every, "seek": [sum(sizes[:i]) for i in range(len(sizes))]}
    return None


def read_ape(data: bytes, end: int) -> tuple[int, dict[str, str]]:
    """(where an APE tag that ends at end begins, its texts); end itself if there is none."""
    if end < 32 or data[end - 32 : end - 24] != b"APETAGEX":
        return end, {}
    little = lambda i: int.from_bytes(data[i : i + 4], "little")
    size, count, flags = little(end - 20), little(end - 16), little(end - 12)
    at, stop, out = max(0, end - size), end - 32, {}
    begin = max(0, at - (32 if flags >> 31 else 0))
    for _ in range(count):
        n, kind, key_end = little(at), little(at + 4), data.find(b"\0", at + 8, stop)
        if key_end < 0 or key_end + 1 + n > stop:
            break
        if kind >> 1 & 3 == 0:
            out["APE:" + data[at + 8 : key_end].decode("latin-1")] = data[key_end + 1 : key_end + 1 + n].decode("utf-8", "replace")
        at = key_end + 1 + n
    return begin, out


def parse(data: bytes) -> Stream:
    """Frames with their offsets, and what the tags and tables say. A header counts at the first place, and after
    damage, only if another header of the same version, layer and rate follows its frame, or the stream ends there."""
    at, end, tags = read_tags(data)
    out = Stream(tags=tags)
    synced, first = False, True
    while at + 4 <= end:
        f = frame_header(data[at : at + 4])
        if f and at + f.size <= end and not synced and at + f.size + 4 <= end:
            g = frame_header(data[at + f.size : at + f.size + 4])
            if not g or (g.version, g.layer, g.rate) != (f.version, f.layer, f.rate):
                f = None
        if not f or at + f.size > end:
            if synced:
                out.resyncs += 1
                synced = False
            at = data.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        synced = True
        if f.crc:
            out.crc_checked += 1
            out.crc_wrong += not (_sound(data[at : at + HEAD]) if f.layer == 3 and f.side == 17 else crc_right(data[at : at + f.size], f))
        vbr = read_vbr(data[at : at + f.size], f) if first and f.layer == 3 else None
        first = False
        if vbr:
            out.vbr = vbr  # the table's frame isn't sound
        else:
            out.frames.append((at, f))
        at += f.size
    return out


def payload_of(data: bytes, stream: Stream) -> bytes:
    """What a written stream carries: the ancillary data of its frames, as long as its tag says."""
    size = stream.tags.get("TXXX:payload", "0")
    body = b"".join(data[at + HEAD : at + f.size] for at, f in stream.frames)
    return body[: int(size) if size.isdigit() else 0]


def store(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media binary): the UTF-8 bytes of every text, padded, as an MPEG stream."""

    def f(keys, texts):
        raw = [(t or "").encode() for t in texts]
        return keys, [len(x) for x in raw], [write(padded(x)) for x in raw]

    return map_rows(df, [key, text], f"{key} bigint, n_bytes bigint, media binary", lambda: f)


def features(s: Stream) -> str:
    """Counts, exact duration and the seek offsets' digest of a stream, as text."""
    n, d = s.duration
    rates = sorted({f.kbps for _, f in s.frames})
    offsets = zlib.crc32(",".join(str(at) for at, _ in s.frames).encode())
    return (
        f"frames={len(s.frames)};samples={s.samples};duration={n}/{d};kbps={rates[0] if rates else 0}-{rates[-1] if rates else 0};"
        f"crc={s.crc_checked - s.crc_wrong}/{s.crc_checked};resyncs={s.resyncs};table={s.vbr.get('frames') if s.vbr else None};offsets={offsets:08x}"
    )


def inspect(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """(key, frames, samples, seconds_num, seconds_den, played_num, played_den, resyncs, crc_checked, crc_wrong, offsets, tags,
    seek) of a media column: counts, exact durations, the byte offset of each frame, tags, and the seek table that the
    stream itself brings along."""

    def f(keys, values):
        parsed = [parse(bytes(x or b"")) for x in values]
        times, heard = [s.duration for s in parsed], [played(s) for s in parsed]
        return (
            keys, [len(s.frames) for s in parsed], [s.samples for s in parsed], [t[0] for t in times], [t[1] for t in times], [t[0] for t in heard], [t[1] for t in heard],
            [s.resyncs for s in parsed], [s.crc_checked for s in parsed], [s.crc_wrong for s in parsed], [[at for at, _ in s.frames] for s in parsed], [list(s.tags.items()) for s in parsed], [(s.vbr or {}).get("seek") for s in parsed],
        )

    schema = f"{key} bigint, frames int, samples bigint, seconds_num bigint, seconds_den bigint, played_num bigint, played_den bigint, resyncs int, crc_checked int, crc_wrong int, offsets array<bigint>, tags map<string,string>, seek array<bigint>"
    return map_rows(df, [key, media], schema, lambda: f)


def digests(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read stored media back: payload and media digests, and features; df is what store() returns."""

    def f(keys, sizes, values):
        out = [[] for _ in range(6)]
        for x in values:
            s = parse(x)
            payload = payload_of(x, s)
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(x), hashlib.sha256(x).hexdigest(), features(s))
            for o, v in zip(out, row, strict=True):
                o.append(v)
        return keys, sizes, *out

    schema = f"{key} bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_rows(df, [key, "n_bytes", "media"], schema, lambda: f)
