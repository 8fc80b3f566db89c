"""MPEG audio as a media column: writing, resynchronised reading, tags, rate tables, checksums.

The writer stores bytes losslessly in a layer III stream: an ID3v2 tag, an
information frame with the table of a variable-bitrate stream (frames, bytes, 100
seek points, and the writer's delay and padding), then frames whose main data is
silent but for the stored bytes, which stand as ancillary data behind empty side
information, and an ID3v1 tag.  Every frame is protected by its CRC.  The tag keeps
the number of stored bytes and their CRC-32, which covers what the frames' own
checksums leave out.  The last frame takes the smallest rate that holds what is
left, so streams have a variable bitrate.

The reader takes any bytes.  It skips tags in front, looks for a frame header
that the next header or the end of the audio confirms, walks from frame to frame
of the same kind, and where none follows looks for the next confirmed header,
counting what it skipped.  Tags at the end are taken only where the walk comes to
them: what looks like one inside a frame is audio.  It
handles MPEG 1, 2 and 2.5, layers I to III, the two kinds of rate tables, and
checks the CRC of all protected frames.  Durations are exact, as samples over rate.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format (ISO 11172-3, 13818-3): bitrates in kbit/s by header index 1 to 14, by version and layer
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Sample rates of MPEG 1; halved for 2, quartered for 2.5
RATES = (44100, 48000, 32000)

BLOCK = 64


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2, or 25 for MPEG 2.5
    layer: int
    protected: bool
    bitrate: int
    rate: int
    channels: int
    size: int
    samples: int
    bound: int = 32  # subbands below it are coded for each channel

    @property
    def side(self) -> int:
        """Bytes of layer III side information."""
        return {(1, 2): 32, (1, 1): 17, (2, 2): 17, (2, 1): 9}[min(self.version, 2), self.channels]


@lru_cache(maxsize=4096)
def header(word: bytes) -> Header | None:
    """A frame header from its four bytes; None for free-format or reserved values and no sync."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = {0: 25, 2: 2, 3: 1}.get(word[1] >> 3 & 3), 4 - (word[1] >> 1 & 3)
    index, rate = word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3 or word[3] & 3 == 2:
        return None
    bitrate = BITRATES[min(version, 2), layer][index - 1] * 1000
    rate = RATES[rate] // {1: 1, 2: 2, 25: 4}[version]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    padding = word[2] >> 1 & 1
    size = (12 * bitrate // rate + padding) * 4 if layer == 1 else samples // 8 * bitrate // rate + padding
    bound = 4 + 4 * (word[3] >> 4 & 3) if word[3] >> 6 == 1 else 32
    return Header(version, layer, not word[1] & 1, bitrate, rate, 1 if word[3] >> 6 == 3 else 2, size, samples, bound)


def _shifted(crc: int, byte: int) -> int:
    crc ^= byte << 8
    for _ in range(8):
        crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


_CRC = [_shifted(0, byte) for byte in range(256)]


@lru_cache(maxsize=4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """CRC-16 of the format over the first bits: polynomial 0x8005, from 0xFFFF, highest bit first."""
    bits = 8 * len(data) if bits is None else bits
    crc = 0xFFFF
    for byte in data[: bits // 8]:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ byte]
    for k in range(bits % 8):
        top = (crc >> 15) ^ (data[bits // 8] >> 7 - k & 1)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def _allocation_bits(h: Header) -> list[int]:
    """Width of the bit allocation of each subband of a layer II frame."""
    # Fixed values of the format: how many subbands have how many bits
    if h.version != 1:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = h.bitrate // h.channels
    if each <= 48_000:
        return [4] * 2 + [3] * (10 if h.rate == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (4 if each <= 80_000 or h.rate == 48000 else 7)


def checked_bits(h: Header, body: bytes) -> int:
    """Bits of the body, behind the checksum, that it covers beside half the header: side information, or bit allocation and in layer II scale factor selection."""
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (min(h.bound, 32) * h.channels + 32 - min(h.bound, 32))
    at, used, value = 0, 0, int.from_bytes(body[:48].ljust(48, b"\0"), "big")
    for band, width in enumerate(_allocation_bits(h)):
        coded = h.channels if band < h.bound else 1
        for _ in range(coded):
            allocated = value >> 384 - at - width & (1 << width) - 1
            at += width
            used += (h.channels // coded) * (allocated > 0)
    return at + 2 * used


def crc_holds(data: bytes, at: int, h: Header) -> bool:
    """Whether the checksum of a protected frame is that of what it covers."""
    body = data[at + 6 : at + h.size]
    bits = checked_bits(h, body)
    return bits <= 8 * len(body) and crc16(data[at + 2 : at + 4] + body[: (bits + 7) // 8], 16 + bits) == int.from_bytes(data[at + 4 : at + 6], "big")


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _private(owner: bytes, value: bytes) -> bytes:
    body = owner + b"\0" + value
    return b"PRIV" + _syncsafe(len(body)) + b"\0\0" + body


_OWNER = b"stored-bytes"
_SIDE = bytes(17)  # mono MPEG 1: no bits of main data are used


def _word(index: int) -> bytes:
    """MPEG 1 layer III, protected, 32 kHz, mono, at bitrate index."""
    return bytes((0xFF, 0xFA, index << 4 | 2 << 2, 0xC0))


_ROOM = {index: header(_word(index)).size - 6 - len(_SIDE) for index in range(1, 15)}


def _frame(index: int, data: bytes) -> bytes:
    word = _word(index)
    return word + crc16(word[2:] + _SIDE).to_bytes(2, "big") + _SIDE + data + bytes(_ROOM[index] - len(data))


def write(payload: bytes) -> bytes:
    """The payload as an MPEG audio file."""
    most = _ROOM[14]
    frames = [_frame(14, payload[at : at + most]) for at in range(0, len(payload) - most + 1, most)]
    if (rest := len(payload) - len(frames) * most) or not frames:
        index = next(i for i in range(1, 15) if _ROOM[i] >= rest)
        frames.append(_frame(index, payload[len(payload) - rest :]))
    sizes = [len(f) for f in frames]
    info_size = len(_frame(4, b""))
    total = info_size + sum(sizes)
    ends, at = [], info_size
    for n in sizes:
        ends.append(at)
        at += n
    toc = bytes(min(255, ends[k * len(sizes) // 100] * 256 // total) for k in range(100))
    info = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    tag = _private(_OWNER, len(payload).to_bytes(8, "big") + zlib.crc32(payload).to_bytes(4, "big"))
    first = _word(4) + crc16(_word(4)[2:] + _SIDE).to_bytes(2, "big") + _SIDE
    # the table stands where main data would begin
    table = first + info + bytes(info_size - len(first) - len(info))
    return b"ID3\x04\0\0" + _syncsafe(len(tag)) + tag + table + b"".join(frames) + b"TAG" + bytes(124) + b"\xff"


@dataclass
class Stream:
    """What reading found; offsets count from the start of the bytes."""

    tags: list[str] = field(default_factory=list)
    private: dict[bytes, bytes] = field(default_factory=dict)
    table: str | None = None
    table_frames: int | None = None
    table_bytes: int | None = None
    seek_table: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    skipped: int = 0
    crc_checked: int = 0
    crc_failed: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def rate(self) -> int:
        return self.headers[0].rate if self.headers else 0

    def duration_us(self) -> int:
        """Whole microseconds; each frame by its own rate."""
        by_rate: dict[int, int] = {}
        for h in self.headers:
            by_rate[h.rate] = by_rate.get(h.rate, 0) + h.samples
        return sum(n * 1_000_000 // r for r, n in by_rate.items())

    def seek(self, sample: int) -> int | None:
        """Offset of the frame that holds a sample; None past the end."""
        for at, h in zip(self.offsets, self.headers):
            if sample < h.samples:
                return at
            sample -= h.samples
        return None


def _front_tags(data: bytes, out: Stream) -> int:
    """Start of the audio behind the tags in front."""
    start = 0
    while data[start : start + 3] == b"ID3" and len(data) >= start + 10 and all(b < 128 for b in data[start + 6 : start + 10]):
        size = sum(b << s for b, s in zip(data[start + 6 : start + 10], (21, 14, 7, 0)))
        body, major = data[start + 10 : start + 10 + size], data[start + 3]
        out.tags.append(f"id3v2.{major}")
        at = 0
        while major >= 3 and at + 10 <= len(body) and body[at : at + 4].strip(b"\0"):
            n = sum(b << s for b, s in zip(body[at + 4 : at + 8], (21, 14, 7, 0))) if major == 4 else int.from_bytes(body[at + 4 : at + 8], "big")
            if body[at : at + 4] == b"PRIV":
                owner, _, value = body[at + 10 : at + 10 + n].partition(b"\0")
                out.private[owner] = value
            at += 10 + n
        start += 10 + size + (10 if data[start + 5] & 0x10 else 0)
    return min(start, len(data))


def _end_tags(data: bytes, start: int) -> dict[int, str]:
    """What may be tags at the end: the place of each to its kind; frames may cover them."""
    end, found = len(data), {}
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        found[end] = "id3v1"
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size = int.from_bytes(data[end - 20 : end - 16], "little") + (32 if data[end - 9] & 0x80 else 0)
        if 32 <= size <= end - start and int.from_bytes(data[end - 24 : end - 20], "little") in (1000, 2000):
            found[end - size] = "ape"
    return found


def _table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Whether the frame is a rate table rather than audio; its values if so."""
    body = at + 4 + (2 if h.protected else 0) + (h.side if h.layer == 3 else 0)
    if h.layer != 3:
        return False
    for place in {body, at + 4 + h.side}:
        if data[place : place + 4] in (b"Xing", b"Info"):
            out.table = data[place : place + 4].decode().lower()
            flags, place = int.from_bytes(data[place + 4 : place + 8], "big"), place + 8
            if flags & 1:
                out.table_frames, place = int.from_bytes(data[place : place + 4], "big"), place + 4
            if flags & 2:
                out.table_bytes, place = int.from_bytes(data[place : place + 4], "big"), place + 4
            if flags & 4:
                out.seek_table = list(data[place : place + 100])
            return True
    if data[at + 36 : at + 40] == b"VBRI":
        out.table = "vbri"
        out.table_bytes, out.table_frames = int.from_bytes(data[at + 46 : at + 50], "big"), int.from_bytes(data[at + 50 : at + 54], "big")
        entries, scale, width = (int.from_bytes(data[at + k : at + k + 2], "big") for k in (54, 56, 58))
        out.seek_table = [scale * int.from_bytes(data[at + 62 + k * width : at + 62 + (k + 1) * width], "big") for k in range(entries)] if width in (1, 2, 3, 4) else []
        return True
    return False


def _confirmed(data: bytes, at: int, ends: dict[int, str]) -> Header | None:
    """A header whose frame ends where another of the same kind begins, or with the audio."""
    h = header(data[at : at + 4])
    if h is None or at + h.size > len(data):
        return None
    if at + h.size == len(data) or at + h.size in ends:
        return h
    after = header(data[at + h.size : at + h.size + 4])
    return h if after and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate) else None


def read(data: bytes | None) -> Stream:
    """All frames of a file; a null or a file without frames gives an empty stream."""
    out, data = Stream(), data or b""
    at = _front_tags(data, out)
    ends = _end_tags(data, at)
    first, last = True, None
    while at < len(data):
        h = header(data[at : at + 4])
        over_tag = h is not None and any(at < x < at + h.size for x in ends)
        if h is None or over_tag or last is None or (h.version, h.layer, h.rate) != (last.version, last.layer, last.rate):
            h = _confirmed(data, at, ends)
        if h is None or at + h.size > len(data):
            if at in ends:
                out.tags += [ends[x] for x in sorted(ends, reverse=True) if x >= at]
                break
            last = None
            following = data.find(b"\xff", at + 1)
            following = min([len(data) if following < 0 else following, *(x for x in ends if x > at)])
            out.skipped += following - at
            at = following
            continue
        last = h
        if h.protected:
            out.crc_checked += 1
            out.crc_failed += not crc_holds(data, at, h)
        if not (first and _table(data, at, h, out)):
            out.offsets.append(at)
            out.headers.append(h)
        first = False
        at += h.size
    return out


def stored(data: bytes, stream: Stream) -> bytes | None:
    """The bytes that write() stored; None if there are none or their checksum is wrong."""
    mark = stream.private.get(_OWNER)
    if mark is None or len(mark) != 12:
        return None
    parts = [data[at + 6 + h.side : at + h.size] for at, h in zip(stream.offsets, stream.headers)]
    found = b"".join(parts)
    n = int.from_bytes(mark[:8], "big")
    # only the last frame is filled up, behind what it stores
    found = found[:n]
    return found if len(found) == n and zlib.crc32(found).to_bytes(4, "big") == mark[8:] else None


def feature(stream: Stream) -> str:
    """Version, layer, rate, frames, samples, exact duration, mean bitrate, checksums, tags, table, and a digest of all seek offsets."""
    h = stream.headers[0] if stream.headers else None
    offsets = sha256(",".join(map(str, stream.offsets)).encode()).hexdigest()[:16]
    kind = f"mpeg{h.version / 10 if h.version == 25 else h.version} layer{h.layer} {h.rate}Hz {h.channels}ch" if h else "none"
    mean = sum(x.bitrate * x.samples for x in stream.headers) // max(1, stream.samples)
    return f"{kind} frames={len(stream.headers)} samples={stream.samples} us={stream.duration_us()} bitrate={mean} crc={stream.crc_checked - stream.crc_failed}/{stream.crc_checked} skipped={stream.skipped} tags={'+'.join(stream.tags)} table={stream.table}:{stream.table_frames} seek={offsets}"


def payload(text: str | None) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and these bytes filled up with 0 to a positive multiple of 64."""
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % BLOCK if data else BLOCK)


def to_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with the text's payload as an MPEG audio file; a null text is empty; a column of that name is replaced."""

    @F.pandas_udf("binary")
    def run(texts):
        return texts.map(lambda t: write(payload(t)[1]))

    return docs.withColumn(media, run(F.col(text)))


def probe(files: DataFrame, media: str = "media") -> DataFrame:
    """files with what their audio holds: duration_us, samples, rate, frames, frame_offsets, skipped, crc_checked, crc_failed, tags, table, table_frames, in a column `audio`, which replaces one of that name."""
    schema = "duration_us long, samples long, rate int, frames long, frame_offsets array<long>, skipped long, crc_checked long, crc_failed long, tags array<string>, table string, table_frames long"

    @F.pandas_udf(schema)
    def run(column):
        import pandas as pd

        found = [read(x) for x in column]
        return pd.DataFrame([(s.duration_us(), s.samples, s.rate, len(s.headers), s.offsets, s.skipped, s.crc_checked, s.crc_failed, s.tags, s.table, s.table_frames) for s in found], columns=[c.split()[0] for c in schema.split(", ")])

    return files.withColumn("audio", run(F.col(media)))


def media_digests(docs: DataFrame) -> DataFrame:
    """Each text stored as audio, read back, and both forms' digests, row by row.

    Null and empty texts store 64 zero bytes; repeated rows give repeated rows.  One
    pass: the files stay in the worker that reads them.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, data = payload(text.as_py())
                media = write(data)
                stream = read(media)
                back = stored(media, stream)
                if back is None:
                    raise ValueError("a stored payload could not be read back")
                rows.append((n, len(back), sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), sha256(media).hexdigest(), feature(stream)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds))], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
