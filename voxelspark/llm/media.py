"""Media columns: files of the ISO base media format, read by walking their boxes.

``probe`` walks nested boxes down to the sample tables and gives codec, duration and the byte ranges of keyframes without touching the payload. ``samples`` reads the payload by the same tables. ``store`` writes a track of raw 8-bit samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf"}
FRAME = 192
RATE = 8000
#: Frames in a chunk, and between keyframes.
CHUNK, KEY = 16, 8


def boxes(data, start: int = 0, end: int | None = None):
    """(kind, start of content, end) of each box; sizes of 1 (64-bit) and 0 (to the end) are handled, and a size that does not fit raises ValueError."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("truncated box header")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("truncated box header")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} of {size} bytes does not fit")
        yield kind, start + head, start + size
        start += size


def tree(data, start: int = 0, end: int | None = None) -> list:
    """Nested boxes as [(kind, start of content, end, children)]."""
    return [(k, a, b, tree(data, a, b) if k in CONTAINERS else []) for k, a, b in boxes(data, start, end)]


def _find(nodes: list, *path: bytes):
    for kind, a, b, inner in nodes:
        if kind == path[0]:
            if len(path) == 1:
                yield a, b, inner
            else:
                yield from _find(inner, *path[1:])


def _table(data, at: int, kind: str, count: int) -> tuple:
    return struct.unpack_from(f">{count}{kind}", data, at)


class Track:
    """The sample tables of one track: codec, time scale, duration, and each sample's place, size, time and kind."""

    def __init__(self, data, trak: list):
        (a, _, _), = list(_find(trak, b"mdia", b"mdhd"))[:1]
        wide = data[a] == 1
        self.timescale, self.duration = struct.unpack_from(">IQ" if wide else ">II", data, a + (20 if wide else 12))
        (a, _, _), = list(_find(trak, b"mdia", b"hdlr"))[:1]
        self.handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
        stbl = next(inner for _, _, inner in _find(trak, b"mdia", b"minf", b"stbl"))
        at = {kind: a for kind, a, _, _ in stbl}
        self.codec = bytes(data[at[b"stsd"] + 12 : at[b"stsd"] + 16]).decode("latin-1")
        a = at[b"stsz"]
        fixed, count = struct.unpack_from(">II", data, a + 4)
        self.sizes = [fixed] * count if fixed else list(_table(data, a + 12, "I", count))
        large = b"co64" in at
        a = at[b"co64" if large else b"stco"]
        (chunks,) = struct.unpack_from(">I", data, a + 4)
        self.chunks = _table(data, a + 8, "Q" if large else "I", chunks)
        a = at[b"stsc"]
        (runs,) = struct.unpack_from(">I", data, a + 4)
        firsts = [_table(data, a + 8 + 12 * i, "I", 3) for i in range(runs)]
        self.offsets, starts, sample = [], [x[0] for x in firsts], 0
        for number, place in enumerate(self.chunks, 1):
            for _ in range(firsts[bisect_right(starts, number) - 1][1]):
                if sample < count:
                    self.offsets.append(place)
                    place += self.sizes[sample]
                    sample += 1
        if sample != count:
            raise ValueError("the chunks do not hold all samples")
        a = at[b"stts"]
        (runs,) = struct.unpack_from(">I", data, a + 4)
        deltas = [d for i in range(runs) for n, d in [_table(data, a + 8 + 8 * i, "I", 2)] for _ in range(n)]
        self.times = [0, *accumulate(deltas)][:count]
        if b"stss" in at:
            (n,) = struct.unpack_from(">I", data, at[b"stss"] + 4)
            self.keys = [k - 1 for k in _table(data, at[b"stss"] + 8, "I", n)]
        else:
            self.keys = list(range(count))

    def keyframes(self) -> list[tuple[int, int, int]]:
        """(time, first byte, byte after the last) of each keyframe."""
        return [(self.times[k], self.offsets[k], self.offsets[k] + self.sizes[k]) for k in self.keys]


def probe(data) -> list[Track]:
    """Tracks of a file, from its boxes alone."""
    nodes = tree(data)
    return [Track(data, inner) for _, _, inner in _find(nodes, b"moov", b"trak")]


def samples(data, track: Track) -> bytes:
    return b"".join(data[o : o + n] for o, n in zip(track.offsets, track.sizes, strict=True))


def _box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *content: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *content)


def pad(text: bytes) -> bytes:
    return text + b" " * ((-len(text) % FRAME) or (0 if text else FRAME))


def store(payload: bytes) -> bytes:
    """A file whose one track holds ``payload``, of a positive multiple of 192 bytes, as frames of raw unsigned 8-bit samples."""
    frames = len(payload) // FRAME
    if not frames or frames * FRAME != len(payload):
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    chunks = -(-frames // CHUNK)
    last = frames - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)] * (chunks == 1 or last != CHUNK)
    keys = range(1, frames + 1, KEY)
    long = 1 if len(payload) >= 1 << 32 else 0
    time = lambda: struct.pack(">QQIQ", 0, 0, RATE, len(payload)) if long else struct.pack(">IIII", 0, 0, RATE, len(payload))
    mvhd = _full(b"mvhd", time(), struct.pack(">IH10x", 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2), version=long)
    span = struct.pack(">QQIIQ", 0, 0, 1, 0, len(payload)) if long else struct.pack(">IIIII", 0, 0, 1, 0, len(payload))
    tkhd = _full(b"tkhd", span, struct.pack(">8xHHHH", 0, 0, 0x100, 0), matrix, bytes(8), version=long, flags=3)
    mdhd = _full(b"mdhd", time(), struct.pack(">HH", 0x55C4, 0), version=long)
    hdlr = _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"bytes\0")
    entry = _box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    stsd = _full(b"stsd", struct.pack(">I", 1), entry)
    stts = _full(b"stts", struct.pack(">III", 1, frames, FRAME))
    stss = _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys))
    stsc = _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs))
    stsz = _full(b"stsz", struct.pack(">II", FRAME, frames))

    def moov(base: int, large: bool) -> bytes:
        places = [base + i * CHUNK * FRAME for i in range(chunks)]
        stco = _full(b"co64" if large else b"stco", struct.pack(f">I{chunks}{'Q' if large else 'I'}", chunks, *places))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), _box(b"stbl", stsd, stts, stss, stsc, stsz, stco))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"iso2")
    large = len(payload) >= (1 << 32) - (1 << 24)
    head = len(ftyp) + len(moov(0, large)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return ftyp + moov(head, large) + _box(b"mdat", payload)


def feature(track: Track) -> str:
    """Codec, duration and keyframes of a track in one line: the number of keyframes, a checksum over their times and byte ranges, and all byte ranges."""
    keys = track.keyframes()
    check = zlib.crc32(b"".join(struct.pack("<QQQ", *k) for k in keys))
    shown = ",".join(f"{a}-{b}" for _, a, b in keys)
    return f"{track.handler}/{track.codec} scale={track.timescale} duration={track.duration} samples={len(track.sizes)} keyframes={len(keys)} crc={check} ranges={shown}"


_KEYFRAME = pa.struct([("time", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])
_TRACK = [("codec", pa.string()), ("duration", pa.int64()), ("keyframes", pa.list_(_KEYFRAME))]
_TRACK_DDL = "codec string, duration long, keyframes array<struct<time: bigint, begin: bigint, end: bigint>>"


def _track(track: Track) -> tuple:
    return track.codec, track.duration, [{"time": t, "begin": a, "end": b} for t, a, b in track.keyframes()]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def media_tracks(files: DataFrame, media: str = "media", doc_id: str = "doc_id") -> DataFrame:
    """A row for each track of each file in the binary column ``media``: the file's id, the track's number from 0, codec, duration and the time and byte range of every keyframe. Null files have no rows; a file that is no media file raises ValueError."""

    def run(batches):
        for part in slices(batches, column="media"):
            rows = [(i, k, *_track(t)) for i, data in zip(part.column("i").to_pylist(), part.column("media").to_pylist(), strict=True) if data is not None for k, t in enumerate(probe(data))]
            if rows:
                yield _batch(rows, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("track", pa.int64()), *_TRACK])
    return files.selectExpr(f"cast(`{doc_id}` as long) as i", f"`{media}` as media").mapInArrow(run, f"doc_id long, track long, {_TRACK_DDL}")


def media_columns(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each row of ``docs``: its id, the digests of its text stored as media and read back, and the track's codec, duration and keyframes (time, begin, end).

    Null and empty texts become one frame of spaces. Equal texts give equal values; repeated rows give repeated rows; an empty table gives an empty result; other columns are left out, and null ids stay null.
    """

    def run(batches):
        for part in slices(batches):
            rows = []
            for i, value in zip(part.column("i").to_pylist(), part.column("text").to_pylist(), strict=True):
                raw = (value or "").encode("utf-8", "surrogatepass")
                stored = store(pad(raw))
                (track,) = probe(stored)
                back = samples(stored, track)
                rows.append((i, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(track), *_track(track)))
            yield _batch(rows, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), *_TRACK])
    ddl = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, {_TRACK_DDL}"
    return docs.selectExpr(f"`{doc_id}` as i", f"`{text}` as text").mapInArrow(run, ddl)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
