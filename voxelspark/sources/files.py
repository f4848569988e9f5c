"""File formats: NPY volumes (read by slabs, written by parts), NPZ archives, compressed datasets (csbd) and dumps of labels.

Readers and writers are Python data sources, so ``spark.read.format("npy")`` and ``df.write.format("csbd")`` work after ``register(spark)``.
"""

from __future__ import annotations

import os
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MAGIC, VERSION, SYMBOLS, TOTAL, HEAD = 0x43534244, 1, 16, 4096, 152


def npy_header(file) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and place of the data. Refuses what would be read wrongly: column order, big-endian data, and other than unsigned integers of 4 or 8 bytes in 3 dimensions."""
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(file)
    if fortran or len(shape) != 3 or dtype.kind != "u" or dtype.itemsize not in (4, 8) or dtype.byteorder == ">":
        raise ValueError(f"not a volume of unsigned labels: shape {shape}, type {dtype}, column order {fortran}")
    return shape, dtype, file.tell()


def slab(raw: bytes, dtype: np.dtype, shape: tuple[int, ...], z: int) -> pa.RecordBatch:
    """Voxels of whole planes from ``z`` on; the first axis of the shape is the fastest. Labels keep their 64 bits as signed."""
    w, h, _ = shape
    labels = np.frombuffer(raw, dtype).astype(np.uint64).view(np.int64)
    at = np.arange(len(labels), dtype=np.int64) + z * w * h
    return pa.RecordBatch.from_arrays([pa.array((at % w).astype(np.int32)), pa.array((at // w % h).astype(np.int32)), pa.array((at // (w * h)).astype(np.int32)), pa.array(labels)], names=["x", "y", "z", "label"])


class Part(InputPartition):
    def __init__(self, *what):
        self.what = what


class NpyReader(DataSourceReader):
    """Parts of ``planes`` planes. An array that an archive stores as it is is read like a file of its own, each part from its place (the archive's checksum is then not compared). A deflated one has no places to start at, so each of its at most ``tasks`` parts inflates what comes before it, plane by plane, and gives the rows of its own planes alone; the last compares the checksum. A task holds ``planes`` planes at a time."""

    def __init__(self, options):
        self.path, self.planes, self.name, self.tasks = options["path"], int(options.get("planes", 16)), options.get("array"), int(options.get("tasks", 4))

    def partitions(self):
        if self.path.endswith(".npz"):
            with zipfile.ZipFile(self.path) as archive:
                arrays = [i for i in archive.infolist() if i.filename.endswith(".npy") and self.name in (None, i.filename[:-4])]
                if not arrays:
                    raise ValueError(f"no array {self.name} in {self.path}")
                return [part for info in arrays for part in self.parts_of(archive, info)]
        with open(self.path, "rb") as file:
            shape, dtype, start = npy_header(file)
        return [Part("npy", shape, dtype.str, start, z) for z in range(0, shape[2], self.planes)]

    def parts_of(self, archive, info):
        with archive.open(info) as file:
            shape, dtype, start = npy_header(file)
        if info.compress_type == zipfile.ZIP_STORED:
            with open(self.path, "rb") as file:
                file.seek(info.header_offset + 26)
                start += info.header_offset + 30 + sum(struct.unpack("<HH", file.read(4)))
            return [Part("npy", shape, dtype.str, start, z) for z in range(0, shape[2], self.planes)]
        step = max(self.planes, -(-shape[2] // self.tasks))
        return [Part("npz", info.filename, z, min(z + step, shape[2])) for z in range(0, shape[2], step)]

    def read(self, part):
        if part.what[0] == "npz":
            _, name, first, last = part.what
            with zipfile.ZipFile(self.path) as archive, archive.open(name) as file:
                shape, dtype, _ = npy_header(file)
                plane = shape[0] * shape[1] * dtype.itemsize
                for _ in range(first):
                    file.read(plane)
                for z in range(first, last, self.planes):
                    yield slab(file.read(min(self.planes, last - z) * plane), dtype, shape, z)
                if last == shape[2]:
                    file.read()
            return
        _, shape, kind, start, z = part.what
        dtype = np.dtype(kind)
        plane = shape[0] * shape[1] * dtype.itemsize
        with open(self.path, "rb") as file:
            file.seek(start + z * plane)
            yield slab(file.read(min(self.planes, shape[2] - z) * plane), dtype, shape, z)


def refuse_append(path: str, overwrite: bool) -> None:
    """An archive or a compressed dataset has one header for all it holds, so it is written whole: adding to one that exists would drop what is there."""
    if not overwrite and os.path.exists(path):
        raise ValueError(f"{path} exists and cannot be added to: use the mode overwrite, with all rows")


class Written(WriterCommitMessage):
    def __init__(self, file):
        self.file = file


class GatheringWriter(DataSourceWriter):
    """Tasks write parts beside the target; the commit joins them and an abort removes them. The path must be one that all executors share."""

    def __init__(self, options, overwrite):
        self.options, self.path, self.overwrite = options, options["path"], overwrite

    def write(self, rows):
        from pyspark import TaskContext

        file = f"{self.path}.part-{TaskContext.get().taskAttemptId()}"
        with open(file, "wb") as out:
            for row in rows:
                out.write(self.record(row))
        return Written(file)

    def parts(self, messages):
        return [m.file for m in messages if m]

    def abort(self, messages):
        for file in self.parts(messages):
            os.path.exists(file) and os.remove(file)


#: Records of a part that are held at a time.
CHUNK = 1 << 20
VOXEL = np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("label", "<i8")])


def append_planes(path: str, planes: np.ndarray | np.memmap, shape: tuple[int, ...]) -> None:
    """Lengthens a volume's first axis by the flat ``planes`` of an array of ``shape``; the other axes must agree. The longer volume is written beside the old one and then takes its place, so a failure leaves the old one whole."""
    aside = path + ".longer"
    with open(path, "rb") as file:
        old, dtype, _ = npy_header(file)
        if old[1:] != shape[1:] or dtype != np.dtype("<u8"):
            raise ValueError(f"{shape} does not lengthen {old} of {dtype}")
        with open(aside, "wb") as out:
            np.lib.format.write_array_header_1_0(out, {"descr": "<u8", "fortran_order": False, "shape": (old[0] + shape[0], *old[1:])})
            while piece := file.read(8 * CHUNK):
                out.write(piece)
            for at in range(0, len(planes), CHUNK):
                out.write(planes[at : at + CHUNK].tobytes())
    os.replace(aside, path)


class NpyWriter(GatheringWriter):
    """Voxels (x, y, z, label) as a volume of u64, absent ones 0; a zip of one array if the path ends in .npz. Parts are read by pieces and written into a mapped file, so neither a task nor the driver holds the volume. In append mode the rows are a volume of their own that lengthens the first axis of the file."""

    FORM = "<iiiq"

    def __init__(self, options, overwrite):
        super().__init__(options, overwrite)
        if self.path.endswith(".npz"):
            refuse_append(self.path, overwrite)

    def record(self, row):
        return struct.pack(self.FORM, row["x"], row["y"], row["z"], row["label"])

    def pieces(self, messages):
        for file in self.parts(messages):
            if os.path.getsize(file):
                part = np.memmap(file, VOXEL, "r")
                for at in range(0, len(part), CHUNK):
                    yield part[at : at + CHUNK]

    def commit(self, messages):
        shape = (0, 0, 0)
        for p in self.pieces(messages):
            shape = tuple(max(n, int(p[c].max()) + 1) for n, c in zip(shape, "xyz", strict=True))
        append = not self.overwrite and os.path.exists(self.path) and not self.path.endswith(".npz")
        target = self.path.removesuffix(".npz") + ".tmp.npy" if append or self.path.endswith(".npz") else self.path
        volume = np.lib.format.open_memmap(target, "w+", "<u8", shape) if min(shape) else np.zeros(shape, "<u8")
        flat = volume.reshape(-1)
        for p in self.pieces(messages):
            flat[p["x"].astype(np.int64) + shape[0] * (p["y"].astype(np.int64) + shape[1] * p["z"].astype(np.int64))] = p["label"].view(np.uint64) if p["label"].flags.c_contiguous else p["label"].astype("<i8").view(np.uint64)
        if min(shape):
            volume.flush()
        else:
            np.save(target, volume)
        if append:
            if min(shape):
                append_planes(self.path, flat, shape)
            os.remove(target)
        elif target != self.path:
            with zipfile.ZipFile(self.path, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.write(target, self.options.get("array", "arr_0") + ".npy")
            os.remove(target)
        self.abort(messages)


class CsbdWriter(GatheringWriter):
    """Rows (brick_id, palette, encoded, n_symbols) and the option ``freq``, 16 comma-separated frequencies. Records go in order of brick_id; the driver copies them, one at a time, as a record's place follows from the sizes of all before it. With the option ``checksum``, a record ends with the CRC-32 of its encoded bytes."""

    def __init__(self, options, overwrite):
        super().__init__(options, overwrite)
        refuse_append(self.path, overwrite)

    def record(self, row):
        body = struct.pack(f"<II{len(row['palette'])}qI", row["brick_id"], len(row["palette"]), *row["palette"], len(row["encoded"])) + bytes(row["encoded"]) + struct.pack("<I", row["n_symbols"])
        if checked(self.options):
            body += struct.pack("<I", zlib.crc32(row["encoded"]))
        return struct.pack("<qI", row["brick_id"], len(body)) + body

    def commit(self, messages):
        places = []
        for file in self.parts(messages):
            with open(file, "rb") as part:
                while head := part.read(12):
                    brick, size = struct.unpack("<qI", head)
                    places.append((brick, file, part.tell(), size))
                    part.seek(size, 1)
        freq = [int(x) for x in self.options["freq"].split(",")]
        with open(self.path, "wb") as out:
            out.write(struct.pack("<4I", MAGIC, VERSION, len(places), int(self.options.get("brickSize", self.options.get("bricksize", 64)))))
            out.write(struct.pack("<2I16I16I", SYMBOLS, TOTAL, *freq, *np.concatenate([[0], np.cumsum(freq)[:-1]]).tolist()))
            for _, file, at, size in sorted(places):
                with open(file, "rb") as part:
                    part.seek(at)
                    out.write(part.read(size))
        self.abort(messages)


def checked(options) -> bool:
    return str(options.get("checksum", "false")).lower() == "true"


def csbd_records(file, n: int, crc: bool):
    """(brick_id, place in the file) of each of ``n`` records, by their lengths."""
    at = HEAD
    for _ in range(n):
        file.seek(at)
        brick, p = struct.unpack("<II", file.read(8))
        file.seek(at + 8 + 8 * p)
        (e,) = struct.unpack("<I", file.read(4))
        yield brick, at
        at += 16 + 8 * p + e + 4 * crc


def csbd_positions(spark: SparkSession, path: str, checksum: bool = False):
    """brick_id and position, from 0, of the bricks of a compressed dataset in order of its file: what puts a dump's bricks back in their places."""
    with open(path, "rb") as file:
        rows = [(brick, k) for k, (brick, _) in enumerate(csbd_records(file, csbd_header(file)["bricks"], checksum))]
    return spark.createDataFrame(rows, "brick_id long, position long")


def csbd_header(file) -> dict:
    """Brick count and size, and the model with its cumulative sums rebuilt, so that what is read can be written again."""
    magic, version, n, size = struct.unpack("<4I", file.read(16))
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a compressed dataset of version 1")
    symbols, total, *freq = struct.unpack("<2I16I", file.read(72))
    if symbols != SYMBOLS or total != TOTAL or sum(freq) != TOTAL:
        raise ValueError("unknown entropy model")
    return {"bricks": n, "brick_size": size, "freq": freq, "cum": [0, *np.cumsum(freq).tolist()]}


class CsbdReader(DataSourceReader):
    """Bricks of a file. Records have no index, so one pass over their lengths plans byte ranges, which are then read in parallel."""

    def __init__(self, options):
        self.path, self.per, self.crc = options["path"], int(options.get("bricks", 256)), checked(options)

    def partitions(self):
        with open(self.path, "rb") as file:
            n = csbd_header(file)["bricks"]
            return [Part(at, min(self.per, n - i)) for i, (_, at) in enumerate(csbd_records(file, n, self.crc)) if i % self.per == 0]

    def read(self, part):
        at, n = part.what
        with open(self.path, "rb") as file:
            file.seek(at)
            for _ in range(n):
                brick, p = struct.unpack("<II", file.read(8))
                palette = list(struct.unpack(f"<{p}q", file.read(8 * p)))
                (e,) = struct.unpack("<I", file.read(4))
                encoded, (symbols,) = file.read(e), struct.unpack("<I", file.read(4))
                if self.crc and struct.unpack("<I", file.read(4))[0] != zlib.crc32(encoded):
                    raise ValueError(f"brick {brick} is damaged")
                yield brick, palette, encoded, symbols


class DumpReader(DataSourceReader):
    """Labels of whole bricks, u64 one brick after the other, in Morton order within each; ``brick_size`` is an option."""

    def __init__(self, options):
        self.path, self.voxels, self.per = options["path"], int(options.get("brick_size", 64)) ** 3, int(options.get("bricks", 64))

    def partitions(self):
        n, rest = divmod(os.path.getsize(self.path), 8 * self.voxels)
        if rest:
            raise ValueError("the dump does not hold whole bricks")
        return [Part(k, min(self.per, n - k)) for k in range(0, n, self.per)]

    def read(self, part):
        first, n = part.what
        with open(self.path, "rb") as file:
            file.seek(8 * self.voxels * first)
            for k in range(n):
                yield first + k, np.frombuffer(file.read(8 * self.voxels), "<i8").tolist()


class DumpWriter(DataSourceWriter):
    """Rows (position, labels) as a dump; each task writes its bricks at their places, on a path that all executors share."""

    def __init__(self, options, overwrite):
        self.path = options["path"]
        if overwrite or not os.path.exists(self.path):
            open(self.path, "wb").close()

    def write(self, rows):
        with open(self.path, "r+b") as out:
            for row in rows:
                out.seek(8 * len(row["labels"]) * row["position"])
                out.write(np.array(row["labels"], "<i8").tobytes())
        return Written(self.path)


class NpySource(DataSource):
    @classmethod
    def name(cls):
        return "npy"

    def schema(self):
        return "x int, y int, z int, label bigint"

    def reader(self, schema):
        return NpyReader(self.options)

    def writer(self, schema, overwrite):
        return NpyWriter(self.options, overwrite)


class CsbdSource(DataSource):
    @classmethod
    def name(cls):
        return "csbd"

    def schema(self):
        return "brick_id bigint, palette array<bigint>, encoded binary, n_symbols int"

    def reader(self, schema):
        return CsbdReader(self.options)

    def writer(self, schema, overwrite):
        return CsbdWriter(self.options, overwrite)


class DumpSource(DataSource):
    @classmethod
    def name(cls):
        return "labels"

    def schema(self):
        return "position bigint, labels array<bigint>"

    def reader(self, schema):
        return DumpReader(self.options)

    def writer(self, schema, overwrite):
        return DumpWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)
    spark.dataSource.register(CsbdSource)
    spark.dataSource.register(DumpSource)


def write_ppm(pixels, path: str, width: int, height: int) -> None:
    """An image of ``pixels`` (px, py, rgba): a bounded result, width * height rows, goes to the driver."""
    image = np.zeros((height, width, 3), np.uint8)
    for r in pixels.toLocalIterator():
        image[r["py"], r["px"]] = [r["rgba"] & 255, r["rgba"] >> 8 & 255, r["rgba"] >> 16 & 255]
    with open(path, "wb") as out:
        out.write(b"P6 %d %d 255\n" % (width, height) + image.tobytes())
