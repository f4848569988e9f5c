import struct

import numpy as np
import pytest

from voxelspark.operators import codec
from voxelspark.sources import files
from voxelspark.sources.files import csbd_header, csbd_positions, register


def test_npy_and_npz_round_trip(spark, tmp_path):
    register(spark)
    volume = np.arange(4 * 3 * 5, dtype=np.uint64).reshape(4, 3, 5) + np.uint64(2**63 - 3)
    np.save(tmp_path / "v.npy", volume)
    df = spark.read.format("npy").option("planes", 2).load(str(tmp_path / "v.npy"))
    flat = volume.reshape(-1)
    rows = df.collect()
    assert len(rows) == 60 and all(np.uint64(r.label & (2**64 - 1)) == flat[r.x + 4 * (r.y + 3 * r.z)] for r in rows)
    for name in ("w.npy", "w.npz"):
        df.write.format("npy").mode("overwrite").save(str(tmp_path / name))
        back = np.load(tmp_path / name)
        assert ((back["arr_0"] if name.endswith("z") else back).reshape(-1) == flat).all()
        assert spark.read.format("npy").load(str(tmp_path / name)).exceptAll(df).isEmpty()


def test_wrong_volumes_are_refused(spark, tmp_path):
    register(spark)
    for k, a in enumerate((np.zeros((2, 2)), np.zeros((2, 2, 2)), np.zeros((2, 2, 2), np.int32), np.asfortranarray(np.zeros((2, 3, 2), np.uint32)))):
        np.save(tmp_path / f"{k}.npy", a)
        with pytest.raises(Exception, match="not a volume"):
            spark.read.format("npy").load(str(tmp_path / f"{k}.npy")).collect()


def test_csbd_layout_and_round_trip(spark, tmp_path):
    register(spark)
    rng = np.random.default_rng(2)
    rows = [(b, m, int(v)) for b in range(5) for m, v in enumerate(rng.integers(0, 3, 64))]
    encoded = codec.encode(spark.createDataFrame(rows, "brick_id long, m long, label long"), 4).cache()
    freq = codec.rans_model(encoded)
    path = str(tmp_path / "d.csbd")
    codec.compress(encoded, freq).write.format("csbd").option("freq", ",".join(map(str, freq))).option("brickSize", 4).mode("overwrite").save(path)
    with open(path, "rb") as file:
        head = csbd_header(file)
        raw = open(path, "rb").read()
    assert head["freq"] == freq and head["bricks"] == 5 and head["brick_size"] == 4 and raw[:4] == struct.pack("<I", 0x43534244)
    loaded = spark.read.format("csbd").option("bricks", 2).load(path)
    back = codec.decode(codec.decompress(loaded, freq), 4)
    assert sorted((r.brick_id, r.m, r.label) for r in back.collect()) == sorted(rows)


def test_npy_grows_along_its_first_axis(spark, tmp_path):
    register(spark)
    rng = np.random.default_rng(3)
    path, parts = str(tmp_path / "v.npy"), [rng.integers(0, 99, (n, 3, 2)).astype("<u8") for n in (4, 2, 5)]
    for k, a in enumerate(parts):
        flat = a.reshape(-1).tolist()
        rows = [(i % len(a), i // len(a) % 3, i // (3 * len(a)), v) for i, v in enumerate(flat)]
        spark.createDataFrame(rows, "x int, y int, z int, label long").write.format("npy").mode("append" if k else "overwrite").save(path)
    assert (np.load(path) == np.concatenate(parts)).all()
    with pytest.raises(Exception, match="does not lengthen"):
        spark.createDataFrame([(0, 0, 0, 1)], "x int, y int, z int, label long").write.format("npy").mode("append").save(path)


def test_parts_are_read_by_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "CHUNK", 7)
    register(spark)
    rows = [(i % 4, i // 4 % 5, i // 20, i * i) for i in range(60)]
    spark.createDataFrame(rows, "x int, y int, z int, label long").repartition(3).write.format("npy").mode("overwrite").save(str(tmp_path / "p.npy"))
    assert np.load(tmp_path / "p.npy").reshape(-1).tolist() == [r[3] for r in rows]


def coded(spark, path, **options):
    rng = np.random.default_rng(5)
    rows = [(b, m, int(v)) for b in (7, 2, 4) for m, v in enumerate(rng.integers(0, 3, 64))]
    encoded = codec.encode(spark.createDataFrame(rows, "brick_id long, m long, label long"), 4).cache()
    freq = codec.rans_model(encoded)
    codec.compress(encoded, freq).write.format("csbd").options(freq=",".join(map(str, freq)), brickSize=4, **options).mode("overwrite").save(path)
    return rows, freq


def test_damaged_bricks_are_found(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "d.csbd")
    rows, freq = coded(spark, path, checksum="true")
    load = lambda: codec.decode(codec.decompress(spark.read.format("csbd").option("checksum", "true").option("bricks", 2).load(path), freq), 4)
    assert sorted((r.brick_id, r.m, r.label) for r in load().collect()) == sorted(rows)
    raw = bytearray(open(path, "rb").read())
    raw[-12] ^= 1  # the last encoded byte before n_symbols and the checksum is four further
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="damaged"):
        load().collect()


def test_dumps_go_back_to_their_bricks(spark, tmp_path):
    register(spark)
    path, dump = str(tmp_path / "d.csbd"), str(tmp_path / "labels.bin")
    rows, _ = coded(spark, path)
    places = csbd_positions(spark, path)
    assert [tuple(r) for r in places.collect()] == [(2, 0), (4, 1), (7, 2)]
    arrays = {}
    for b, _, v in rows:
        arrays.setdefault(b, []).append(v)
    spark.createDataFrame(list(arrays.items()), "brick_id long, labels array<long>").join(places, "brick_id").select("position", "labels").repartition(2).write.format("labels").mode("overwrite").save(dump)
    assert np.fromfile(dump, "<u8").tolist() == [v for b in (2, 4, 7) for v in arrays[b]]
    back = spark.read.format("labels").option("brick_size", 4).option("bricks", 2).load(dump).join(places, "position")
    assert {r.brick_id: r.labels for r in back.collect()} == arrays
    with pytest.raises(Exception, match="whole bricks"):
        spark.read.format("labels").option("brick_size", 8).load(dump).collect()


@pytest.mark.parametrize("kind", ["csbd", "npz"])
def test_appending_to_a_whole_file_is_refused(spark, tmp_path, kind):
    from voxelspark.sources import files

    files.register(spark)
    if kind == "csbd":
        df, path, name = spark.createDataFrame([(k, [0, k], b"12", 2) for k in range(5)], "brick_id long, palette array<long>, encoded binary, n_symbols int"), str(tmp_path / "a.csbd"), "csbd"
    else:
        df, path, name = spark.createDataFrame([(x, 0, 0, x + 1) for x in range(5)], "x int, y int, z int, label long"), str(tmp_path / "a.npz"), "npy"
    write = lambda d, mode: d.write.format(name).option("freq", ",".join(["256"] * 16)).mode(mode).save(path)
    write(df, "append")
    assert spark.read.format(name).load(path).count() == 5
    with pytest.raises(Exception, match="cannot be added to"):
        write(df.limit(1), "append")
    assert spark.read.format(name).load(path).count() == 5
    write(df.limit(1), "overwrite")
    assert spark.read.format(name).load(path).count() == 1


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archives_are_read_by_planes(spark, tmp_path, save):
    """Arrays of an archive split into planes, deflated or not, beside other arrays."""
    register(spark)
    rng = np.random.default_rng(5)
    volumes = {"a": rng.integers(0, 2**64, (5, 3, 23), dtype=np.uint64), "b": rng.integers(0, 9, (2, 2, 1), dtype=np.uint32)}
    path = str(tmp_path / "v.npz")
    save(path, **volumes)
    for name, volume in volumes.items():
        df = spark.read.format("npy").option("planes", 3).option("array", name).load(path)
        flat = volume.reshape(-1)
        w, h, d = volume.shape
        rows = df.collect()
        assert len({(r.x, r.y, r.z) for r in rows}) == len(rows) == volume.size
        assert all(r.label & (2**64 - 1) == int(flat[r.x + w * (r.y + h * r.z)]) for r in rows)
        assert df.rdd.getNumPartitions() == (1 if name == "b" else 8 if save is np.savez else 4)
    assert spark.read.format("npy").load(path).count() == 5 * 3 * 23 + 4


def test_damaged_archives_are_refused(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "v.npz")
    np.savez_compressed(path, a=np.random.default_rng(6).integers(0, 2**64, (8, 8, 32), dtype=np.uint64))
    raw = bytearray(open(path, "rb").read())
    raw[len(raw) // 2] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="CRC|inflate|zlib|decompress"):
        spark.read.format("npy").load(path).collect()
