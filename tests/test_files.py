"""Deltas as single files, with stand-ins for the external tools."""

import struct

import pytest

from tessera.__main__ import main
from tessera.operators import codec, stretches
from tessera.plans import api, files
from tessera.sources import container, headers, pseudo

SUPERBLOCK = struct.pack("<IIIIIHHHHHH", 0x73717368, 1, 1700000000, 131072, 0, 6, 17, 0x02D0, 1, 4, 0)
OLD = {"a/x.1": b"old content " * 40, "a/y": b"same", "b": b""}
NEW = {"a/x.2": b"old content " * 40 + b"and more", "a/y": b"same", "c": b"fresh"}

TOOLS = {
    "xdelta3": 'eval first=\\"\\$$(($# - 1))\\"; eval last=\\"\\$$#\\"; case "$1" in config) exit 0;; -e) { printf "\\326\\303\\304\\000"; cat "$first"; } > "$last";; -d) tail -c +5 "$first" > "$last";; esac',
    "unsquashfs": '[ "$1" = -help ] && exit 0; eval image=\\"\\$$#\\"; eval out=\\"\\$$(($# - 1))\\"; tail -c +33 "$image" > "$out"',
    "mksquashfs": '[ "$1" = -version ] && exit 0; cat "$(dirname "$0")/superblock" - > "$2"; echo "$@" > "$2.arguments"',
}


@pytest.fixture
def tools(tmp_path, monkeypatch):
    folder = tmp_path / "tools"
    folder.mkdir()
    for name, script in TOOLS.items():
        (folder / name).write_text("#!/bin/sh\n" + script + "\n")
        (folder / name).chmod(0o755)
    (folder / "superblock").write_bytes(SUPERBLOCK.ljust(32, b"\0"))
    monkeypatch.setenv(codec.FOLDERS, str(folder))
    return folder


def write(spark, path, entries):
    df = spark.createDataFrame([(i, p, bytearray(c)) for i, (p, c) in enumerate(entries.items())], "idx bigint, path string, content binary")
    pseudo.write_pseudo(df, str(path))
    return str(path)


def read(spark, path):
    return {r["path"]: bytes(r["content"]) for r in pseudo.read_pseudo(spark, str(path)).collect()}


@pytest.mark.parametrize("name", ["zstd", "zstd:3", "store", "zstd-stream", "store-stream", "xdelta3", "xdelta3:9"])
def test_pseudo_files(spark, tmp_path, tools, name):
    old, new = write(spark, tmp_path / "old", OLD), write(spark, tmp_path / "new", NEW)
    delta, made = str(tmp_path / "delta"), str(tmp_path / "made")
    n = files.generate_file(spark, old, new, delta, name, like=str(tools / "superblock"))
    body = (tmp_path / "delta").read_bytes()
    assert n == len(body) and not (tmp_path / "delta.tmp").exists()
    assert struct.unpack_from("<IBBHIHH", body) == (0x66707173, 1, 1, codec.codec(name).tool, 1700000000, 6, 0x02D0)
    arguments = files.apply_file(spark, old, delta, made)
    assert read(spark, made) == NEW and arguments == ["-comp", "zstd", "-no-fragments", "-exports", "-no-xattrs", "-mkfs-time", "1700000000"]


@pytest.mark.parametrize("name", ["zstd", "zstd-stream", "xdelta3"])
def test_images(spark, tmp_path, tools, name):
    images = {}
    for kind, entries in (("old", OLD), ("new", NEW)):
        body = open(write(spark, tmp_path / f"{kind}.pseudo", entries), "rb").read()
        images[kind] = str(tmp_path / f"{kind}.img")
        (tmp_path / f"{kind}.img").write_bytes(SUPERBLOCK.ljust(32, b"\0") + body)
    delta, made = str(tmp_path / "delta"), str(tmp_path / "made.img")
    files.generate_file(spark, images["old"], images["new"], delta, name)
    files.apply_file(spark, images["old"], delta, made)
    assert files.is_image(made) and (tmp_path / "made.img.arguments").read_text().split() == ["-", made, "-pf", "-", "-noappend", "-quiet", "-comp", "zstd", "-no-fragments", "-exports", "-no-xattrs", "-mkfs-time", "1700000000", "-mem-percent", "3"]
    (tmp_path / "made.pseudo").write_bytes((tmp_path / "made.img").read_bytes()[32:])
    assert read(spark, tmp_path / "made.pseudo") == NEW


def test_plain_deltas_are_applied_by_their_magic(spark, tmp_path, tools):
    (tmp_path / "old").write_bytes(b"any bytes")
    (tmp_path / "new").write_bytes(b"any other bytes")
    delta, made = str(tmp_path / "delta"), tmp_path / "made"
    files.generate_file(spark, str(tmp_path / "old"), str(tmp_path / "new"), delta, "xdelta3-plain")
    assert (tmp_path / "delta").read_bytes()[:4] == bytes.fromhex("d6c3c400")
    assert files.apply_file(spark, str(tmp_path / "old"), delta, str(made)) is None and made.read_bytes() == b"any other bytes"
    options = bytearray(SUPERBLOCK.ljust(32, b"\0"))
    options[25] |= 0x04
    (tmp_path / "new.img").write_bytes(bytes(options) + b"x")
    with pytest.raises(ValueError, match="compressor options"):
        files.generate_file(spark, str(tmp_path / "old"), str(tmp_path / "new.img"), delta, "xdelta3")
    files.generate_file(spark, str(tmp_path / "old"), str(tmp_path / "new.img"), delta, "xdelta3", "plain")
    files.apply_file(spark, str(tmp_path / "old"), delta, str(made))
    assert made.read_bytes() == bytes(options) + b"x"


def test_bad_delta_files_are_errors(spark, tmp_path):
    old, new = write(spark, tmp_path / "old", OLD), write(spark, tmp_path / "new", NEW)
    files.generate_file(spark, old, new, str(tmp_path / "delta"), "store-stream")
    good = (tmp_path / "delta").read_bytes()
    for bad, why in ((b"", "too short"), (b"abcd" + good[4:], "wrong magic"), (good[:20], "too short"), (good[:5] + b"\2" + good[6:], "version"), (good[:6] + b"\x33\3" + good[8:], "unknown tool"), (good[:12] + b"\x09" + good[13:], "unknown compression"), (good[:15] + b"\x04" + good[16:], "compressor options")):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(Exception, match=why):
            files.apply_file(spark, old, str(tmp_path / "bad"), str(tmp_path / "made"))
        assert not (tmp_path / "made").exists()
    with pytest.raises(ValueError, match="isn't installed"):
        (tmp_path / "i.img").write_bytes(SUPERBLOCK.ljust(32, b"\0"))
        files.generate_file(spark, str(tmp_path / "i.img"), str(tmp_path / "i.img"), str(tmp_path / "bad"), "store-stream")
    with pytest.raises(ValueError, match="one patch of whole files"):
        api.export_container(spark, old, new, str(tmp_path / "bad"), "store-stream")
    with pytest.raises(ValueError, match="no level"):
        codec.codec("store:3")


def test_overlapping_source_segments_are_an_error(spark, tmp_path):
    (tmp_path / "old").write_bytes(b"a R 0 644 0 0 5 0\nb R 0 644 0 0 5 3\n#\n# START OF DATA - DO NOT MODIFY\n#\nhellothere")
    new = write(spark, tmp_path / "new", NEW)
    with pytest.raises(ValueError, match="overlap"):
        api.generate(spark, str(tmp_path / "old"), new, str(tmp_path / "d"), mode="compat")


def test_only_the_heads_of_images_are_read(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"{n}.img").write_bytes(SUPERBLOCK.ljust(32, b"\0") + b"x" * 100)
    rows = headers.read_superblocks(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and {r["mtime"] for r in rows} == {1700000000} and all(r["error"] is None for r in rows)
    assert headers.read_superblocks(spark, str(tmp_path / "1.img")).count() == 1


def test_command_line_takes_delta_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tessera.__main__.local_session", lambda *_: spark)
    old, new = write(spark, tmp_path / "old", OLD), write(spark, tmp_path / "new", NEW)
    delta, made = str(tmp_path / "delta"), str(tmp_path / "made")
    assert main(["generate", "-s", old, "-t", new, "-d", delta, "--file", "--codec", "zstd-stream:5"]) == 0
    assert main(["apply", "-s", old, "-t", made, "-d", delta]) == 0 and read(spark, made) == NEW
    assert main(["generate", "-s", old, "-t", new, "-d", delta, "--codec", "nothing"]) == 1


def test_containers_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """No record and no name comes to the driver, whether or not a container is read in stretches."""
    old, new = write(spark, tmp_path / "old", OLD), write(spark, tmp_path / "new", NEW)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", lambda *_, **__: 1 / 0)
    monkeypatch.setattr("tessera.sources.pseudo.read_manifest", lambda *_: 1 / 0)
    monkeypatch.setattr("tessera.sources.container.TASK_BYTES", 70)
    files.generate_file(spark, old, new, str(tmp_path / "delta"), "zstd:3")
    plan = container._Reader(str(tmp_path / "delta")).partitions()
    assert len(plan) > 1 and all(isinstance(x, (int, str)) for p in plan for x in vars(p).values())
    files.apply_file(spark, old, str(tmp_path / "delta"), str(tmp_path / "made"))
    assert read(spark, tmp_path / "made") == NEW


@pytest.mark.parametrize("name", ["zstd-stream:3", "store-stream"])
def test_streams_of_any_size(spark, tmp_path, monkeypatch, name):
    """Files larger than one patch may be are encoded by stretches, each by a task."""
    old, new = write(spark, tmp_path / "old", OLD), write(spark, tmp_path / "new", NEW)
    for module, limit, value in (("operators.stretches", "STRETCH", 100), ("operators.stretches", "REACH", 100), ("operators.stretches", "LIMIT", 200), ("plans.files", "LIMIT", 200)):
        monkeypatch.setattr(f"tessera.{module}.{limit}", value, raising=True)
    delta = str(tmp_path / "delta")
    n = files.generate_file(spark, old, new, delta, name)
    body = (tmp_path / "delta").read_bytes()
    assert n == len(body) and body[32:40] == stretches.MAGIC
    files.apply_file(spark, old, delta, str(tmp_path / "made"))
    assert (tmp_path / "made").read_bytes() == (tmp_path / "new").read_bytes()
    (tmp_path / "cut").write_bytes(body[:-1])
    with pytest.raises(ValueError, match="malformed"):
        files.apply_file(spark, old, str(tmp_path / "cut"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() and not list(tmp_path.glob("*.parts"))


def test_stretches_cover_the_target():
    for source, target in ((0, 1), (1, 100 << 20), (90 << 20, 100 << 20), (5, 0), (300 << 20, 20 << 20)):
        found = stretches.cut(source, target)
        assert sum(n for _, n, _, _ in found) == target and all(0 <= low and 0 <= n and low + n <= source for _, _, low, n in found)
