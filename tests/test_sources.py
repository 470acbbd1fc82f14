import io
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.sources import container, headers, pseudo, snapshots

MANIFEST = r"""# comment
/ D 1700000000 755 0 0
usr/lib/libfoo.so.1.2 R 1700000000 644 0 0 5 0
my\ file R 1700000000 644 0 0 3 5
too short
usr/bin/x S 1700000000 777 0 0 ../y
# START OF DATA - DO NOT MODIFY
#
"""


def test_manifest_and_payload(spark, tmp_path):
    path = tmp_path / "a.pseudo"
    path.write_bytes(MANIFEST.encode() + b"helloabc")
    got = pseudo.read_pseudo(spark, str(path)).orderBy("idx").collect()
    assert [(r["idx"], r["path"], r["size"], r["off"], bytes(r["content"])) for r in got] == [(0, "usr/lib/libfoo.so.1.2", 5, 0, b"hello"), (1, "my file", 3, 5, b"abc")]
    bare = pseudo.read_pseudo(spark, f"file://{path}", payload=False)
    assert bare.where("content is not null").count() == 0 and bare.count() == 2


@pytest.mark.parametrize("line", ["x R 1 644 0 0 5", "x R 1 644 0 0 abc 0"])
def test_malformed_regular_files_are_errors(spark, line):
    with pytest.raises(ValueError):
        pseudo.read_manifest(io.BytesIO(line.encode()))
    with pytest.raises(PySparkException):
        pseudo.parse_lines(spark.createDataFrame([(0, line)], "line_no bigint, line string")).collect()


def test_manifest_without_marker_or_newline():
    entries, start = pseudo.read_manifest(io.BytesIO(b"a R 1 644 0 0 0 0"))
    assert [e.path for e in entries] == ["a"] and start >= 17
    assert pseudo.read_manifest(io.BytesIO(b"")) == ([], 0)


def test_names_that_end_in_a_backslash(spark):
    line = r"dir\\ R 1 644 0 0 4 9"
    assert pseudo.parse_line(line) == pseudo.Entry("dir\\", 4, 9)
    got = pseudo.parse_lines(spark.createDataFrame([(0, line), (1, "# x"), (2, "  "), (3, "d D 1 2 3")], "line_no bigint, line string")).collect()
    assert [(r["path"], r["size"], r["off"]) for r in got] == [("dir\\", 4, 9)]


def test_payload_that_ends_early_is_an_error(spark, tmp_path):
    (tmp_path / "b").write_bytes(MANIFEST.encode() + b"hel")
    with pytest.raises(PySparkException):
        pseudo.read_pseudo(spark, str(tmp_path / "b")).collect()


def test_pseudo_round_trip(spark, tmp_path):
    data = [(0, "a b", b"\x00\xff\n#"), (1, "c\\", b""), (2, "d/e", b"x" * 1000)]
    path = str(tmp_path / "c")
    pseudo.write_pseudo(spark.createDataFrame([(i, p, bytearray(c)) for i, p, c in data], "idx bigint, path string, content binary"), path)
    got = pseudo.read_pseudo(spark, path).orderBy("idx").collect()
    assert [(r["idx"], r["path"], bytes(r["content"])) for r in got] == data
    assert not (tmp_path / "c.tmp").exists()


def header(magic=0x66707173, fv=1, tv=1, tool=1, size=32):
    return (struct.pack("<IBBHIHH", magic, fv, tv, tool, 1700000000, 6, 0xC0) + bytes(16))[:size]


def test_header_errors(spark):
    cases = {
        "hdiffz": (header(tool=2), None),
        "xdelta3": (header(), None),
        "magic": (header(magic=1), "wrong magic"),
        "plain": (bytes.fromhex("d6c3c400") + bytes(8), None),
        "version": (header(tv=2), "unsupported version"),
        "tool": (header(tool=9), "unknown tool"),
        "3 bytes": (b"sqp", "too short"),
        "31 bytes": (header(size=31), "too short"),
    }
    df = spark.createDataFrame([(k, bytearray(b)) for k, (b, _) in cases.items()], "k string, b binary")
    got = {r["k"]: (r["e"], r["d"]) for r in df.select("k", headers.header_error(F.col("b")).alias("e"), headers.delta_kind(F.col("b")).alias("d")).collect()}
    assert {k: e for k, (e, _) in got.items()} == {k: e for k, (_, e) in cases.items()}
    assert got["plain"][1] == "plain" and got["hdiffz"][1] == "container"


def test_header_bytes_and_body(spark):
    df = spark.range(1).select(headers.header_bytes(F.lit(2), F.lit(1700000000), F.lit(6), F.lit(0xC0)).alias("h"))
    assert bytes(df.first()["h"]) == header(tool=2)
    assert bytes(df.select(headers.body(F.concat("h", F.lit(bytearray(b"rest")))).alias("b")).first()["b"]) == b"rest"


def superblock(magic=0x73717368, comp=4, flags=0xC0, major=4):
    return struct.pack("<IIIIIHHHHHH", magic, 7, 1700000000, 131072, 3, comp, 17, flags, 1, major, 0)


def test_superblocks(spark, tmp_path):
    images = {"good": superblock() + b"data", "magic": superblock(magic=1), "old": superblock(major=3), "options": superblock(flags=0x400), "comp": superblock(comp=9), "short": b"hsqs"}
    for name, content in images.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: r for r in headers.read_superblocks(spark, str(tmp_path), strict=False).collect()}
    assert {k: r["error"] for k, r in got.items()} == {"good": None, "magic": "wrong magic", "old": "unsupported version", "options": "compressor options", "comp": "unknown compression", "short": "too short"}
    assert (got["good"]["mtime"], got["good"]["comp"], got["good"]["inode_count"]) == (1700000000, 4, 7)
    with pytest.raises(PySparkException):
        headers.read_superblocks(spark, str(tmp_path)).collect()
    b = headers.read_superblocks(spark, str(tmp_path / "good")).select(F.struct("*").alias("b")).select(headers.header_of(F.col("b"), 1).alias("h")).first()["h"]
    assert (b["ts"], b["comp"], b["flags"], b["tool"]) == (1700000000, 4, 0xC0, 1)


def test_container_round_trip(spark, tmp_path):
    path = str(tmp_path / "d")
    table = spark.createDataFrame([(0, "identical", 0, None, None, None), (1, "modified", 3, 99, 5, bytearray(b"patch")), (2, "identical", 7, None, None, None), (3, "new", None, 40, 0, bytearray(b""))], "ti bigint, status string, si bigint, src_off bigint, src_size bigint, patch binary")
    n = container.write_container(header(), b"man", 40, table, path)
    assert n == 32 + 27 + 8 + 29 + 8 + 24
    got = [(r["ti"], r["kind"], r["si"], r["src_off"], r["src_size"], r["patch"] and bytes(r["patch"])) for r in container.read_container(spark, path).orderBy("ti").collect()]
    assert got == [(-1, "patch", None, 0, 40, b"man"), (0, "identical", 0, None, None, None), (1, "patch", None, 99, 5, b"patch"), (2, "identical", 7, None, None, None), (3, "patch", None, 40, 0, bytearray())]


def test_cut_off_containers_are_errors(spark, tmp_path):
    whole = header() + struct.pack("<qqq", 0, 1, 1) + b"m" + struct.pack("<qqq", 9, 1, 4) + b"1234"
    for cut in (33, 50, len(whole) - 2):
        with pytest.raises(ValueError):
            list(container.walk(io.BytesIO(whole[:cut]), cut))
    assert len(list(container.walk(io.BytesIO(whole), len(whole)))) == 2


def test_table_snapshot_of_odd_rows(spark):
    df = spark.createDataFrame([("b", None), ("a", "ü"), (None, "lost")], "path string, content string")
    s = snapshots.of_table(df)
    assert [(r["idx"], r["path"], r["size"], r["off"]) for r in s.entries.orderBy("idx").collect()] == [(0, "a", 2, 0), (1, "b", 0, 2)]
    empty = snapshots.of_table(df.where("false"))
    assert empty.entries.count() == 0 and empty.payload.count() == 0


def test_pseudo_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """No content comes to the driver, and a plan of a read holds no entry."""
    monkeypatch.setattr("tessera.sources.parts.ROWS", 8)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toLocalIterator", lambda *_, **__: 1 / 0)
    data = [(i, f"d {i}\\x", bytes([i]) * (i * 7 % 50)) for i in range(100)]
    path = str(tmp_path / "many")
    df = spark.createDataFrame([(i, p, bytearray(c)) for i, p, c in reversed(data)], "idx bigint, path string, content binary")
    n = pseudo.write_pseudo(df, path)
    assert n == (tmp_path / "many").stat().st_size and [x.name for x in tmp_path.iterdir()] == ["many"]
    monkeypatch.setattr(pseudo, "TASK_BYTES", 500)
    plan = pseudo._Reader({"path": path}).partitions()
    assert len(plan) > 5 and all(isinstance(x, (int, str)) for p in plan for x in vars(p).values())
    got = [r for p in plan for b in pseudo._Reader({"path": path}).read(p) for r in b.to_pylist()]
    assert [(r["idx"], r["path"], r["content"]) for r in got] == data
    with open(path, "rb") as f:
        assert pseudo.payload_start(path) == pseudo.read_manifest(f)[1]


def test_a_failed_write_leaves_no_parts(spark, tmp_path):
    bad = spark.createDataFrame([(0, "a\nb", bytearray(b"x"))], "idx bigint, path string, content binary")
    with pytest.raises(Exception, match="line feed"):
        pseudo.write_pseudo(bad, str(tmp_path / "bad"))
    assert not list(tmp_path.iterdir())
