import struct

import pytest
from pyspark.errors import PySparkException

from tessera.operators import codec, images
from tessera.plans import api

IMAGES = "name string, content binary"


def image(body, flags=0, magic=0x73717368, major=4):
    return bytearray(struct.pack("<IIIIIHHHHHH", magic, 1, 1700000000, 131072, 0, 4, 17, flags, 1, major, 0) + body)


def test_round_trip_of_new_changed_and_plain_images(spark, tmp_path):
    source = spark.createDataFrame([("a", image(b"one" * 50)), ("gone", image(b"x"))], IMAGES)
    target = [("a", image(b"one" * 50 + b"!")), ("new", image(b"", 0x0040)), ("options", image(b"z", 0x0400))]
    made = images.generate(source, spark.createDataFrame(target, IMAGES), on_unsupported="plain")
    made.write.parquet(f"{tmp_path}/delta")
    made = spark.read.parquet(f"{tmp_path}/delta")
    assert {r["name"]: (r["kind"], bytes(r["delta"][:4]) == b"sqpf") for r in made.collect()} == {"a": ("container", True), "new": ("container", True), "options": ("plain", False)}
    got = {r["name"]: (bytes(r["content"]), r["arguments"]) for r in images.apply(made, source).collect()}
    assert {k: v for k, (v, _) in got.items()} == {k: bytes(v) for k, v in target}
    assert got["a"][1] == ["-comp", "xz", "-no-duplicates", "-mkfs-time", "1700000000"] and got["options"][1] is None
    assert got["new"][1] == ["-comp", "xz", "-mkfs-time", "1700000000"]
    with pytest.raises(PySparkException, match="another codec"):
        images.apply(made, source, "store").collect()


@pytest.mark.parametrize("bad", [image(b"", 0x0400), image(b"", 0x0004), image(b"", magic=1), image(b"", major=3), bytearray(b"short"), bytearray()])
def test_bad_images_are_errors(spark, bad):
    one = spark.createDataFrame([("a", bad)], IMAGES)
    with pytest.raises(PySparkException):
        images.generate(one, one).collect()
    if bad[24:26] != b"\x00\x04":
        with pytest.raises(PySparkException):
            images.generate(one, one, on_unsupported="plain").collect()


def test_images_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.img").write_bytes(image(b"old"))
    (tmp_path / "b.img").write_bytes(image(b"newer"))
    assert [r["name"] for r in images.read_images(spark, str(tmp_path)).orderBy("name").collect()] == ["a.img", "b.img"]
    api.generate_images(spark, str(tmp_path / "a.img"), str(tmp_path / "b.img"), str(tmp_path / "delta"), "store", name="image")
    assert bytes(api.apply_images(spark, str(tmp_path / "a.img"), str(tmp_path / "delta"), "image").first()["content"]) == bytes(image(b"newer"))
    source, target = (images.read_images(spark, f"{tmp_path}/{n}.img", "image") for n in "ab")
    assert bytes(images.apply(images.generate(source, target), source).first()["content"]) == bytes(image(b"newer"))
    assert images.generate(source, target.where("false")).count() == 0
    with pytest.raises(ValueError):
        images.generate(source, target, on_unsupported="skip")


def test_a_tool_that_fails_its_probe_does_not_work(tmp_path):
    tool = tmp_path / "hdiffz"
    tool.write_text('#!/bin/sh\n[ "$1" = -v ]\n')
    tool.chmod(0o755)
    assert codec.works(str(tool)) and not codec.works("no-such-tool")
    tool.write_text("#!/bin/sh\nexit 3\n")
    assert not codec.works(str(tool))
