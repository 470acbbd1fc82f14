"""Code tables of the formats: compression ids, superblock flags, tools and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The formats define them.
SUPERBLOCK_MAGIC = 0x73717368
DELTA_MAGIC = 0x66707173
XDELTA3_MAGIC = 0x00C4C3D6
FORMAT_VERSION = 1
TOOLS_VERSION = 1
HEADER_SIZE = 32
COMPRESSION = {1: "gzip", 2: "lzma", 3: "lzo", 4: "xz", 5: "lz4", 6: "zstd"}
TOOLS = {0x1: "xdelta3", 0x2: "hdiffz", 0x12: "bsdiff", 0x13: "hdiffz-whole"}
#: The store's labels of the formats 0, 1 and 2.
STORE_LABELS = ("xdelta3", "snap-1-1-xdelta3", "snap-1-1-Hdiffz")
FLAG_CHECK = 0x0004
FLAG_NO_FRAGMENTS = 0x0010
FLAG_DUPLICATES = 0x0040
FLAG_EXPORTS = 0x0080
FLAG_NO_XATTRS = 0x0200
FLAG_COMPRESSOR_OPTIONS = 0x0400
# End of the fixed values.

#: Ids of this engine's own codecs, out of the way of the tools.
OWN_TOOLS = {0x101: "zstd", 0x102: "block", 0x103: "store", 0x111: "zstd-stream", 0x113: "store-stream"}
#: What follows the header of a delta file, by tool: a record for each entry, or one patch of the whole pseudo-files.
FORMS = {0x1: "stream", 0x2: "entries", 0x12: "stream", 0x13: "stream", 0x101: "entries", 0x103: "entries", 0x111: "stream", 0x113: "stream"}


def _lookup(value: Column, table: dict[int, str]) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out


def compression_name(comp: Column) -> Column:
    """The name of a compression id, null if it has none."""
    return _lookup(comp, COMPRESSION)


def tool_name(tool: Column) -> Column:
    return _lookup(tool, TOOLS | OWN_TOOLS)


def store_label(fmt: Column) -> Column:
    """The store's name for a delta format; "unexpected" for any other number."""
    return F.coalesce(_lookup(fmt, dict(enumerate(STORE_LABELS))), F.lit("unexpected"))


def supported_formats(spark: SparkSession) -> DataFrame:
    """(rank, format) from the one preferred to the last resort."""
    return spark.createDataFrame([(i, f) for i, f in enumerate(reversed(STORE_LABELS))], "rank int, format string")


def has_flag(flags: Column, flag: int) -> Column:
    return flags.bitwiseAND(F.lit(flag)) != 0


def unsupported(flags: Column) -> Column:
    """Why an image with these flags can't be rebuilt, or null."""
    return F.when(has_flag(flags, FLAG_CHECK), "unused check flag").when(has_flag(flags, FLAG_COMPRESSOR_OPTIONS), "compressor options")


def rebuild_options(flags: Column) -> Column:
    """The options that rebuild an image with these flags, in order."""
    options = F.array(
        F.when(has_flag(flags, FLAG_NO_FRAGMENTS), "-no-fragments"),
        F.when(~has_flag(flags, FLAG_DUPLICATES), "-no-duplicates"),
        F.when(has_flag(flags, FLAG_EXPORTS), "-exports"),
        F.when(has_flag(flags, FLAG_NO_XATTRS), "-no-xattrs"),
    )
    return F.filter(options, lambda x: x.isNotNull())


def rebuild_arguments(header: Column) -> Column:
    """A delta header as the arguments of an image build: compression, flags and time. An unknown compression and flags of
    images that can't be rebuilt are errors."""
    refused = lambda why: F.raise_error(why).cast("string")
    known = F.coalesce(compression_name(header["comp"]), refused(F.concat(F.lit("unknown compression "), F.coalesce(header["comp"].cast("string"), F.lit("null")))))
    name = F.when(unsupported(header["flags"]).isNotNull(), refused(unsupported(header["flags"]))).otherwise(known)
    return F.concat(F.array(F.lit("-comp"), name), rebuild_options(header["flags"]), F.array(F.lit("-mkfs-time"), header["ts"].cast("string")))
