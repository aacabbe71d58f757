"""Image files as tables: headers and tags by SQL functions on the bytes, pixels as rows of a frame.

What a query does not ask for is not done: headers and tags never decode pixels, and files that cannot be read are rows with a reason.
PNG (8 or 16 bits, gray or colour, not interlaced) and uncompressed TIFF in strips (8 or 16 bits, first page) are decoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: TIFF tags that decoding needs, the bytes of a value by type, and the samples of PNG colour types.
HEIGHT, WIDTH, BITS, COMPRESSION, DESCRIPTION, STRIPS, SAMPLES, STRIP_BYTES, PLANAR, DATE_TIME = 257, 256, 258, 259, 270, 273, 277, 279, 284, 306
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}
PNG_SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
#: Weights of red, green and blue in a gray plane.
GRAY = (0.2125, 0.7154, 0.0721)
PLANES = ("gray", "first", "red", "green", "blue", "mean")


def image_files(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of all files below a folder; Spark reads ``content`` only where a query uses it.

    Spark leaves files of length 0 out, so what names one finds no file.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)


def _number(at: Column, size: int, little: Column) -> Column:
    """The unsigned number of so many bytes from place ``at`` (from 0) of ``content``."""
    big = F.hex(F.expr("content").substr((at + 1).cast("int"), F.lit(size)))
    pairs = [F.substring(big, 2 * i + 1, 2) for i in range(size)]
    return F.conv(F.when(little, F.concat(*reversed(pairs))).otherwise(big), 16, 10).cast("long")


def headers(files: DataFrame) -> DataFrame:
    """``files`` with kind (png, tiff or null), little, height, width, bits, samples and ``tags``, an array of (tag, type, count, at)."""
    head = lambda n: F.hex(F.substring("content", 1, n))
    png, tiff = head(8) == "89504E470D0A1A0A", head(4).isin("49492A00", "4D4D002A")
    f = files.withColumn("kind", F.when(png, "png").when(tiff, "tiff")).withColumn("little", head(2) == "4949")
    start, little = F.when(F.col("kind") == "tiff", _number(F.lit(4), 4, F.col("little"))), F.col("little")
    f = f.withColumn("_ifd", start).withColumn("_n", F.coalesce(_number(F.col("_ifd"), 2, little), F.lit(0)))
    entry = lambda i: F.col("_ifd") + 2 + 12 * i
    size = F.create_map(*(F.lit(x) for kv in SIZES.items() for x in kv))

    def tag(i: Column) -> Column:
        kind, count = _number(entry(i) + 2, 2, little), _number(entry(i) + 4, 4, little)
        inline = F.coalesce(size[kind.cast("int")] * count <= 4, F.lit(True))
        return F.struct(_number(entry(i), 2, little).cast("int").alias("tag"), kind.cast("int").alias("type"), count.alias("count"), F.when(inline, entry(i) + 8).otherwise(_number(entry(i) + 8, 4, little)).alias("at"))

    f = f.withColumn("tags", F.when(F.col("_n") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), tag)))
    is_png, big = F.col("kind") == "png", F.lit(False)
    colours = F.create_map(*(F.lit(x) for kv in PNG_SAMPLES.items() for x in kv))
    return f.withColumns(
        {
            "height": F.when(is_png, _number(F.lit(20), 4, big)).otherwise(first_value(HEIGHT)),
            "width": F.when(is_png, _number(F.lit(16), 4, big)).otherwise(first_value(WIDTH)),
            "bits": F.when(is_png, _number(F.lit(24), 1, big)).otherwise(F.coalesce(first_value(BITS), F.when(F.col("kind") == "tiff", 1))),
            "samples": F.when(is_png, colours[_number(F.lit(25), 1, big).cast("int")]).otherwise(F.coalesce(first_value(SAMPLES), F.when(F.col("kind") == "tiff", 1))).cast("long"),
        }
    ).drop("_ifd", "_n")


def values(tag: int) -> Column:
    """All whole numbers of a tag, or null where a file lacks it; needs the columns of ``headers``."""
    t = F.get(F.filter("tags", lambda x: x["tag"] == tag), F.lit(0))
    each = lambda size: F.transform(F.sequence(F.lit(0).cast("long"), t["count"] - 1), lambda j: _number(t["at"] + j * size, size, F.col("little")))
    return F.when(t["count"] > 0, F.when(t["type"] == 3, each(2)).when(t["type"] == 4, each(4)).when(t["type"] == 1, each(1)))


def first_value(tag: int) -> Column:
    return F.get(values(tag), F.lit(0))


def text_value(tag: int) -> Column:
    """A tag's text, up to its end mark."""
    t = F.get(F.filter("tags", lambda x: (x["tag"] == tag) & (x["type"] == 2)), F.lit(0))
    return F.rtrim(F.expr("content").substr((t["at"] + 1).cast("int"), t["count"].cast("int")).cast("string"), F.lit("\0"))


def metadata(files: DataFrame) -> DataFrame:
    """(path, kind, height, width, bits, samples, description, ome_xml, date_time, tags): one row per file, ``tags`` without the description's.

    Files of other kinds have a null kind.  A description that is OME-XML counts as ``ome_xml`` as well; the date is that of the
    camera's clock, without a time zone.
    """
    h = headers(files)
    told = text_value(DESCRIPTION)
    return h.select(
        "path", "kind", "height", "width", "bits", "samples", told.alias("description"), F.when(told.contains("<OME"), told).alias("ome_xml"),
        F.try_to_timestamp(text_value(DATE_TIME), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz").alias("date_time"), F.filter("tags", lambda x: x["tag"] != DESCRIPTION).alias("tags"),
    )


def readable(h: DataFrame) -> DataFrame:
    """``headers`` with ``reason``: why a file cannot be decoded, or null."""
    tiff = F.col("kind") == "tiff"
    reason = (
        F.when(F.col("kind").isNull(), "neither PNG nor TIFF")
        .when(F.col("height").isNull() | F.col("width").isNull() | (F.col("height") * F.col("width") <= 0), "no size")
        .when(~F.col("bits").isin(8, 16), "neither 8 nor 16 bits")
        .when(tiff & (F.coalesce(first_value(COMPRESSION), F.lit(1)) != 1), "compressed TIFF")
        .when(tiff & (F.coalesce(first_value(PLANAR), F.lit(1)) != 1), "planes apart")
        .when(tiff & (values(STRIPS).isNull() | values(STRIP_BYTES).isNull()), "no strips")
        .when((F.col("kind") == "png") & (_number(F.lit(28), 1, F.lit(False)) != 0), "interlaced PNG")
        .when(F.coalesce(F.col("samples"), F.lit(0)) < 1, "no samples")
    )
    return h.withColumn("reason", reason)


def _png(data: bytes, height: int, row: int, step: int) -> np.ndarray:
    """Unfiltered bytes of a PNG's rows; ``step``: bytes of a pixel."""
    at, parts = 8, []
    while at + 8 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += n + 12
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, row + 1)
    out = np.zeros((height + 1, row + step), np.uint8)
    for r in range(height):
        kind, line, up, own = raw[r, 0], raw[r, 1:], out[r], out[r + 1]
        if kind in (0, 2):
            own[step:] = line + up[step:] if kind else line
        elif kind == 1:
            for k in range(step):  # sums of every pixel before, byte by byte
                own[step + k :: step] = np.cumsum(line[k::step], dtype=np.uint64).astype(np.uint8)
        else:
            for i in range(row):
                a, b, c = int(own[i]), int(up[i + step]), int(up[i])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                own[i + step] = (int(line[i]) + guess) & 255
    return out[1:, step:]


def decode(files: DataFrame) -> DataFrame:
    """(path, height, width, samples, r, v, reason): a row for each row of pixels, ``v`` holding an array of doubles for each sample.

    A file that cannot be decoded gives one row with its reason and without pixels.  Files are decoded one at a time; values are as stored.
    """
    h = readable(headers(files))
    h = h.select("path", "kind", "little", "height", "width", "bits", "samples", "reason", values(STRIPS).alias("starts"), values(STRIP_BYTES).alias("lengths"), F.when(F.col("reason").isNull(), F.col("content")).alias("content"))

    def rows(f) -> pd.DataFrame:
        height, width, samples, size = int(f.height), int(f.width), int(f.samples), int(f.bits) // 8
        if f.kind == "png":
            a, order = _png(f.content, height, width * samples * size, samples * size).tobytes(), ">"
        else:
            a, order = b"".join(f.content[s : s + n] for s, n in zip(f.starts, f.lengths)), "<" if f.little else ">"
        v = np.frombuffer(a, f"{order}u{size}")[: height * width * samples].reshape(height, width, samples).astype(float)
        return pd.DataFrame({"path": f.path, "height": height, "width": width, "samples": samples, "r": range(height), "v": [list(x.T) for x in v], "reason": None})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for f in b.itertuples():
                reason = f.reason
                if reason is None:
                    try:
                        yield rows(f)
                    except (ValueError, zlib.error) as e:  # a file that breaks off is a row, not the end of the job
                        reason = f"broken file: {e}"
                if reason is not None:
                    yield pd.DataFrame([(f.path, None, None, None, None, None, reason)], columns=["path", "height", "width", "samples", "r", "v", "reason"])

    return h.mapInPandas(run, "path string, height long, width long, samples long, r long, v array<array<double>>, reason string")


def plane(rows: DataFrame, method: str | None = None) -> DataFrame:
    """(path, height, width, r, v): decoded rows with one array of values each.

    A frame of one sample is its own plane.  One of several needs a ``method`` (one of ``PLANES``): there is no default, as which colour carries a
    signal is a choice that must be made.
    """
    if method is not None and method not in PLANES:
        raise ValueError(f"method must be one of {PLANES}, not {method!r}")
    good = rows.where("reason IS NULL")
    if method is None and not good.where("samples > 1").isEmpty():
        raise ValueError(f"frames with several samples need a method, one of {PLANES}")
    v = lambda i: F.get("v", F.lit(i))
    summed = lambda ws: F.zip_with(F.zip_with(v(0), v(1), lambda a, b: a * ws[0] + b * ws[1]), v(2), lambda s, c: s + c * ws[2])
    made = {"gray": lambda: summed(GRAY), "mean": lambda: summed((1 / 3, 1 / 3, 1 / 3)), "first": lambda: v(0), "red": lambda: v(0), "green": lambda: v(1), "blue": lambda: v(2)}
    value = F.when(F.col("samples") < 3, v(0)).otherwise(made[method or "first"]())
    return good.select("path", "height", "width", "r", value.alias("v"))


def long_pixels(planes: DataFrame) -> DataFrame:
    """(path, r, c, v): one row per pixel."""
    return planes.select("path", "r", F.posexplode("v").alias("c", "v")).withColumn("c", F.col("c").cast("long"))
