"""Heat maps of matrices as a pyramid of PNG tiles.

Two aggregates: the least and greatest value of each matrix, which the colours span, and the greatest value of the cells
behind each pixel, at every level of zoom (level z shows 2**z by 2**z cells as one pixel). Pixels meet by tile, SIDE by
SIDE at most, and a tile becomes an image where it is; nothing larger than a tile is ever in one place.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 256


def palette() -> np.ndarray:
    """256 colours from dark blue over green to red."""
    x = np.arange(256) / 255
    ramp = lambda low, high: np.clip((x - low) / (high - low), 0, 1)
    return (np.stack([ramp(0.5, 0.8), np.minimum(ramp(0.1, 0.5), 1 - ramp(0.75, 1)), 0.4 + 0.6 * ramp(0, 0.2) - ramp(0.4, 0.7)], axis=1).clip(0, 1) * 255).astype(np.uint8)


def png(pixels: np.ndarray, colours: np.ndarray) -> bytes:
    """An image of palette indexes, 8 bits each."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.concatenate([np.zeros((len(pixels), 1), np.uint8), pixels], axis=1).tobytes()  # no filter
    head = struct.pack(">IIBBBBB", pixels.shape[1], len(pixels), 8, 3, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"PLTE", colours.tobytes()) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    colours = palette()
    for batch in batches:
        out = []
        for pixels in batch.column("pixels").to_pylist():
            y, x, v = (np.array([p[c] for p in pixels], np.int64) for c in ("y", "x", "v"))
            image = np.zeros((int(y.max()) + 1, int(x.max()) + 1), np.uint8)
            image[y, x] = v
            out.append(png(image, colours))
        names = ["_key", "zoom", "tile_y", "tile_x"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out, pa.binary())], names=[*names, "png"])


def pixels(cells: DataFrame, value: Column, levels: int, key: str = "seq_id") -> DataFrame:
    """key, zoom, y, x, value of each pixel: the greatest value behind it."""
    own = cells.select(F.col(key).alias("_key"), "seq", "prf", value.alias("value")).where("value is not null")
    zoom = own.withColumn("zoom", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    at = lambda c: F.expr(f"shiftright({c}, zoom)").alias({"seq": "y", "prf": "x"}[c])
    return zoom.groupBy("_key", "zoom", at("seq"), at("prf")).agg(F.max("value").alias("value"))


def tiles(cells: DataFrame, value: Column | None = None, levels: int = 1, side: int = SIDE, key: str = "seq_id", floor: int | None = None) -> DataFrame:
    """key, zoom, tile_y, tile_x, png of the matrices whose cells (key, seq, prf and states) are given.

    value: by default the match score. The colours of a matrix span its values, or floor and more where floor is given;
    a matrix of one value has the first colour. Null values leave their pixel in the first colour.
    """
    value = F.col("match") if value is None else value
    own = cells.select(F.col(key).alias("_key"), (value if floor is None else F.greatest(value, F.lit(floor))).alias("v"))
    span = own.groupBy("_key").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    found = pixels(cells, value if floor is None else F.greatest(value, F.lit(floor)), levels, key).join(span, "_key")
    colour = F.when(F.col("high") > F.col("low"), F.floor((F.col("value") - F.col("low")) * 255 / (F.col("high") - F.col("low")))).otherwise(0)
    pixel = F.struct((F.col("y") % side).alias("y"), (F.col("x") % side).alias("x"), colour.cast("int").alias("v"))
    by_tile = found.groupBy("_key", "zoom", F.floor(F.col("y") / side).cast("int").alias("tile_y"), F.floor(F.col("x") / side).cast("int").alias("tile_x")).agg(F.collect_list(pixel).alias("pixels"))
    kind = cells.schema[key].dataType.simpleString()
    return by_tile.mapInArrow(_images, f"_key {kind}, zoom int, tile_y int, tile_x int, png binary").withColumnRenamed("_key", key)
