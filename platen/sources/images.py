"""Image files as a data source: `spark.read.format("platen_images")` gives one row per file, `df.write.format("platen_images")` writes one file per row.

    images.register(spark)
    spark.read.format("platen_images").option("glob", "*.png").load("s3://scans/2024")
    frames.write.format("platen_images").mode("append").save("/shared/out")

PNG (8 bits, grey, RGB or RGBA, not interlaced) and netpbm (P5 and P6) are decoded here, with zlib and numpy. Whatever Arrow's file systems open can be
read. Files are dealt to partitions by their sizes; only their names, sizes and times are listed by the driver.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from platen.operators import bands

NAME = "platen_images"
SCHEMA = "origin string, name string, length long, width int, height int, channels int, data binary"
#: Bytes of files that a partition is given, unless the option partitionBytes says otherwise; a larger file is a partition of its own.
PARTITION_BYTES = 64 << 20
#: Pixels of a file at most (option mostPixels), so that a crafted header can't ask for more memory than a task has.
MOST_PIXELS = 1 << 28
_PNG = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 6: 4}


class BadImage(ValueError):
    pass


def decode(raw: bytes, most: int = MOST_PIXELS) -> np.ndarray:
    """(height, width, channels) of bytes."""
    if raw[:8] == _PNG:
        return _png(raw, most)
    if raw[:2] in (b"P5", b"P6"):
        return _netpbm(raw, most)
    raise BadImage("no PNG or netpbm file")


def _sized(width: int, height: int, most: int) -> None:
    if width < 1 or height < 1 or width * height > most:
        raise BadImage(f"{width} x {height} pixels")


def _netpbm(raw: bytes, most: int) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while raw[at : at + 1].isspace() or raw[at : at + 1] == b"#":
            at = raw.index(b"\n", at) + 1 if raw[at : at + 1] == b"#" else at + 1
        end = at
        while raw[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise BadImage("header cut short")
        fields.append(int(raw[at:end]))
        at = end
    width, height, top = fields
    _sized(width, height, most)
    n = 3 if raw[:2] == b"P6" else 1
    body = raw[at + 1 : at + 1 + width * height * n]
    if top != 255 or len(body) < width * height * n:
        raise BadImage("not 8 bits, or cut short")
    return np.frombuffer(body, np.uint8).reshape(height, width, n)


def _png(raw: bytes, most: int) -> np.ndarray:
    at, packed, head = 8, [], None
    while at + 12 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack(">I", raw[at + 8 + size : at + 12 + size].ljust(4, b"\0"))[0]:
            raise BadImage("a chunk is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise BadImage("another kind of PNG")
    width, height, n = head[0], head[1], _CHANNELS[head[3]]
    _sized(width, height, most)
    try:
        lines = np.frombuffer(zlib.decompressobj().decompress(b"".join(packed), height * (width * n + 1)), np.uint8)
    except zlib.error as e:
        raise BadImage(str(e)) from e
    if len(lines) < height * (width * n + 1):
        raise BadImage("cut short")
    lines = lines.reshape(height, width * n + 1)
    return _unfiltered(lines[:, 0], lines[:, 1:].astype(np.int32).reshape(height, width, n))


def _unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Adds to each line what its filter took off: the pixel before, the line above, their mean, or the nearest of three."""
    out, above = np.zeros(rows.shape, np.uint8), np.zeros(rows.shape[1:], np.int32)
    for y, kind in enumerate(kinds.tolist()):
        line = rows[y]
        if kind == 1:
            line = np.cumsum(line, axis=0) & 255
        elif kind == 2:
            line = (line + above) & 255
        elif kind in (3, 4):
            line, left, corner = line.copy(), np.zeros(rows.shape[2], np.int32), np.zeros(rows.shape[2], np.int32)
            for x in range(len(line)):
                if kind == 3:
                    guess = (left + above[x]) >> 1
                else:
                    p = left + above[x] - corner
                    a, b, c = np.abs(p - left), np.abs(p - above[x]), np.abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[x], corner))
                line[x] = (line[x] + guess) & 255
                left, corner = line[x], above[x]
        elif kind:
            raise BadImage("unknown filter")
        out[y] = above = line
    return out


def encode(pixels: np.ndarray) -> bytes:
    """A PNG file of (height, width, channels) bytes, of 1, 3 or 4 channels."""
    height, width, n = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.zeros((height, width * n + 1), np.uint8)
    lines[:, 1:] = pixels.reshape(height, width * n)
    head = struct.pack(">IIBBBBB", width, height, 8, {v: k for k, v in _CHANNELS.items()}[n], 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def _opened(path: str):
    from pyarrow import fs

    # Arrow's own paths have no scheme; what Hadoop calls file:/a is file:///a elsewhere.
    return fs.FileSystem.from_uri("file://" + path[5:]) if path.startswith("file:/") and not path.startswith("file://") else fs.FileSystem.from_uri(path)


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


class ImageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.bytes, self.most = int(options.get("partitionbytes", PARTITION_BYTES)), int(options.get("mostpixels", MOST_PIXELS))
        self.drop = options.get("dropinvalid", "true").lower() == "true"

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True)) if system.get_file_info(root).type == fs.FileType.Directory else [system.get_file_info(root)]
        files = sorted((f.path, f.size) for f in found if f.is_file and fnmatch(f.base_name, self.glob) and not f.base_name.startswith(("_", ".")))
        out, held = [], 0
        for f in files:
            if not out or held + f[1] > self.bytes:
                out.append([])
                held = 0
            out[-1].append(f)
            held += f[1]
        return [Files(x) for x in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _opened(self.path)
        for path, size in partition.paths:
            with system.open_input_stream(path) as f:
                raw = f.read()
            try:
                image = decode(raw, self.most)
            except (BadImage, ValueError, struct.error) as e:
                if self.drop:
                    continue
                raise BadImage(f"{path}: {e}") from e
            yield path, path.rsplit("/", 1)[-1], size, image.shape[1], image.shape[0], image.shape[2], image.tobytes()


class ImageWriter(DataSourceWriter):
    """Files are named by their rows, so a task that runs again writes the same ones."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        for r in rows:
            image = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])
            with system.open_output_stream(f"{root}/{r['name']}") as f:
                f.write(encode(image))
        return WriterCommitMessage()


class ImageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ImageReader:
        return ImageReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ImageWriter:
        if overwrite:
            raise ValueError("images are only appended: write to a folder of your own")
        return ImageWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageSource)


def image_scan(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """One row per image file under path that can be decoded (all others are dropped; with dropInvalid=false they are an error): origin, name, length, width, height, channels, data (bytes, row by row)."""
    register(spark)
    return spark.read.format(NAME).options(**options).load(path)


def as_pixels(images: DataFrame, *keys: str) -> DataFrame:
    """(keys, y, x, r, g, b): a row for each pixel, whole images one at a time in a task; grey images have three equal channels, alpha is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                width, height, n = (row.column(c)[0].as_py() for c in ("width", "height", "channels"))
                p = np.frombuffer(row.column("data")[0].as_py(), np.uint8).reshape(-1, n)
                rgb = p[:, [0, 0, 0]] if n == 1 else p[:, :3]
                y, x = np.divmod(np.arange(height * width, dtype=np.int32), np.int32(width))
                at = pa.array(np.zeros(len(y), np.int32))
                yield pa.RecordBatch.from_arrays([*(row.column(c).take(at) for c in keys), pa.array(y), pa.array(x), *(pa.array(rgb[:, c].astype(np.int32)) for c in range(3))], [*keys, "y", "x", "r", "g", "b"])

    kinds = {f.name: f.dataType.simpleString() for f in images.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "y int", "x int", "r int", "g int", "b int"])
    return images.select(*keys, "width", "height", "channels", "data").mapInArrow(run, schema)


def packed_pixels(pixels: DataFrame, key: str, width: int) -> DataFrame:
    """(name, width, height, channels, data): grey images of whole rows from pixels or runs (key, a whole number, y, x, v), each for a file `key.png`. A task holds one image at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                y, _, v, _ = bands.unpacked(pa.Table.from_batches(held))
                n = np.bincount(y)
                data = v[(n == width)[y]].astype(np.int64).astype(np.uint8).tobytes()
                if data:
                    yield pa.RecordBatch.from_arrays([pa.array([f"{now}.png"]), pa.array([width], pa.int32()), pa.array([len(data) // width], pa.int32()), pa.array([1], pa.int32()), pa.array([data], pa.binary())], ["name", "width", "height", "channels", "data"])

        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, z in zip(starts, starts[1:], strict=False):
                if z > a:
                    if own[a] != now:
                        yield from done()
                        held, now = [], own[a]
                    held.append(b.slice(a, z - a))
        yield from done()

    ordered = bands.runs(pixels, (key,)).repartition(key).sortWithinPartitions(key, "y", "x")
    return ordered.mapInArrow(run, "name string, width int, height int, channels int, data binary")
