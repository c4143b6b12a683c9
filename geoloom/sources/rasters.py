"""GeoTIFF files as a data source, by blocks: `spark.read.format("geotiff")` and `df.write.format("geotiff")`.

Reading plans tasks of about PART_BYTES each. Files that fit are dealt whole, by their sizes alone;
of larger ones only the header is read while planning, and their strips or tiles are dealt. A box
(the option `box`; with spark.sql.python.filterPushdown.enabled and the option `filters`, both of which
read_rasters looks after, also filters on x and y) leaves out blocks that lie outside, so that of a file only
the header and the blocks that meet the box are read, also inside archives (`.zip`). Cells come as
path, row, col, x, y (the cell's centre) and value; NoData is null.

Writing makes a raster of any size a set of files of SIDE x SIDE cells, each from the rows of one
task, in tiles. Tasks write hidden files, which the driver names when all tasks are done, so a
lost executor leaves nothing. No raster is ever in one place.

Cases: a raster without cells makes no file; a cell that is given twice has the value that comes last in the
order of values; cells without a value become NoData, and so do cells that are not given; files that are no TIFF and
compressions, predictors and samples that are not known end the read with an error that names the file; an empty folder has
no rows; the number of rows of the whole raster is not stored, each file has its own extent.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from geoloom.operators.raster import Grid
from geoloom.sources import files, formats, geotiff

NAME, SUFFIXES = "geotiff", (".tif", ".tiff")
#: Bytes of files that a task reads, about; cells on a side of a written file.
PART_BYTES, SIDE = 32 << 20, 1024
CELLS = "path string, row long, col long, x double, y double, value float"
#: What the writer is given: the raster's name and georeference, the place of the file in the raster, and the cell.
WRITTEN = ["raster", "origin_x", "origin_y", "pixel", "file_row", "file_col", "row", "col", "value"]
#: Without a box: every place.
EVERYWHERE = (-np.inf, -np.inf, np.inf, np.inf)

Box = tuple[float, float, float, float]


def parsed_box(text: str | None) -> Box:
    if not text:
        return EVERYWHERE
    box = tuple(float(x) for x in text.split(","))
    if len(box) != 4 or not (box[0] <= box[2] and box[1] <= box[3]):
        raise ValueError("a box is min_x, min_y, max_x, max_y")
    return box


def meets(meta: dict, block: geotiff.Block, box: Box) -> bool:
    """Whether the block has a cell whose centre is in the box."""
    p = meta["pixel"]
    x0, y1 = meta["origin_x"] + (block.col + 0.5) * p, meta["origin_y"] - (block.row + 0.5) * p
    x1, y0 = x0 + (block.cols - 1) * p, y1 - (block.rows - 1) * p
    return x0 <= box[2] and x1 >= box[0] and y0 <= box[3] and y1 >= box[1]


@dataclass(frozen=True)
class Piece:
    """A file (or archive) to be read whole, or some blocks of a file."""

    path: str
    entry: tuple[int, int, int, int] | None = None
    stored: geotiff.Layout | None = None
    blocks: tuple[geotiff.Block, ...] = ()


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


def entries(path: str, size: int) -> list[tuple[str, tuple[int, int, int, int], int]]:
    """(path, entry, size) of the rasters in an archive."""
    return [(f"{path}{files.ENTRY}{name}", (packed, plain, method, header), plain) for name, packed, plain, method, header in formats.read_directory(path, size) if name.lower().endswith(SUFFIXES)]


def _named(path: str, f, *args):
    try:
        return f(*args)
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from e


def planned(found: list[tuple[str, int]], box: Box, part_bytes: int) -> list[Pieces]:
    """Tasks for files (path, size)."""
    tasks, now, held = [], [], 0

    def deal(piece: Piece, size: int) -> None:
        nonlocal now, held
        now.append(piece)
        held += size
        if held >= part_bytes:
            tasks.append(Pieces(now))
            now, held = [], 0

    def raster(path: str, entry, size: int) -> None:
        # What is deflated can only be read from its beginning, so its blocks stay together.
        if size <= part_bytes or (entry and entry[2] == 8):
            return deal(Piece(path, entry), size)
        source = files.opened(path, entry)
        stored, blocks = _named(path, geotiff.layout, source)
        source.close()
        own, n = [], 0
        for b in blocks:
            if meets(stored.meta, b, box):
                own.append(b)
                n += b.size
            if own and (n >= part_bytes or b is blocks[-1]):
                deal(Piece(path, entry, stored, tuple(own)), n)
                own, n = [], 0

    for path, size in found:
        if path.lower().endswith(".zip") and size > part_bytes:
            for x in entries(path, size):
                raster(*x)
        elif path.lower().endswith(".zip"):
            deal(Piece(path), size)
        else:
            raster(path, None, size)
    return [*tasks, Pieces(now)] if now or not tasks else tasks


def _cells(path: str, entry, stored, blocks, box: Box):
    """Batches of the cells in the box."""
    source = files.opened(path, entry)
    try:
        if stored is None:
            stored, blocks = _named(path, geotiff.layout, source)
            blocks = [b for b in blocks if meets(stored.meta, b, box)]
        p, x0, y0 = stored.meta["pixel"], stored.meta["origin_x"], stored.meta["origin_y"]
        for b in sorted(blocks, key=lambda b: b.at):
            cells = _named(path, stored.decode, source.read(b.at, b.size), b)
            step = max(1, (1 << 17) // b.cols)
            for r in range(0, b.rows, step):
                part = cells[r : r + step]
                rows, cols = (i.ravel() for i in np.indices(part.shape, dtype=np.int64))
                rows, cols = rows + b.row + r, cols + b.col
                x, y, values = x0 + (cols + 0.5) * p, y0 - (rows + 0.5) * p, part.ravel()
                if box != EVERYWHERE:
                    keep = (x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3])
                    rows, cols, x, y, values = (v[keep] for v in (rows, cols, x, y, values))
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path), len(rows)), pa.array(rows), pa.array(cols), pa.array(x), pa.array(y), pa.array(values, from_pandas=True)],
                                                     ["path", "row", "col", "x", "y", "value"])
    finally:
        source.close()


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.box, self.part_bytes = options["path"], parsed_box(options.get("box")), int(options.get("partbytes", PART_BYTES))

    def partitions(self):
        return planned(files.listed(self.path, (*SUFFIXES, ".zip")), self.box, self.part_bytes)

    def read(self, partition):
        for x in partition.pieces:
            if x.path.lower().endswith(".zip") and x.entry is None:
                source = files.opened(x.path)
                size = source.size
                source.close()
                for path, entry, _ in entries(x.path, size):
                    yield from _cells(path, entry, None, (), self.box)
            else:
                yield from _cells(x.path, x.entry, x.stored, x.blocks, self.box)


class FilteringReader(GeoTiffReader):
    """For sessions in which Spark hands filters to Python sources."""

    def pushFilters(self, filters):
        """Bounds on x and y narrow the box; Spark checks all filters again."""
        low, high = list(self.box[:2]), list(self.box[2:])
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("x",), ("y",)):
                k = "xy".index(f.attribute[0])
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    low[k] = max(low[k], float(f.value))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    high[k] = min(high[k], float(f.value))
            yield f
        self.box = (*low, *high)


@dataclass
class Done(WriterCommitMessage):
    moves: list[tuple[str, str]]


class GeoTiffWriter(DataSourceArrowWriter):
    """Rows of a file come one after the other."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.side, self.nodata = int(options.get("side", SIDE)), float(options.get("nodata", "-9999"))
        self.epsg = int(options["epsg"]) if options.get("epsg") else None
        self.packed = options.get("compression", "deflate") == "deflate"
        # Of rasters whose size is known, files have it; a raster that is one file may have its name.
        self.height, self.width = (int(options[k]) if options.get(k) else None for k in ("height", "width"))
        self.file = options.get("file")

    def _extent(self, file_row: int, file_col: int, seen: tuple[int, int]) -> tuple[int, int]:
        whole = zip((self.height, self.width), (file_row, file_col), seen)
        return tuple(n if total is None else max(0, min(self.side, total - at * self.side)) for total, at, n in whole)

    def write(self, batches):
        moves, name, grid, seen, place = [], None, None, (0, 0), ()

        def finish():
            if name is None:
                return
            raster, file_row, file_col = name
            origin_x, origin_y, pixel = place
            x, y = origin_x + file_col * self.side * pixel, origin_y - file_row * self.side * pixel
            temp = files.hidden(self.folder, self.job)
            h, w = self._extent(file_row, file_col, seen)
            files.write(temp, geotiff.encode_tiled(grid[:h, :w], x, y, pixel, self.nodata, self.epsg, packed=self.packed))
            moves.append((temp, f"{self.folder}/{self.file or f"{quote(raster, safe='')}_{file_row}_{file_col}.tif"}"))

        for batch in batches:
            if not batch.num_rows:
                continue
            raster, fr, fc = batch.column("raster"), *(batch.column(c).to_numpy() for c in ("file_row", "file_col"))
            names = raster.dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(codes) != 0) | (np.diff(fr) != 0) | (np.diff(fc) != 0)) + 1
            rows, cols = batch.column("row").to_numpy() % self.side, batch.column("col").to_numpy() % self.side
            values = batch.column("value").to_numpy(zero_copy_only=False).astype(np.float32)
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                own = (names.dictionary[int(codes[a])].as_py(), int(fr[a]), int(fc[a]))
                if own != name:
                    finish()
                    # No more than the file has: a long and narrow raster that is one file is no square.
                    name, grid, seen = own, np.full(self._extent(own[1], own[2], (self.side, self.side)), np.nan, np.float32), (0, 0)
                    place = tuple(batch.column(c)[int(a)].as_py() for c in ("origin_x", "origin_y", "pixel"))
                inside = (rows[a:b] < grid.shape[0]) & (cols[a:b] < grid.shape[1])
                grid[rows[a:b][inside], cols[a:b][inside]] = values[a:b][inside]
                seen = (max(seen[0], int(rows[a:b].max()) + 1), max(seen[1], int(cols[a:b].max()) + 1))
        finish()
        return Done(moves)

    def commit(self, messages):
        if self.overwrite:
            files.clear(self.folder, SUFFIXES)
        files.publish([m for done in messages if done is not None for m in done.moves])
        files.discard(self.folder, self.job)

    def abort(self, messages):
        files.discard(self.folder, self.job)


class GeoTiff(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return CELLS

    def reader(self, schema):
        options = {k.lower(): v for k, v in self.options.items()}
        return (FilteringReader if options.get("filters") == "true" else GeoTiffReader)(options)

    def writer(self, schema, overwrite):
        if [f.name for f in schema.fields] != WRITTEN:
            raise ValueError(f"the columns have to be {', '.join(WRITTEN)}; write_rasters makes them")
        return GeoTiffWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiff)


def read_rasters(spark: SparkSession, path: str, box: Box | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """path, row, col, x, y and value of the cells (in the box) of all rasters at or below a path, archives included."""
    register(spark)
    found = spark.read.format(NAME).option("partBytes", part_bytes).option("filters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (found.option("box", ",".join(repr(float(v)) for v in box)) if box else found).load(path)


def write_rasters(cells: DataFrame, path: str, origin_x: float, origin_y: float, pixel: float, raster: str | None = None, side: int = SIDE, nodata: float = -9999.0, epsg: int | None = None, packed: bool = True, mode: str = "append", extra: dict | None = None) -> None:
    """Writes cells (row, col, value) below a folder; raster is the column that names their raster, without it there is one. The origin is that of row 0 and column 0 of each."""
    if side % 256:
        raise ValueError("the side of a file is a multiple of 256 cells")
    register(cells.sparkSession)
    name = F.coalesce(F.col(raster).cast("string"), F.lit("null")) if raster else F.lit("raster")
    place = {"origin_x": origin_x, "origin_y": origin_y, "pixel": pixel}
    rows = cells.select(name.alias("raster"), *(F.lit(float(v)).alias(c) for c, v in place.items()), *(F.floor(F.col(c) / side).cast("int").alias(f"file_{c}") for c in ("row", "col")),
                        F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("float").alias("value"))
    files_ = ["raster", "file_row", "file_col"]
    ordered = rows.repartition(*files_).sortWithinPartitions(*files_, "row", "col", "value")
    options = ordered.write.format(NAME).options(**(extra or {})).option("side", side).option("nodata", repr(nodata)).option("compression", "deflate" if packed else "none")
    (options.option("epsg", epsg) if epsg else options).mode(mode).save(path)


def _marked(mask: DataFrame, cells: DataFrame) -> DataFrame:
    """cells with the value 1 where they are in the mask, else 0. The mask may be as large as the raster, however small its files are, so it meets the cells by a shuffle."""
    inside = mask.select("row", "col").distinct().withColumn("value", F.lit(1.0))
    return cells.select("row", "col").join(inside.hint("merge"), ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def write_mask(mask: DataFrame, cells: DataFrame, path: str, origin_x: float, origin_y: float, pixel: float, **options) -> None:
    """A set of cells (row, col) as a raster of 1 inside and 0 outside; cells: all cells of the raster."""
    write_rasters(_marked(mask, cells), path, origin_x, origin_y, pixel, nodata=-1.0, **options)


#: Cells of a raster that is saved as one file, at most; a larger one becomes a folder of files.
ONE_FILE = 25_000_000


def save_grid(cells: DataFrame, grid: Grid, path: str, nodata: float = -9999.0, epsg: int | None = None, one_file: int = ONE_FILE) -> list[str]:
    """Writes a raster (row, col, value; cells that are not given are NoData) as the file `path`, or as a folder of files named like it. Returns the paths."""
    corner = cells.sparkSession.createDataFrame([(0, 0, None)], "row long, col long, value float")
    inside = F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1)
    rows = cells.filter(inside).select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("float"))
    single = grid.width * grid.height <= one_file
    side = -(-max(grid.width, grid.height) // 256) * 256 if single else SIDE
    folder, _, name = path.rpartition("/")
    extra = {"height": grid.height, "width": grid.width, **({"file": name} if single else {})}
    folder = folder if single else path.rpartition(".")[0]
    # A given value comes behind a missing one.
    write_rasters(rows.unionByName(corner), folder, grid.origin_x, grid.origin_y, grid.pixel, side=side, nodata=nodata, epsg=epsg, extra=extra)
    return [path] if single else [p for p, _ in files.listed(folder, SUFFIXES)]


def save_mask(mask: DataFrame, grid: Grid, path: str, epsg: int | None = None, one_file: int = ONE_FILE) -> list[str]:
    """A set of cells as a raster of 1 inside and 0 outside."""
    return save_grid(_marked(mask, grid.cells(mask.sparkSession)), grid, path, nodata=-1.0, epsg=epsg, one_file=one_file)


def _headers(batches):
    for batch in batches:
        rows = []
        for path, entry in zip(batch.column("path").to_pylist(), batch.column("entry").to_pylist()):
            source = files.opened(path, tuple(entry) if entry else None)
            rows.append({"path": path, **_named(path, geotiff.metadata, source)})
            source.close()
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
        names = [f.split()[0] for f in geotiff.META.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, origin, pixel, NoData and EPSG of all rasters at or below a path; only headers are read, by tasks."""
    found = []
    for name, size in files.listed(path, (*SUFFIXES, ".zip")):
        found += [(p, list(e)) for p, e, _ in entries(name, size)] if name.lower().endswith(".zip") else [(name, None)]
    deal = spark.createDataFrame(found, "path string, entry array<long>")
    return deal.repartition(max(1, min(len(found), 1 + len(found) // 64))).mapInArrow(_headers, geotiff.META)


def grid_of(spark: SparkSession, path: str, box: Box | None = None) -> Grid:
    """The grid that all rasters at or below a path (those that meet the box) lie on."""
    rows = read_headers(spark, path)
    right, bottom = F.col("origin_x") + F.col("width") * F.col("pixel"), F.col("origin_y") - F.col("height") * F.col("pixel")
    if box:
        rows = rows.filter((F.col("origin_x") <= box[2]) & (right >= box[0]) & (bottom <= box[3]) & (F.col("origin_y") >= box[1]))
    one = rows.agg(F.min("pixel").alias("p"), F.max("pixel").alias("q"), F.min("origin_x").alias("x0"), F.max("origin_y").alias("y1"), F.max(right).alias("x1"), F.min(bottom).alias("y0")).first()
    if one["p"] is None:
        raise ValueError(f"{path}: no rasters")
    p, x, y = one["p"], one["x0"], one["y1"]
    off = lambda v: F.abs(v / p - F.round(v / p)) > 1e-3
    if one["q"] - p > 1e-9 * p or not rows.filter(off(F.col("origin_x") - x) | off(F.col("origin_y") - y)).isEmpty():
        raise ValueError(f"{path}: the rasters don't lie on one grid")
    return Grid(round((one["x1"] - x) / p), round((y - one["y0"]) / p), x, y, p)


def file_name(path):
    """The raster that a file was written for."""
    return F.regexp_replace(F.url_decode(F.element_at(F.split(path, "/"), -1)), r"_\d+_\d+\.tif$", "")


