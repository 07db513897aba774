"""Many slides at once: what one opens, asks and reads of a slide, as tables.

    slides = SlideSet(spark, "/slides")
    slides.metadata, slides.levels(), slides.properties(), slides.associated_images()
    slides.best_level(requests)               # path, target_downsample
    slides.read_region(requests)              # request_id, path, x, y, level, w, h -> RGBA rasters
    slides.read_biomarker_region(requests)    # the same with biomarker
    slides.thumbnails(512, 512), slides.label_images()
    slides.deepzoom(254, 1), slides.descriptors()
    slides.deepzoom_tiles(addresses)          # request_id, path, dz_level, col, row_no -> rasters

What can't be read is a row with its error (class, message), not the end of the job.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors as E
from .catalog import catalog, default_biomarker_tokens, resolve, slide_family, supports_biomarkers
from .functions.icc import Profile
from .functions.raster import ColorStyle, centred, find_jpeg, from_png, on_background, read_correction, resize, rgba, thumbnail, to_uint8
from .operators import canvas, deepzoom, gates, levels, multiplex, region
from .sinks.shared import keep
from .sources import register_sources

RASTER = "height int, width int, n_channels int, mode string, data binary"
# The colour under tiles, by the catalog's background.
BACKGROUNDS = {"transparent": (255, 255, 255, 0), "white": (255, 255, 255, 255), "zeros": (0, 0, 0, 0), "black": (0, 0, 0, 255), "grey240": (240, 240, 240, 255), "grey": (240, 240, 240, 255)}


def decode_png(data: bytes) -> np.ndarray | None:
    """RGBA of a PNG; null for anything else, so that such tiles are left out."""
    try:
        return rgba(from_png(data))
    except (ValueError, TypeError):
        return None


def _raster(image: np.ndarray) -> tuple:
    return (*image.shape[:2], image.shape[2], "RGBA" if image.shape[2] == 4 else "RGB", np.ascontiguousarray(image).tobytes())


#: Requests for up to so many slides are told to the sources, so that no other file is opened; beyond, all are read.
FEW_SLIDES = 1_000
#: Bytes that a row's raster may have; larger results come as cells.
MOST_RASTER = 2**31 - 2**20
#: Pixels of a multiplex file that requests ask of one task.
MOST_PIXELS = 1 << 22
#: Colour styles, and their bytes, that are sent to every task.
MOST_STYLES, MOST_STYLE_BYTES = 256, 64 << 20


def _fitted(w: Column, h: Column, most_w: Column, most_h: Column) -> tuple[Column, Column]:
    """Sides of a w x h image shrunk to fit at its aspect; never enlarged."""
    scale = F.least(most_w / w, most_h / h, F.lit(1.0))
    return tuple(F.greatest(F.lit(1), F.rint(side * scale).cast("int")) for side in (w, h))


class SlideSet:
    """The slides of a folder. decoder: bytes -> RGBA array or None; JPEG needs one that the cluster has.

    A format of one's own is a row of `formats` (see catalog.register) and, in `readers`, the
    reader of its suffix as "module:function": from a Blob to a Parsed with levels and a tile
    index. All that follows (regions, Deep Zoom, thumbnails) is then as for any other.
    """

    def __init__(self, spark: SparkSession, path: str, decoder: Callable[[bytes], np.ndarray | None] = decode_png, acquisition_id: int | None = None, formats: DataFrame | None = None, readers: dict[str, str] | None = None):
        register_sources(spark)
        self._formats, self._readers = catalog(spark) if formats is None else formats, readers or {}
        self.spark, self.path, self._decoder, self._acquisition = spark, path, decoder, acquisition_id
        self._metadata: DataFrame | None = None

    def _load(self, source: str, paths: list[str] | None = None, **options: str) -> DataFrame:
        """Rows of a source; of these paths only, if they are given."""
        reader = self.spark.read.format(source).options(**options)
        if self._acquisition is not None:
            reader = reader.option("acquisition_id", str(self._acquisition))
        if self._readers:
            reader = reader.option("readers", json.dumps({k.lower().lstrip("."): v for k, v in self._readers.items()}))
        rows = reader.load(self.path)
        return rows if paths is None else rows.filter(F.col("path").isin(paths))

    @staticmethod
    def _paths(requests: DataFrame) -> list[str] | None:
        """The slides that requests name, if these are few."""
        found = [r["path"] for r in requests.select("path").filter("path is not null").distinct().limit(FEW_SLIDES + 1).collect()]
        return found if len(found) <= FEW_SLIDES else None

    def _described(self, paths: list[str] | None) -> DataFrame:
        """metadata of some slides: from what is parsed already, else of these files alone."""
        return self.metadata if paths is None or self._metadata is not None else self._load("slide_metadata", paths)

    @property
    def metadata(self) -> DataFrame:
        """A row a file; parsed once and kept, as most of what follows asks for it."""
        if self._metadata is None:
            self._metadata = self._load("slide_metadata").persist()
        return self._metadata

    def close(self) -> None:
        if self._metadata is not None:
            self._metadata.unpersist()
            self._metadata = None

    def resolved(self, formats: DataFrame | None = None) -> DataFrame:
        """path, format_id, format_label, slide_family, error of every file by the catalog (or one with further formats); probes are run where a format has one."""
        probed = self._load("slide_probes")
        found = resolve(probed, self._formats if formats is None else formats, probes="probes")
        read = F.array_contains("probes", F.col("format_id"))  # of a vendor's formats, a file that is read here all the same
        return found.withColumn("error", F.when(~F.coalesce(read, F.lit(False)), F.col("error"))).drop("probes")

    def tiles(self, with_data: bool = False, paths: list[str] | None = None) -> DataFrame:
        return self._load("slide_tiles", paths, data=str(with_data).lower())

    def errors(self) -> DataFrame:
        return self.metadata.filter("error is not null").select("path", "error")

    def levels(self) -> DataFrame:
        return self.metadata.select("path", F.posexplode("levels").alias("level", "l")).select("path", "level", "l.width", "l.height", "l.downsample")

    def properties(self) -> DataFrame:
        return self.metadata.select("path", F.explode("properties").alias("key", "value"))

    def scans(self) -> DataFrame:
        """path, version, scan_scale, pixel_size (millimetres), focus_layers, tile_count of TMAP slides, as their headers state them."""
        told = {"version": "int", "scan_scale": "int", "pixel_size": "double", "focus_layers": "int", "tile_count": "int"}
        held = self.metadata.filter("format_id = 'tmap'")
        return held.select("path", *[F.try_element_at("properties", F.lit("tmap." + k.replace("_", "-"))).cast(kind).alias(k) for k, kind in told.items()])

    def associated_images(self) -> DataFrame:
        """Stored images with their place in the file."""
        return self.metadata.select("path", F.explode("stored").alias("name", "place")).select("path", "name", "place.offset", "place.length")

    def channels(self) -> DataFrame:
        return self.metadata.select("path", F.posexplode("channels").alias("channel_index", "name"))

    def slides(self, paths: list[str] | None = None) -> DataFrame:
        """path, format_id, slide_family, supports_biomarkers, level_count, downsamples and what the format lays down for reading."""
        rules = self._formats.select("format_id", F.col("slide_family").alias("of_format"), F.col("supports_biomarkers").alias("capable"), "background", F.when(F.col("level_rule").isin("prev", "single"), F.col("level_rule")).otherwise("floor").alias("rule"))
        m = self._described(paths).filter("error is null").select("path", "format_id", "width", "height", "level_count", "levels", "channels", "properties")
        if paths is None:
            m = self._with_siblings(m)
        stated = F.try_element_at("properties", F.lit("slide.family"))
        family = F.coalesce(stated, slide_family(F.col("of_format"), F.col("channels")))
        out = m.join(F.broadcast(rules), "format_id").withColumn("slide_family", family)  # a row a format
        picture = F.when(F.col("slide_family") == "brightfield", F.when(F.col("format_id") == "czi", "black").when(F.col("format_id") == "qptiff", "transparent"))
        out = out.withColumn("background", F.coalesce(picture, "background"))  # pictures of formats that else hold channels
        return out.withColumn("supports_biomarkers", supports_biomarkers(F.col("capable"), F.col("slide_family"))).withColumn("downsamples", F.col("levels.downsample")).drop("of_format", "capable")

    @staticmethod
    def _signatures(m: DataFrame) -> DataFrame:
        """What tells which files of a folder go together: path, folder, height, width, dtype, label."""
        label, dtype = (F.try_element_at("properties", F.lit(k)) for k in ("ome.sibling-label", "tiff.dtype"))
        files = m.select("path", F.regexp_replace("path", "[^/]*$", "").alias("folder"), "height", "width", dtype.alias("dtype"), label.alias("label"))
        return files.filter(F.col("label").isNotNull() & F.lower("path").rlike(r"\.tiff?\z"))

    def _with_siblings(self, m: DataFrame) -> DataFrame:
        """m where a file of one channel has those of all its siblings, by path; the first of a label wins."""
        alone = F.try_element_at("properties", F.lit("ome.alone")) == "true"
        of = multiplex.sibling_groups(self._signatures(m)).groupBy("folder", "height", "width", "dtype").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "label"))), lambda s: s["label"]).alias("shared"))
        mine = self._signatures(m.filter(alone)).join(of, ["folder", "height", "width", "dtype"]).select(F.col("path"), "shared")
        return m.join(mine, "path", "left").withColumn("channels", F.coalesce("shared", "channels")).drop("shared")

    def siblings(self) -> DataFrame:
        """anchor, biomarker, path: for each file of one channel the files of its folder that hold the channels of its slide."""
        m = self.metadata.filter("error is null")
        files = self._signatures(m)
        anchors = self._signatures(m.filter(F.try_element_at("properties", F.lit("ome.alone")) == "true")).select("folder", "height", "width", "dtype", F.col("path").alias("anchor"))
        return anchors.join(multiplex.sibling_groups(files), ["folder", "height", "width", "dtype"]).select("anchor", F.col("label").alias("biomarker"), "path")

    def best_level(self, requests: DataFrame) -> DataFrame:
        """requests (path, target_downsample, …) with best_level, by the rule of each slide's format."""
        asked = requests.join(self.slides(self._paths(requests)).select("path", "downsamples", "rule"), "path")
        level = F.lit(0)
        for rule in ("floor", "prev"):
            level = F.when(F.col("rule") == rule, levels.best_level(F.col("downsamples"), F.col("target_downsample"), rule)).otherwise(level)
        return asked.withColumn("best_level", level).drop("downsamples", "rule")

    # --- biomarkers ------------------------------------------------------------

    def biomarkers(self) -> DataFrame:
        """path, biomarkers, default_biomarker, error: names of multiplex slides; others have an error."""
        s = self.slides().withColumn("error", gates.family_error(F.col("slide_family"), "multiplex"))
        name = lambda fmt: F.coalesce(F.get(F.filter("channels", lambda c: F.upper(c).rlike("|".join(default_biomarker_tokens(fmt)))), F.lit(0)), F.get("channels", F.lit(0)))
        default = F.get("channels", F.lit(0))
        for fmt in ("hdf5", "ims", "ome_tiff", "mcd"):
            default = F.when(F.col("format_id") == fmt, name(fmt)).otherwise(default)
        default = F.when(F.col("format_id") == "qptiff", F.when(F.array_contains("channels", "DAPI"), "DAPI")).otherwise(default)
        s = s.withColumn("default_biomarker", F.when(F.col("error").isNull(), default))
        missing = F.col("error").isNull() & F.col("default_biomarker").isNull()
        s = s.withColumn("error", F.when(missing, E.error(E.MISSING_DEFAULT, "No default display biomarker")).otherwise(F.col("error")))
        return s.select("path", F.when(F.col("slide_family") == "multiplex", F.col("channels")).alias("biomarkers"), "default_biomarker", "error")

    def has_biomarker(self, asked: DataFrame) -> DataFrame:
        """asked (path, biomarker) with has_biomarker."""
        return asked.join(self.slides().select("path", "channels"), "path", "left").withColumn("has_biomarker", F.coalesce(F.array_contains("channels", F.col("biomarker")), F.lit(False))).drop("channels")

    def _checked(self, requests: DataFrame, wanted: str, paths: list[str] | None = None) -> DataFrame:
        """requests beside what their slide lays down; `error` where one can't be read at all. requests has request_id, path, level."""
        asked = requests.join(self.slides(paths).select("path", "format_id", "slide_family", "level_count", "levels", "background", "channels", "properties"), "path", "left")
        asked = asked.withColumn("level", gates.effective_level(F.col("level"), F.col("level_count"), F.col("format_id")))
        missing = F.when(F.col("format_id").isNull(), E.error(E.VALUE, "No such slide"))
        checks = [missing, gates.family_error(F.col("slide_family"), wanted), gates.level_error(F.col("level"), F.col("level_count"), F.col("format_id"))]
        if wanted == "multiplex":
            checks.append(gates.biomarker_error(F.col("biomarker"), F.col("channels")))
        return asked.withColumn("error", F.coalesce(*checks)).withColumn("blank", F.coalesce(gates.out_of_range(F.col("level"), F.col("level_count")), F.lit(False)))

    # --- regions ----------------------------------------------------------------

    def read_region(self, requests: DataFrame, cell_size: int = 4096) -> DataFrame:
        """request_id, height, width, n_channels, mode, data, error. x and y are level-0 pixels, w and h pixels of the level.

        The index of the slides asked for is scanned once and joined first, by rectangles.
        What was met then goes to tasks by file and run of the file and is read by range, in
        file order. Tiles of one focus plane are taken: requests' z, or that of the slide's
        most tiles. A level that has no tiles of its own is shrunk from level 0. Colours under
        tiles are the format's. Requests are painted by cells, see read_region_cells for
        results that are too large for a row.
        """
        cells, asked = self._cells(requests, cell_size)
        return self._with_errors(canvas.whole(cells), asked)

    def read_region_cells(self, requests: DataFrame, cell_size: int = 4096) -> tuple[DataFrame, DataFrame]:
        """(cells, errors): the rasters of read_region cut in squares, request_id, left, top, height, width, data (RGBA), so that a request may be of any size; and request_id, error of the others."""
        cells, asked = self._cells(requests, cell_size, most=None)
        return cells.select("request_id", "left", "top", "height", "width", "data"), asked.filter("error is not null").select("request_id", "error")

    def _cells(self, requests: DataFrame, cell_size: int = 4096, flat: tuple[int, int, int] | None = None, most: int | None = MOST_RASTER) -> tuple[DataFrame, DataFrame]:
        """(cells of the results, requests with their errors). requests may have out_w and out_h: what w x h pixels of the level are shrunk to."""
        paths = self._paths(requests)
        asked = self._checked(requests, "brightfield", paths)
        for side, n in (("out_w", "w"), ("out_h", "h")):
            asked = asked.withColumn(side, F.col(side if side in requests.columns else n).cast("int"))
        if most is not None:
            size = F.col("out_w").cast("long") * F.col("out_h") * 4
            asked = asked.withColumn("error", F.coalesce("error", F.when(size > most, E.error(E.VALUE, F.format_string("a raster of %d bytes is no row; read it as cells", size)))))
        grey = F.try_element_at("properties", F.lit("tmap.background")).try_cast("int")
        color = F.coalesce(*[F.when(F.col("background") == k, F.array(*map(F.lit, v))) for k, v in BACKGROUNDS.items() if k != "grey"], F.when(grey.isNotNull(), F.array(grey, grey, grey, F.lit(255))), F.array(*map(F.lit, BACKGROUNDS["grey"])))
        asked = asked.withColumn("color", color)
        index = keep(self.tiles(paths=paths).drop("data"), "tile_index")  # read three times below
        depth = index.groupBy("path", "z").agg(F.count("*").alias("n"), F.collect_set("level").alias("levels_")).groupBy("path")
        depth = depth.agg(F.max_by("z", F.struct("n", -F.col("z"))).alias("main_z"), F.array_distinct(F.flatten(F.collect_list("levels_"))).alias("stored_levels"))  # a few numbers a slide
        good = asked.filter("error is null and not blank").join(depth, "path", "left")
        own = F.coalesce(F.array_contains("stored_levels", F.col("level")), F.lit(False))
        good = good.withColumn("source_level", F.when(own, F.col("level")).otherwise(0)).withColumn("downsample", F.get("levels.downsample", F.col("source_level")))
        scale = F.get("levels.downsample", F.col("level")) / F.col("downsample")
        good = good.withColumn("lw", F.ceil(F.col("w") * scale).cast("int")).withColumn("lh", F.ceil(F.col("h") * scale).cast("int"))
        z = F.coalesce(F.col("z"), F.col("main_z")) if "z" in requests.columns else F.col("main_z")
        span = good.select("request_id", "path", F.col("source_level").alias("level"), z.alias("wanted_z"), "x", "y", "downsample", "lw", "lh", F.ceil(F.col("lw") * F.col("downsample")).alias("w"), F.ceil(F.col("lh") * F.col("downsample")).alias("h"))
        index = index.select("path", "format_id", "level", F.col("z"), "offset", "length", "file_id", F.col("x0").alias("x2"), F.col("y0").alias("y2"), F.col("cov_w").cast("long").alias("w2"), F.col("cov_h").cast("long").alias("h2"), "row_no", "col")
        flat_z = index.withColumn("z", F.when(F.col("z") >= 0, F.col("z")))  # what lies beside the focus planes belongs to all of them
        pictures = flat_z.filter("format_id = 'czi'")
        under = region.scene_grounds(pictures, ("path", "level"), "row_no").select("path", F.lit("czi").alias("format_id"), "level", F.lit(None).cast("int").alias("z"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length"), F.lit(0).alias("file_id"), "x2", "y2", "w2", "h2", "row_no", F.lit(0).alias("col"))
        met = region.rectangle_join(span, flat_z.unionByName(under), ("path", "level"), cell_size).filter("z is null or z = wanted_z")
        canvases = good.select("request_id", F.col("lw").alias("w"), F.col("lh").alias("h"), "out_w", "out_h", F.col("color").alias("background"))
        empty = asked.filter("error is null and blank").select("request_id", F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), "out_w", "out_h", F.col("color").alias("background"))
        cells = canvas.painted(self._decoded(met), canvases.unionByName(empty), flat=flat)
        return canvas.shrunk(cells, 4 if flat is None else 3), asked

    def _decoded(self, met: DataFrame, run: int = 64 << 20) -> DataFrame:
        """Tiles that requests met, cut by the cells of their canvases; each file's places are read in order, long files by several tasks."""
        decoder = self._decoder

        def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from .sources.tiles import TileReader

            names = [c.split()[0] for c in canvas.CROP.split(", ")]
            reader, last, image = TileReader(), None, None
            for b in batches:
                out = []
                for t in b.itertuples(index=False):
                    place = (t.path, t.file_id, t.offset, t.level, t.row_no, t.col)
                    if t.format_id == "czi" and t.col == 0:  # a scene's ground
                        out += canvas.grounds(t.request_id, t.x2 - t.x, t.y2 - t.y, t.row_no * (1 << 31), t.w2, t.h2, t.lw, t.lh)
                        continue
                    if place != last:  # a tile that several requests met is read once
                        found = reader.image(t.path, t.format_id, t.level, t.row_no, t.col, t.file_id, t.offset, t.length)
                        last, image = place, found if isinstance(found, np.ndarray) else decoder(found) if found else None
                    if image is not None:
                        w, h = max(1, round(t.w2 / t.downsample)), max(1, round(t.h2 / t.downsample))
                        part = image if image.shape[:2] == (h, w) or image.shape[0] <= h and image.shape[1] <= w else resize(image, w, h, "bilinear")
                        x, y = int((t.x2 - t.x) / t.downsample), int((t.y2 - t.y) / t.downsample)
                        if t.format_id == "qptiff":  # sides of levels that aren't whole multiples: tiles keep their places in the level
                            x, y = (int(np.ceil(a / t.downsample) - int(b / t.downsample)) for a, b in ((t.x2, t.x), (t.y2, t.y)))
                        out += canvas.crops(t.request_id, x, y, t.row_no * (1 << 31) + t.col, part, t.lw, t.lh)
                        if len(out) > 64:
                            yield pd.DataFrame(out, columns=names)
                            out = []
                yield pd.DataFrame(out, columns=names)
            reader.close()

        dealt = met.withColumn("run", F.floor(F.col("offset") / run)).repartition("path", "file_id", "run").sortWithinPartitions("path", "file_id", "offset", "level", "row_no", "col").drop("run", "z", "wanted_z")
        return dealt.mapInPandas(decoded, canvas.CROP)

    @staticmethod
    def _with_errors(rasters: DataFrame, asked: DataFrame) -> DataFrame:
        bad = asked.filter("error is not null").select("request_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in RASTER.split(", ")], "error")
        return rasters.select("request_id", *[c.split()[0] for c in RASTER.split(", ")], F.lit(None).cast(E.SCHEMA).alias("error")).unionByName(bad)

    def read_fixed_region(self, requests: DataFrame) -> DataFrame:
        """As read_region; of dyj slides only, other formats have no such read."""
        known = requests.join(self.slides().select("path", "format_id"), "path", "left")
        none = known.filter(~F.coalesce(F.col("format_id") == "dyj", F.lit(False))).withColumn("error", E.error(E.UNSUPPORTED_OPERATION, F.format_string("%s slides have no fixed regions", F.coalesce("format_id", F.lit("unknown")))))
        return self._with_errors(self.read_region(known.filter("format_id = 'dyj'").drop("format_id")).drop("error"), none)

    def read_biomarker_region(self, requests: DataFrame) -> DataFrame:
        """As read_region for requests with a biomarker, of multiplex slides: the channel's rectangle, stretched to 8 bits, as RGBA.

        The rectangle is cut at the level's sides, not filled up; one that lies outside is black
        and of the whole size. Only the chunks, tiles or subblocks that hold it are read.
        """
        asked = self._checked(requests, "multiplex")
        acquisition = self._acquisition

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from .sources.blob import Blob
            from .sources.planes import open_planes

            path, found, blob = None, None, None
            for b in batches:
                out = []
                for t in b.itertuples(index=False):
                    if t.path != path:
                        if blob is not None:
                            blob.close()
                        path, blob = t.path, Blob(t.path)
                        found = open_planes(blob, acquisition)
                    w, h, factor = found.levels[t.level]
                    x, y = (int(t.x / factor), int(t.y / factor)) if found.format_id == "qptiff" else (t.x, t.y)
                    x0, x1, _ = slice(x, x + t.w).indices(w)
                    y0, y1, _ = slice(y, y + t.h).indices(h)
                    try:
                        if x0 < x1 and y0 < y1:
                            channel = 0 if t.apart else found.index(t.biomarker)  # a sibling's first plane is the channel
                            part = to_uint8(found.read(channel, t.level, x0, y0, x1 - x0, y1 - y0), wide=np.float64)
                        else:
                            part = np.zeros((t.h, t.w), np.uint8)
                        out.append((t.request_id, *_raster(rgba(part)), None))
                    except (ValueError, LookupError) as e:  # of this file; others go on
                        out.append((t.request_id, None, None, None, None, None, {"class": type(e).__name__, "message": str(e)}))
                yield pd.DataFrame(out, columns=["request_id", "height", "width", "n_channels", "mode", "data", "error"]).astype({c: "Int64" for c in ("height", "width", "n_channels")})
            if blob is not None:
                blob.close()

        held = self.siblings().select(F.col("anchor").alias("path"), "biomarker", F.col("path").alias("sibling"))
        asked = asked.join(held, ["path", "biomarker"], "left")
        good = asked.filter("error is null").select("request_id", F.coalesce("sibling", "path").alias("path"), F.col("sibling").isNotNull().alias("apart"), F.col("level").cast("int").alias("level"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), "biomarker")
        # a file's biomarkers go to a task for each so many pixels, not to every task, as each reads the file's directory
        tasks = good.groupBy("path").agg((1 + F.floor(F.sum(F.col("w").cast("double") * F.col("h")) / MOST_PIXELS)).alias("tasks"))
        good = good.join(tasks, "path").withColumn("task", F.pmod(F.xxhash64("biomarker"), F.greatest("tasks", F.lit(1)))).drop("tasks")
        dealt = good.repartition("path", "task").drop("task").sortWithinPartitions("path", "biomarker", "level", "y", "x")
        read = dealt.mapInPandas(each, f"request_id long, {RASTER}, error {E.SCHEMA}")
        bad = asked.filter("error is not null").select("request_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in RASTER.split(", ")], "error")
        return read.unionByName(bad)

    @staticmethod
    def colored(rasters: DataFrame, style: ColorStyle | Profile | None) -> DataFrame:
        """Rasters under a colour style or ICC profile; without one, and where there is no raster, as they are."""
        if style is None:
            return rasters

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                data = [None if d is None else style.apply(np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(c))).tobytes() for d, h, w, c in zip(b["data"], b["height"], b["width"], b["n_channels"], strict=True)]
                sizes = {c: b[c].astype("Int64") for c in ("height", "width", "n_channels")}
                yield b.assign(data=data, **sizes)

        return rasters.mapInPandas(each, rasters.schema)

    @staticmethod
    def corrected(rasters: DataFrame, styles: DataFrame) -> DataFrame:
        """Rasters, each under the style that its column `style` names, if there is such a one.

        styles: name, document (LUT XML or an ICC profile); of a doubled name the first document
        by order counts. A raster without a style, of an unknown one or of one whose document
        is broken stays as it is. The styles go to every task, so they are at most MOST_STYLES
        and MOST_STYLE_BYTES; more are a ValueError.
        """
        known = styles.filter("name is not null and document is not null").groupBy("name").agg(F.min("document").alias("document"))
        n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("document")), F.lit(0))).first()
        if n > MOST_STYLES or size > MOST_STYLE_BYTES:
            raise ValueError(f"{n} styles of {size} bytes are too many to send to every task")
        held = {r["name"]: bytes(r["document"]) for r in known.collect()}

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            read: dict[str, ColorStyle | Profile | None] = {}
            for b in batches:
                data = []
                for name, d, h, w, c in zip(b["style"], b["data"], b["height"], b["width"], b["n_channels"], strict=True):
                    if d is not None and name in held:
                        if name not in read:
                            read[name] = read_correction(held[name])
                        if read[name] is not None:
                            d = read[name].apply(np.frombuffer(d, np.uint8).reshape(int(h), int(w), int(c))).tobytes()
                    data.append(d)
                yield b.assign(data=data, **{c: b[c].astype("Int64") for c in ("height", "width", "n_channels")})

        return rasters.mapInPandas(each, rasters.schema)

    @staticmethod
    def style_info(styles: DataFrame) -> DataFrame:
        """name, kind (lut or icc; null if broken), has_transform and what a LUT states, of styles (name, document)."""

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for name, document in zip(b["name"], b["document"], strict=True):
                    found = None if document is None else read_correction(bytes(document))
                    lut = found if isinstance(found, ColorStyle) else None
                    out.append((name, None if found is None else "icc" if lut is None else "lut", found is not None, *((lut.gamma, lut.ccm, lut.rgb_rate, lut.hsv_rate) if lut else (None,) * 4)))
                yield pd.DataFrame(out, columns=["name", "kind", "has_transform", "gamma", "ccm", "rgb_rate", "hsv_rate"])

        return styles.select("name", "document").mapInPandas(each, "name string, kind string, has_transform boolean, gamma double, ccm array<double>, rgb_rate array<double>, hsv_rate array<double>")

    # --- stored images ---------------------------------------------------------------

    def stored_images(self, names: tuple[str, ...] | None = None) -> DataFrame:
        """path, name and the raster of stored images that the decoder reads.

        A picture of label and macro together is cut at a third of its width. A blob may have
        other bytes before its JPEG.
        """
        decoder = self._decoder

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from .sources.blob import Blob

            for b in batches:
                out = []
                for t in b.itertuples(index=False):
                    blob = Blob(t.path)
                    try:
                        data = blob.read(int(t.offset), int(t.length))
                    finally:
                        blob.close()
                    image = decoder(data)
                    if image is None and find_jpeg(data) > 0:
                        image = decoder(data[find_jpeg(data) :])
                    if image is None:
                        continue
                    cut = image.shape[1] // 3
                    parts = {"macro_label": image, "label": image[:, :cut], "macro": image[:, cut:]} if t.name == "macro_label" else {t.name: image}
                    out += [(t.path, name, *_raster(part)) for name, part in parts.items() if part.size]
                yield pd.DataFrame(out, columns=["path", "name", "height", "width", "n_channels", "mode", "data"])

        wanted = self.associated_images()
        if names is not None:
            wanted = wanted.filter(F.col("name").isin(*names, *(("macro_label",) if {"label", "macro"} & set(names) else ())))
        found = wanted.mapInPandas(each, f"path string, name string, {RASTER}")
        return found.filter(F.col("name").isin(*names)) if names is not None else found

    def label_images(self) -> DataFrame:
        """path and the raster of each slide's label; null where it has none that can be read."""
        return self.metadata.filter("error is null").select("path").join(self.stored_images(("label",)).drop("name"), "path", "left")

    def side_images(self) -> DataFrame:
        """path, name and the raster of label.jpg and macro.jpg that lie beside slides kept as OLE files."""
        decoder = self._decoder

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from .sources.blob import Blob

            for b in batches:
                out = []
                for path in b["path"]:
                    for name in ("label", "macro"):
                        try:
                            blob = Blob(f"{path.rpartition('/')[0]}/{name}.jpg")
                        except OSError:
                            continue
                        image = decoder(blob.read(0, blob.size))
                        blob.close()
                        if image is not None:
                            out.append((path, name, *_raster(image)))
                yield pd.DataFrame(out, columns=["path", "name", "height", "width", "n_channels", "mode", "data"])

        ole = self.metadata.filter("format_id = 'mds'").select("path").filter(F.lower("path").endswith(".mds"))
        return ole.mapInPandas(each, f"path string, name string, {RASTER}")

    def thumbnails(self, w: int = 512, h: int = 512) -> DataFrame:
        """path, raster, error: a stored thumbnail, else the last level, shrunk to fit w x h; multiplex slides have an error.

        Levels are shrunk cell by cell, so no task holds one, however large a slide's only level
        is. Of MDS slides kept as OLE files the middle of a single level is taken, or the corner
        of the last one, at exactly w x h; of others of that maker the first level below twice
        the size. Those of BIF slides are no larger than 1,024.
        """
        s = self.slides()
        held = self.stored_images(("thumbnail",)).drop("name")
        rest = s.filter("slide_family = 'brightfield'").join(held.select("path"), "path", "left_anti")
        last = F.col("level_count") - 1
        rest = rest.withColumn("request_id", F.xxhash64("path"))
        ole, flat = (F.col("format_id") == "mds") & F.lower("path").endswith(".mds"), (F.col("format_id") == "mds") & F.lower("path").endswith(".mdsx")
        fits = F.array_position(F.transform("levels", lambda v: (v["width"] <= 2 * w) & (v["height"] <= 2 * h)), True)
        level = F.when(flat, F.greatest(fits.cast("int") - 1, F.lit(0))).otherwise(last)
        lw, lh = F.get("levels.width", level), F.get("levels.height", level)
        single = ole & (F.col("level_count") == 1)
        middle = F.greatest(F.lit(256), F.least(F.lit(1024), F.floor(lw / 4), F.floor(lh / 4)))
        x, y = (F.when(single, F.greatest(F.lit(0), F.floor((n - middle) / 2))).otherwise(0).cast("long") for n in (lw, lh))
        rw, rh = (F.when(single, middle).when(ole, F.least(n, F.lit(512))).otherwise(n).cast("int") for n in (lw, lh))
        most = lambda n: F.when(F.col("format_id") == "bif", F.least(F.lit(n), F.lit(1024))).otherwise(n)
        out_w, out_h = (F.when(ole, n).otherwise(fitted).cast("int") for n, fitted in zip((w, h), _fitted(lw, lh, most(w), most(h)), strict=True))
        ask = rest.select("request_id", "path", x.alias("x"), y.alias("y"), level.alias("level"), rw.alias("w"), rh.alias("h"), out_w.alias("out_w"), out_h.alias("out_h"))
        made = canvas.whole(self._cells(ask)[0]).join(rest.select("request_id", "path"), "request_id").drop("request_id")

        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([(t.path, *_raster(thumbnail(np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, t.n_channels), w, h))) for t in b.itertuples(index=False)], columns=["path", "height", "width", "n_channels", "mode", "data"])

        fitted = held.mapInPandas(fit, f"path string, {RASTER}").unionByName(made)
        refused = s.filter("slide_family <> 'brightfield'").select("path", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in RASTER.split(", ")], E.error(E.UNSUPPORTED_OPERATION, "Multiplex slides do not support generic thumbnails").alias("error"))
        return fitted.withColumn("error", F.lit(None).cast(E.SCHEMA)).unionByName(refused)

    # --- Deep Zoom ----------------------------------------------------------------------

    def _pyramid(self, tile_size: int, limit_bounds: bool = False, paths: list[str] | None = None) -> DataFrame:
        """Deep Zoom levels of every slide, by its format's rules; cut to the slide's bounds if it has any and its format knows them."""
        per = deepzoom.with_rules(self.slides(paths).filter("width > 0 and height > 0"), self.spark).select("path", "width", "height", "levels", "slide_family", "pyramid", "lap", "fit", "cuts", "properties", "downsamples", "rule")
        whole = (F.col("width"), F.col("height"))
        per = per.withColumn("whole_w", whole[0]).withColumn("whole_h", whole[1])
        told = {c: F.when(F.col("cuts") & F.lit(limit_bounds), F.try_element_at("properties", F.lit(f"openslide.bounds-{c}")).try_cast("long")) for c in ("x", "y", "width", "height")}
        per = deepzoom.bounded(per.withColumns({f"told_{c}": v for c, v in told.items()}), tuple(f"told_{c}" for c in told))
        dz = deepzoom.levels(per, tile_size, F.col("pyramid"))
        level = F.lit(0)
        for rule in ("floor", "prev"):
            level = F.when(F.col("rule") == rule, levels.best_level(F.col("downsamples"), F.col("factor").cast("double"), rule)).otherwise(level)
        at = F.get("levels", level)
        scaled = lambda side, n, of: F.ceil(at[side] * F.col(n) / F.col(of)).cast("long")
        dz = dz.withColumn("level", level.cast("int")).withColumn("downsample", at["downsample"]).withColumn("level_w", scaled("width", "width", "whole_w")).withColumn("level_h", scaled("height", "height", "whole_h"))
        return dz.drop("levels", "properties", "downsamples", "rule", "whole_w", "whole_h", "cuts", *[f"told_{c}" for c in told])

    def deepzoom(self, tile_size: int = 254, overlap: int = 1, limit_bounds: bool = False) -> DataFrame:
        """Every Deep Zoom tile of every slide: its level, address and what to read for it, by its format's rules."""
        return deepzoom.places(deepzoom.addresses(self._pyramid(tile_size, limit_bounds)), tile_size, overlap).select("path", "dz_level", "col", "row_no", "level", "l0_x", "l0_y", "l_w", "l_h", "z_w", "z_h")

    def tile_coordinates(self, addresses: DataFrame, tile_size: int = 254) -> DataFrame:
        """addresses (path, dz_level, col, row_no) with left, top, width, height: the tile without overlap, in level-0 pixels; null for an address that isn't there."""
        asked = addresses.join(self._pyramid(tile_size, paths=self._paths(addresses)), ["path", "dz_level"], "left")
        there = (F.col("col") >= 0) & (F.col("row_no") >= 0) & (F.col("col") < F.col("cols")) & (F.col("row_no") < F.col("rows"))
        spots = {"left": F.col("col") * tile_size, "top": F.col("row_no") * tile_size}
        spots |= {"width": F.least(F.lit(tile_size), F.col("z_width") - spots["left"]), "height": F.least(F.lit(tile_size), F.col("z_height") - spots["top"])}
        return asked.select(*[asked[c] for c in addresses.columns], *[F.when(there, (v * F.col("factor")).cast("long")).alias(k) for k, v in spots.items()])

    def deepzoom_tiles(self, addresses: DataFrame, tile_size: int = 254, overlap: int = 1, background: tuple[int, int, int] = (255, 255, 255), limit_bounds: bool = False) -> DataFrame:
        """request_id, raster, error of addresses (request_id, path, dz_level, col, row_no; biomarker for multiplex slides).

        The region is read, laid on the background and brought to the tile's size cell by
        cell, as the format has it: shrunk but never enlarged, or to the exact sides, or with
        white around it to a whole tile. A level or address that isn't there is an error.
        """
        dz = self._pyramid(tile_size, limit_bounds, None if "biomarker" in addresses.columns else self._paths(addresses))
        asked = addresses.join(dz, ["path", "dz_level"], "left")
        wrong = deepzoom.address_error(F.col("dz_level"), F.coalesce("n_levels", F.lit(0)), F.col("col"), F.col("row_no"), F.col("cols"), F.col("rows"))
        asked = asked.withColumn("wrong", wrong).withColumn("error", E.first((F.col("wrong").isNotNull(), E.VALUE, F.col("wrong"))))
        places = deepzoom.places(asked.filter("wrong is null"), tile_size, overlap)
        shrink = F.col("fit") == "shrink"
        out_w, out_h = (F.when(shrink, fitted).otherwise(F.col(z).cast("int")) for fitted, z in zip(_fitted(F.col("l_w"), F.col("l_h"), F.col("z_w"), F.col("z_h")), ("z_w", "z_h"), strict=True))
        read = places.select("request_id", "path", F.col("l0_x").alias("x"), F.col("l0_y").alias("y"), "level", F.col("l_w").cast("int").alias("w"), F.col("l_h").cast("int").alias("h"), out_w.alias("out_w"), out_h.alias("out_h"), *(["biomarker"] if "biomarker" in addresses.columns else []))
        plain = read.filter("biomarker is null").drop("biomarker") if "biomarker" in read.columns else read
        cells, plain = self._cells(plain, flat=background)
        good, bad = canvas.whole(cells, 3), [asked.select("request_id", "error"), plain.select("request_id", "error")]
        if "biomarker" in read.columns:
            tiles = self.read_biomarker_region(read.filter("biomarker is not null").drop("out_w", "out_h"))
            bad.append(tiles.select("request_id", "error"))

            def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    out = []
                    for t in b.itertuples(index=False):
                        image = np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, t.n_channels)
                        image = on_background(image, background)
                        image = thumbnail(image, int(t.z_w), int(t.z_h)) if t.fit == "shrink" else resize(image, int(t.z_w), int(t.z_h))
                        if t.fit == "pad":
                            image = centred(image, tile_size + 2 * overlap, tile_size + 2 * overlap)
                        out.append((t.request_id, *_raster(image)))
                    yield pd.DataFrame(out, columns=["request_id", "height", "width", "n_channels", "mode", "data"])

            read_ = tiles.filter("error is null").drop("error").join(places.select("request_id", "z_w", "z_h", "fit"), "request_id")
            good = good.unionByName(read_.mapInPandas(fit, f"request_id long, {RASTER}"))
        return self._with_errors(good, functools.reduce(DataFrame.unionByName, bad))

    def descriptors(self, tile_size: int = 254, overlap: int = 1, image_format: str = "jpeg") -> DataFrame:
        """path, dzi: each slide's document, in the form of its format's pyramid."""
        s = deepzoom.with_rules(self.slides(), self.spark)
        form = lambda name: deepzoom.descriptor(F.col("width"), F.col("height"), tile_size, overlap, image_format, name)
        return s.select("path", F.when(F.col("pyramid") == "tiled", form("width")).when(F.col("pyramid") == "floor", form("height")).otherwise(form("line")).alias("dzi"))
