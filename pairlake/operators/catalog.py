"""Capture catalogue: names, scenes, cameras, duplicates, pairs and their crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.functions import naming as N
from pairlake.operators.scan import ranked
from pairlake.operators.skew import salted_join

# Fixed value: outputs up to this many bytes count as broken.
MIN_OUTPUT_BYTES = 10_000_000


# -- names -------------------------------------------------------------------------


def parse_capture_name(files: DataFrame) -> DataFrame:
    """sensor, scene, role from the flat `filename`; all null when it does not parse."""
    name = F.col("filename")
    parses = name.rlike(N.CAPTURE_NAME)
    scene = F.regexp_replace(F.regexp_extract(name, N.CAPTURE_NAME, 2), "_GT$", "")
    return files.withColumns(
        {
            "sensor": F.when(parses, F.regexp_extract(name, N.CAPTURE_NAME, 1)),
            "scene": F.when(parses, scene),
            "role": F.when(parses, F.when(name.contains("_GT_"), "gt").otherwise("noisy")),
        }
    )


def unparsed_names(files: DataFrame) -> DataFrame:
    """The rejects of `parse_capture_name`."""
    return files.filter(~F.col("filename").rlike(N.CAPTURE_NAME))


def parse_capture_path(files: DataFrame) -> DataFrame:
    """sensor, image_set, role, filename, ext from `.../<sensor>/<set>/[gt/]<file>`."""
    parts = F.split("path", "/")
    in_gt = F.element_at(parts, -2) == "gt"
    name = F.element_at(parts, -1)
    return files.withColumns(
        {
            "sensor": F.when(in_gt, F.element_at(parts, -4)).otherwise(F.element_at(parts, -3)),
            "image_set": F.when(in_gt, F.element_at(parts, -3)).otherwise(F.element_at(parts, -2)),
            "role": F.when(in_gt, "gt").otherwise("noisy"),
            "filename": name,
            "ext": N.extension(name),
        }
    )


def drop_sidecars(files: DataFrame) -> DataFrame:
    return files.filter(~N.is_sidecar(F.col("path")))


def scan_candidates(files: DataFrame) -> DataFrame:
    return files.filter(~N.is_scan_noise(F.col("path")))


def _gatherable(files: DataFrame, skip_sets: tuple[str, ...]) -> DataFrame:
    path = F.lower(F.col("path"))
    kept = files.filter(N.is_raw(F.col("path")))
    for name in skip_sets:
        kept = kept.filter(~path.contains(name.lower()))
    return kept


def select_low_iso(files: DataFrame, max_iso: int = 100, skip_sets: tuple[str, ...] = ()) -> DataFrame:
    """Raw captures fit to serve as clean images, with their destination folder.

    `skip_sets` names collections whose files are never gathered, such as the dataset's
    own; lossy files are left out too.
    """
    path = F.lower(F.col("path"))
    return (
        _gatherable(files, skip_sets)
        .filter(~path.contains("lossy") & (F.col("iso") <= max_iso))
        .withColumn("destination", F.when(path.endswith("raf"), "X-Trans").otherwise("Bayer"))
    )


def unknown_iso(files: DataFrame, skip_sets: tuple[str, ...] = ()) -> DataFrame:
    """Raw captures `select_low_iso` leaves out because their ISO is not known."""
    return _gatherable(files, skip_sets).filter(F.col("iso").isNull())


def valid_output(files: DataFrame, min_bytes: int = MIN_OUTPUT_BYTES) -> DataFrame:
    return files.filter(F.col("size") > min_bytes)


# -- counts ------------------------------------------------------------------------


def _iso_label() -> Column:
    iso = F.col("iso").cast("string")
    return F.when(iso.rlike(r"^\d+$"), iso).otherwise("UnknownISO")


def _camera_label() -> Column:
    camera = F.trim(F.col("camera"))
    return F.when(camera.isNull() | (camera == ""), "UnknownCamera").otherwise(camera)


def iso_labels(exif: DataFrame) -> DataFrame:
    """Distinct ISO labels in numeric order, UnknownISO last."""
    labels = exif.select(_iso_label().alias("iso")).distinct()
    return labels.orderBy(F.expr("try_cast(iso AS bigint)").asc_nulls_last())


def dataset_summary(exif: DataFrame, reserve: list[str], isos: list[str] | None = None) -> DataFrame:
    """Images per camera and ISO, scenes per camera, split by reserve substring, with totals.

    Every camera has a row in both splits. The scene total is the sum over cameras.
    """
    if isos is None:
        # One short label per distinct ISO value.
        isos = [row.iso for row in iso_labels(exif).collect()]
    reserved = F.lit(False)
    for text in reserve:
        reserved = reserved | F.col("scene").contains(text)
    shots = exif.filter(N.is_raw(F.col("path"))).select(
        _camera_label().alias("camera"),
        _iso_label().alias("iso"),
        F.when(reserved, "test").otherwise("train").alias("split"),
        "scene",
    )
    counted = shots.groupBy("camera", "split").agg(
        *[F.count_if(F.col("iso") == iso).alias(f"ISO{iso}") for iso in isos],
        F.count_distinct("scene").alias("scenes"),
        F.count(F.lit(1)).alias("images"),
    )
    figures = [f"ISO{iso}" for iso in isos] + ["scenes", "images"]
    grid = shots.select("camera").distinct().select(
        "camera", F.explode(F.array(F.lit("train"), F.lit("test"))).alias("split")
    )
    rows = grid.join(counted, ["camera", "split"], "left").na.fill(0, figures)
    totals = rows.groupBy("split").agg(*[F.sum(f).alias(f) for f in figures])
    return rows.unionByName(totals.withColumn("camera", F.lit("Total")))


def count_extensions(files: DataFrame) -> DataFrame:
    """Files per extension that is not a raw one."""
    ext = F.lower(F.regexp_extract(N.path_leaf(F.col("path")), r".(\.[^.]*)$", 1))
    return (
        files.select(ext.alias("ext"))
        .filter((F.col("ext") != "") & ~F.substring("ext", 2, 100).isin(*N.RAW_EXTENSIONS))
        .groupBy("ext")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def scene_counts(files: DataFrame) -> DataFrame:
    """Clean and noisy raw captures per scene."""
    return (
        files.filter(N.is_raw(F.col("path")))
        .groupBy("image_set")
        .agg(
            F.count_if(F.col("role") == "gt").alias("clean"),
            F.count_if(F.col("role") != "gt").alias("noisy"),
        )
    )


def highest_entry(entries: DataFrame) -> DataFrame:
    """Highest integer-named entry per folder."""
    return (
        entries.filter(F.col("name").rlike(r"^\d+$"))
        .groupBy("folder")
        .agg(F.max(F.col("name").cast("bigint")).cast("string").alias("highest"))
    )


def last_modified(
    entries: DataFrame,
    exclude: list[str] | None = None,
    prefix: str | None = None,
    ext: str | None = None,
    exclude_ext: str | None = None,
) -> DataFrame:
    """Newest entry per folder under the given name filters."""
    name = F.col("name")
    kept = entries
    if exclude:
        kept = kept.filter(~name.isin(*exclude))
    if prefix is not None:
        kept = kept.filter(name.startswith(prefix))
    if ext is not None:
        kept = kept.filter(name.endswith("." + ext))
    if exclude_ext is not None:
        kept = kept.filter(~name.endswith("." + exclude_ext))
    return kept.groupBy("folder").agg(
        F.max_by("name", F.struct("mtime", "name")).alias("newest"), F.max("mtime").alias("mtime")
    )


# -- duplicates --------------------------------------------------------------------


def content_duplicates(files: DataFrame) -> DataFrame:
    """Files whose content an earlier file (by `seq`) already has, with that file."""
    firsts = files.groupBy("sha1").agg(
        F.min(F.struct("seq", "path")).alias("first"), F.count(F.lit(1)).alias("copies")
    ).filter(F.col("copies") > 1).select(
        "sha1", F.col("first.path").alias("kept"), F.col("first.seq").alias("_seq")
    )
    copies = salted_join(files, firsts, ["sha1"], spread=["path"])
    return copies.filter(F.col("seq") > F.col("_seq")).drop("_seq")


def import_names(files: DataFrame) -> DataFrame:
    """Destination names under one folder: equal content under one name is imported once,
    other content gets `dupath.<ext>` appended until the name is free."""
    contents = files.groupBy("filename", "sha1").agg(F.min(F.struct("seq", "path")).alias("first"))
    arrivals = contents.select(
        "filename", "sha1", F.col("first.seq").alias("seq"), F.col("first.path").alias("path")
    )
    placed = ranked(arrivals, ["filename"], [F.col("seq")], "nth")
    ext = F.element_at(F.split("filename", r"\."), -1)
    suffix = F.repeat(F.concat(F.lit("dupath."), ext), (F.col("nth") - 1).cast("int"))
    return placed.withColumn("destination", F.concat("filename", suffix)).drop("nth")


# -- pairs -------------------------------------------------------------------------


def prefer_bayer(files: DataFrame) -> DataFrame:
    """Drop developed files of scenes that also exist as Bayer captures."""
    in_bayer = files.filter("from_bayer").select("image_set").distinct().withColumn("_in_bayer", F.lit(True))
    return (
        salted_join(files, in_bayer, ["image_set"], spread=["path"], how="left")
        .filter(F.col("from_bayer") | F.col("_in_bayer").isNull())
        .drop("_in_bayer")
    )


def make_pairs(files: DataFrame, **salting) -> DataFrame:
    """Each clean file of a scene with every file of the scene, itself included."""
    clean = files.filter(F.col("role") == "gt").select("image_set", F.col("path").alias("gt_path"))
    others = files.select("image_set", F.col("path").alias("f_path"))
    return salted_join(others, clean, ["image_set"], spread=["f_path"], **salting)


def pending(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items not recorded yet."""
    return items.join(done.select(*keys).distinct(), keys, "left_anti")


def merge_results(new: DataFrame, cached: DataFrame) -> DataFrame:
    return new.unionByName(cached, allowMissingColumns=True)


def missing_scenes(reserve: DataFrame, files: DataFrame) -> DataFrame:
    """Reserved scenes without files. Each side is one row per scene before they meet, so no task sorts a scene's files."""
    return reserve.select("image_set").distinct().subtract(files.select("image_set").distinct())


def reserved_present(reserve: DataFrame, files: DataFrame) -> DataFrame:
    return files.select("image_set").distinct().intersect(reserve.select("image_set").distinct())


def reserve_from_content(descriptors: DataFrame) -> DataFrame:
    """Scenes of a descriptor, from the folder of each noisy file."""
    folder = N.parent_name(F.col("f_fpath"))
    return descriptors.select(folder.alias("image_set")).filter(F.col("image_set") != "gt").distinct()


# -- crops -------------------------------------------------------------------------


def parse_crop_names(crops: DataFrame) -> DataFrame:
    """base, x, y, ext of a crop file `<base>.<x>_<y>.<ext>`."""
    leaf = N.path_leaf(F.col("path"))
    return crops.withColumns(
        {
            "base": F.regexp_extract(leaf, N.CROP_NAME, 1),
            "x": F.regexp_extract(leaf, N.CROP_NAME, 2).cast("int"),
            "y": F.regexp_extract(leaf, N.CROP_NAME, 3).cast("int"),
            "ext": F.regexp_extract(leaf, N.CROP_NAME, 4),
        }
    ).filter(F.col("base") != "")


def match_crops(pairs: DataFrame, crops: DataFrame, **salting) -> DataFrame:
    """Developed crops of both sides of a pair that share their coordinates.

    `crops` has (image_set, path) of developed crops. Names are compared whole, so one
    source's crops are never taken for another's whose name starts alike.
    """
    parsed = parse_crop_names(crops).select("image_set", "base", "x", "y", F.col("path").alias("crop"))
    based = pairs.withColumns(
        {"f_base": N.path_leaf(F.col("f_path")), "gt_base": N.path_leaf(F.col("gt_path"))}
    )
    noisy = based.join(
        parsed.withColumnsRenamed({"base": "f_base", "crop": "f_linrec2020_fpath"}), ["image_set", "f_base"]
    )
    clean = parsed.withColumnsRenamed({"base": "gt_base", "crop": "gt_linrec2020_fpath"})
    return salted_join(
        noisy, clean, ["image_set", "gt_base", "x", "y"], ["f_path"], count_from=based, **salting
    ).drop("f_base", "gt_base")


def bayer_crop_path(developed: Column) -> Column:
    return F.regexp_replace(
        F.replace(developed, F.lit("proc/lin_rec2020"), F.lit("src/Bayer")), r"\.tif$", ".npy"
    )


def with_bayer_crops(matched: DataFrame) -> DataFrame:
    return matched.withColumns(
        {
            "f_bayer_fpath": bayer_crop_path(F.col("f_linrec2020_fpath")),
            "gt_bayer_fpath": bayer_crop_path(F.col("gt_linrec2020_fpath")),
        }
    )


def missing_bayer_crops(matched: DataFrame, stored: DataFrame) -> DataFrame:
    """Mosaic crops that matched pairs need and storage lacks (must be empty)."""
    needed = with_bayer_crops(matched).select(
        F.explode(F.array("f_bayer_fpath", "gt_bayer_fpath")).alias("path")
    )
    return needed.distinct().join(stored.select("path"), "path", "left_anti")


def list_unpaired_crops(files: DataFrame, crops: DataFrame) -> DataFrame:
    """Crops of each unpaired file, ordered by coordinates."""
    parsed = parse_crop_names(crops)
    entry = F.struct(
        "x", "y", F.col("path").alias("gt_linrec2020_fpath"), bayer_crop_path(F.col("path")).alias("gt_bayer_fpath")
    )
    # One entry per tile of one image.
    listed = parsed.groupBy("base").agg(F.sort_array(F.collect_list(entry)).alias("crops"))
    return files.withColumn("base", N.path_leaf(F.col("path"))).join(listed, "base").drop("base")
