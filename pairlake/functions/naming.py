"""Column expressions over capture names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name extensions of raw photographs.
RAW_EXTENSIONS = (
    "3fr", "ari", "arw", "bay", "braw", "crw", "cr2", "cr3", "cap", "data", "dcs", "dcr",
    "dng", "drf", "eip", "erf", "fff", "gpr", "iiq", "k25", "kdc", "mdc", "mef", "mos",
    "mrw", "nef", "nrw", "obm", "orf", "pef", "ptx", "pxn", "r3d", "raf", "raw", "rwl",
    "rw2", "rwz", "sr2", "srf", "srw", "x3f", "cri", "jxs", "tco",
)
# Fixed value: flat capture name = type, scene, metadata from the last `GT_ISO` or `ISO` on.
CAPTURE_NAME = r"^([^_]+)_(.*)_((GT_)?ISO.*)$"
# Fixed value: crop file name = source file name, x, y, extension.
CROP_NAME = r"^(.*)\.(\d+)_(\d+)\.([^.]+)$"


def path_leaf(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/?$", 1)


def path_parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def parent_name(path: Column) -> Column:
    return path_leaf(path_parent(path))


def extension(path: Column) -> Column:
    """Lower-case text after the last dot; the whole text if there is none."""
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def is_raw(path: Column) -> Column:
    return extension(path).isin(*RAW_EXTENSIONS)


def is_xtrans(path: Column) -> Column:
    return F.lower(path).endswith(".raf")


def is_bayer(path: Column) -> Column:
    """Developed images (.exr, .tif) are the only ones without a mosaic."""
    return ~(path.endswith(".exr") | path.endswith(".tif"))


def is_sidecar(path: Column) -> Column:
    return path.endswith(".xmp") | path.endswith("darktable_exported")


def is_scan_noise(path: Column) -> Column:
    """Paths a validity scan passes over."""
    return path.contains("bad_src_files") | path.endswith(".txt") | path.endswith(".yaml")


def developed_path(path: Column) -> Column:
    return F.concat(F.replace(path, F.lit("src/Bayer"), F.lit("proc/lin_rec2020")), F.lit(".tif"))


def aligned_name(image_set: Column, name: Column, other: Column) -> Column:
    return F.concat(image_set, F.lit("_"), name, F.lit("_aligned_to_"), other)


def mask_name(image_set: Column, gt_name: Column, f_name: Column) -> Column:
    """At most 255 characters, extension included."""
    base = F.translate(F.concat_ws("-", image_set, gt_name, f_name), "/", "_")
    return F.concat(F.substring(base, 1, 251), F.lit(".png"))


def image_key(y_path: Column, image_set: Column, gt_path: Column) -> Column:
    """Key of one image's results; the aligned-to part is added once."""
    name = path_leaf(y_path)
    key = F.when(image_set.isNull(), name).otherwise(F.concat(image_set, F.lit("_"), name))
    already = gt_path.contains("aligned_to") & gt_path.contains(image_set)
    first = F.split_part(gt_path, F.lit("_aligned_to_"), F.lit(1))
    inner = F.split_part(first, F.concat(image_set, F.lit("_")), F.lit(-1))
    partner = path_leaf(F.when(already, inner).otherwise(gt_path))
    return F.when(gt_path.isNull() | key.contains("aligned_to"), key).otherwise(
        F.concat(key, F.lit("_aligned_to_"), partner)
    )


def checksum(content: Column, kind: str = "sha1") -> Column:
    if kind == "sha1":
        return F.sha1(content)
    if kind == "sha256":
        return F.sha2(content, 256)
    raise ValueError(f"unknown checksum {kind!r}")


def short_hash(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 8)
