"""Capture catalogue over the given tables."""

from pyspark.sql import functions as F

from pairlake.functions import naming as N
from pairlake.operators import catalog as C
from pairlake.plans import tables as T
from pairlake.plans.common import query, table

_RAW_SQL = "(" + ", ".join(f"'{e}'" for e in N.RAW_EXTENSIONS) + ")"
_NAME = N.CAPTURE_NAME


def _ext(path: str) -> str:
    return f"lower(string_split({path}, '.')[-1])"


@query(
    "parse_capture_name",
    "filename:s sensor:s scene:s role:s",
    f"""WITH {T.MANIFEST_SQL} SELECT filename,
      CASE WHEN regexp_matches(filename, '{_NAME}') THEN regexp_extract(filename, '{_NAME}', 1) END AS sensor,
      CASE WHEN regexp_matches(filename, '{_NAME}')
        THEN regexp_replace(regexp_extract(filename, '{_NAME}', 2), '_GT$', '') END AS scene,
      CASE WHEN regexp_matches(filename, '{_NAME}')
        THEN CASE WHEN contains(filename, '_GT_') THEN 'gt' ELSE 'noisy' END END AS role FROM manifest""",
)
def parse_capture_name(spark, sf):
    return C.parse_capture_name(T.manifest(spark, sf).select("filename"))


@query(
    "unparsed_names",
    "filename:s path:s",
    f"WITH {T.MANIFEST_SQL} SELECT filename, path FROM manifest WHERE NOT regexp_matches(filename, '{_NAME}')",
)
def unparsed_names(spark, sf):
    return C.unparsed_names(T.manifest(spark, sf))


@query(
    "parse_capture_path",
    "path:s sensor:s image_set:s role:s filename:s ext:s",
    f"""WITH {T.MANIFEST_SQL} SELECT path, CASE WHEN from_bayer THEN 'Bayer' ELSE 'lin_rec2020' END AS sensor,
      image_set, role, filename, lower(ext) AS ext FROM manifest""",
)
def parse_capture_path(spark, sf):
    return C.parse_capture_path(T.manifest(spark, sf).select("path"))


@query(
    "file_kinds",
    "path:s raw:b xtrans:b bayer:b",
    f"""WITH {T.MANIFEST_SQL} SELECT path, {_ext('path')} IN {_RAW_SQL} AS raw,
      lower(path) LIKE '%.raf' AS xtrans, NOT (path LIKE '%.exr' OR path LIKE '%.tif') AS bayer FROM manifest""",
)
def file_kinds(spark, sf):
    path = F.col("path")
    return T.manifest(spark, sf).select(
        "path", N.is_raw(path).alias("raw"), N.is_xtrans(path).alias("xtrans"), N.is_bayer(path).alias("bayer")
    )


@query(
    "drop_sidecars",
    "path:s",
    f"""WITH {T.MANIFEST_SQL} SELECT path FROM manifest
      WHERE NOT (path LIKE '%.xmp' OR path LIKE '%darktable\\_exported' ESCAPE '\\')""",
)
def drop_sidecars(spark, sf):
    return C.drop_sidecars(T.manifest(spark, sf))


@query(
    "scan_candidates",
    "path:s",
    f"""WITH {T.MANIFEST_SQL} SELECT path FROM manifest
      WHERE NOT (contains(path, 'bad_src_files') OR path LIKE '%.txt' OR path LIKE '%.yaml')""",
)
def scan_candidates(spark, sf):
    return C.scan_candidates(T.manifest(spark, sf))


_ORIGIN_SQL = f"""origin AS (SELECT seq, iso, CASE seq % 13 WHEN 4 THEN 'Lossy/' WHEN 6 THEN 'Own-Set/' ELSE '' END
  || filename AS path FROM manifest)"""


def _origin(spark, sf):
    folder = F.when(F.col("seq") % 13 == 4, "Lossy/").when(F.col("seq") % 13 == 6, "Own-Set/").otherwise("")
    return T.manifest(spark, sf).select("seq", "iso", F.concat(folder, "filename").alias("path"))


@query(
    "select_low_iso",
    "path:s iso:i destination:s",
    f"""WITH {T.MANIFEST_SQL}, {_ORIGIN_SQL} SELECT path, iso,
      CASE WHEN lower(path) LIKE '%raf' THEN 'X-Trans' ELSE 'Bayer' END AS destination FROM origin
    WHERE {_ext('path')} IN {_RAW_SQL} AND NOT contains(lower(path), 'own-set')
      AND NOT contains(lower(path), 'lossy') AND iso <= 300""",
)
def select_low_iso(spark, sf):
    return C.select_low_iso(_origin(spark, sf), max_iso=300, skip_sets=("own-set",))


@query(
    "unknown_iso",
    "path:s",
    f"""WITH {T.MANIFEST_SQL}, {_ORIGIN_SQL} SELECT path FROM origin
    WHERE {_ext('path')} IN {_RAW_SQL} AND NOT contains(lower(path), 'own-set') AND iso IS NULL""",
)
def unknown_iso(spark, sf):
    return C.unknown_iso(_origin(spark, sf), skip_sets=("own-set",))


@query(
    "valid_output",
    "path:s size:i",
    f"WITH {T.MANIFEST_SQL} SELECT path, size FROM manifest WHERE size > 10000000",
)
def valid_output(spark, sf):
    return C.valid_output(T.manifest(spark, sf))


_ISOS = [str(100 * i) for i in range(1, 9)] + ["UnknownISO"]


@query(
    "dataset_summary",
    "split:s camera:s " + " ".join(f"ISO{i}:i" for i in _ISOS) + " scenes:i images:i",
    f"""WITH {T.MANIFEST_SQL}, shots AS (
      SELECT coalesce(trim(camera), 'UnknownCamera') AS camera, coalesce(CAST(iso AS VARCHAR), 'UnknownISO') AS iso,
        CASE WHEN contains(image_set, 'en-1') OR contains(image_set, '-7') THEN 'test' ELSE 'train' END AS split,
        image_set AS scene FROM manifest WHERE {_ext('path')} IN {_RAW_SQL}),
    cells AS (SELECT c.camera, g.split FROM (SELECT DISTINCT camera FROM shots) c,
      (SELECT unnest(['train', 'test']) AS split) g),
    counted AS (SELECT camera, split, {", ".join(f"count(*) FILTER (iso = '{i}') AS ISO{i}" for i in _ISOS)},
      count(DISTINCT scene) AS scenes, count(*) AS images FROM shots GROUP BY camera, split),
    filled AS (SELECT cells.split, cells.camera, {", ".join(f"coalesce(ISO{i}, 0) AS ISO{i}" for i in _ISOS)},
      coalesce(scenes, 0) AS scenes, coalesce(images, 0) AS images
      FROM cells LEFT JOIN counted USING (camera, split))
    SELECT * FROM filled UNION ALL SELECT split, 'Total', {", ".join(f"sum(ISO{i})" for i in _ISOS)},
      sum(scenes), sum(images) FROM filled GROUP BY split""",
)
def dataset_summary(spark, sf):
    exif = T.manifest(spark, sf).select("path", "camera", "iso", F.col("image_set").alias("scene"))
    return C.dataset_summary(exif, reserve=["en-1", "-7"])


@query(
    "sort_iso_labels",
    "iso:s place:i",
    f"""WITH {T.MANIFEST_SQL}, labels AS (SELECT DISTINCT coalesce(CAST(iso AS VARCHAR), 'UnknownISO') AS iso
      FROM manifest) SELECT iso, row_number() OVER (ORDER BY try_cast(iso AS BIGINT) NULLS LAST) AS place FROM labels""",
)
def sort_iso_labels(spark, sf):
    from pairlake.operators.scan import ranked

    labels = C.iso_labels(T.manifest(spark, sf))
    return ranked(labels, [], [F.expr("try_cast(iso AS bigint)").asc_nulls_last()], "place")


@query(
    "count_extensions",
    "ext:s files:i",
    f"""WITH {T.MANIFEST_SQL} SELECT '.' || lower(ext) AS ext, count(*) AS files FROM manifest
      WHERE lower(ext) NOT IN {_RAW_SQL} GROUP BY ALL""",
)
def count_extensions(spark, sf):
    return C.count_extensions(T.manifest(spark, sf))


@query(
    "scene_counts",
    "image_set:s clean:i noisy:i",
    f"""WITH {T.MANIFEST_SQL} SELECT image_set, count(*) FILTER (role = 'gt') AS clean,
      count(*) FILTER (role <> 'gt') AS noisy FROM manifest WHERE {_ext('path')} IN {_RAW_SQL} GROUP BY image_set""",
)
def scene_counts(spark, sf):
    return C.scene_counts(T.manifest(spark, sf))


@query(
    "highest_entry",
    "folder:s highest:s",
    f"""WITH {T.MANIFEST_SQL} SELECT folder, CAST(max(CAST(name AS BIGINT)) AS VARCHAR) AS highest FROM (
      SELECT folder, CASE WHEN seq % 3 = 0 THEN CAST(seq AS VARCHAR) ELSE filename END AS name FROM manifest)
    WHERE regexp_full_match(name, '\\d+') GROUP BY folder""",
)
def highest_entry(spark, sf):
    name = F.when(F.col("seq") % 3 == 0, F.col("seq").cast("string")).otherwise(F.col("filename"))
    return C.highest_entry(T.manifest(spark, sf).select("folder", name.alias("name")))


@query(
    "last_modified",
    "folder:s newest:s mtime:i",
    f"""WITH {T.MANIFEST_SQL} SELECT folder, arg_max(filename, (mtime, filename)) AS newest, max(mtime) AS mtime
    FROM manifest WHERE filename NOT IN ('IMG1.cr2', 'IMG2.nef') AND filename LIKE 'Bayer%'
      AND NOT filename LIKE '%.xmp' GROUP BY folder""",
)
def last_modified(spark, sf):
    entries = T.manifest(spark, sf).select("folder", F.col("filename").alias("name"), "mtime")
    return C.last_modified(entries, exclude=["IMG1.cr2", "IMG2.nef"], prefix="Bayer", exclude_ext="xmp")


@query(
    "content_duplicates",
    "path:s sha1:s kept:s",
    f"""WITH {T.MANIFEST_SQL}, firsts AS (SELECT sha1, min(seq) AS seq, arg_min(path, seq) AS kept
      FROM manifest GROUP BY sha1)
    SELECT m.path, m.sha1, f.kept FROM manifest m JOIN firsts f ON f.sha1 = m.sha1 AND m.seq > f.seq""",
)
def content_duplicates(spark, sf):
    return C.content_duplicates(T.manifest(spark, sf).select("seq", "path", "sha1"))


@query(
    "import_names",
    "path:s filename:s destination:s",
    f"""WITH {T.MANIFEST_SQL}, named AS (SELECT seq, path, sha1, 'IMG' || seq % 2 || '.cr2' AS filename
      FROM manifest), firsts AS (SELECT filename, sha1, min(seq) AS seq, arg_min(path, seq) AS path
      FROM named GROUP BY filename, sha1)
    SELECT path, filename, filename || repeat('dupath.' || string_split(filename, '.')[-1],
      row_number() OVER (PARTITION BY filename ORDER BY seq) - 1) AS destination FROM firsts""",
)
def import_names(spark, sf):
    name = F.concat(F.lit("IMG"), (F.col("seq") % 2).cast("string"), F.lit(".cr2"))
    files = T.manifest(spark, sf).withColumn("filename", name).select("seq", "path", "sha1", "filename")
    return C.import_names(files)


@query(
    "checksums",
    "path:s sha1:s sha256:s short:s",
    f"""WITH {T.MANIFEST_SQL} SELECT path, sha1(content) AS sha1, sha256(content) AS sha256,
      sha256(path)[:8] AS short FROM manifest""",
)
def checksums(spark, sf):
    return T.manifest(spark, sf).select(
        "path",
        N.checksum(F.col("content")).alias("sha1"),
        N.checksum(F.col("content"), "sha256").alias("sha256"),
        N.short_hash(F.col("path")).alias("short"),
    )


_USABLE_SQL = """usable AS (SELECT * FROM manifest WHERE NOT path LIKE '%.xmp'),
preferred AS (SELECT * FROM usable u WHERE from_bayer OR image_set NOT IN (
  SELECT image_set FROM usable WHERE from_bayer)),
paired AS (SELECT g.image_set, g.path AS gt_path, f.path AS f_path, f.seq AS f_seq, g.seq AS gt_seq
  FROM preferred g JOIN preferred f ON f.image_set = g.image_set WHERE g.role = 'gt')"""


def _paired(spark, sf):
    return C.make_pairs(C.prefer_bayer(C.drop_sidecars(T.manifest(spark, sf))))


@query(
    "prefer_bayer",
    "path:s image_set:s from_bayer:b",
    f"WITH {T.MANIFEST_SQL}, {_USABLE_SQL} SELECT path, image_set, from_bayer FROM preferred",
)
def prefer_bayer(spark, sf):
    return C.prefer_bayer(C.drop_sidecars(T.manifest(spark, sf)))


@query(
    "make_pairs",
    "image_set:s gt_path:s f_path:s",
    f"WITH {T.MANIFEST_SQL}, {_USABLE_SQL} SELECT image_set, gt_path, f_path FROM paired",
)
def make_pairs(spark, sf):
    return _paired(spark, sf)


_DONE_SQL = "done AS (SELECT path FROM manifest WHERE n_chars % 2 = 0)"


@query(
    "pending_pairs",
    "gt_path:s f_path:s",
    f"""WITH {T.MANIFEST_SQL}, {_USABLE_SQL}, {_DONE_SQL} SELECT gt_path, f_path FROM paired p WHERE NOT (
      gt_path IN (SELECT path FROM done) AND f_path IN (SELECT path FROM done))""",
)
def pending_pairs(spark, sf):
    recorded = T.manifest(spark, sf).filter(F.col("n_chars") % 2 == 0)
    done = C.make_pairs(C.drop_sidecars(recorded))
    return C.pending(_paired(spark, sf), done, ["gt_path", "f_path"])


@query(
    "pending_files",
    "path:s",
    f"WITH {T.MANIFEST_SQL}, {_DONE_SQL} SELECT path FROM manifest WHERE path NOT IN (SELECT path FROM done)",
)
def pending_files(spark, sf):
    files = T.manifest(spark, sf).select("path", "n_chars")
    return C.pending(files.select("path"), files.filter(F.col("n_chars") % 2 == 0), ["path"])


_PARSED_CROPS = "developed AS (SELECT c.*, m.path AS source FROM crops c JOIN manifest m ON m.seq = c.seq)"


@query(
    "match_crops",
    "image_set:s gt_path:s f_path:s x:i y:i f_linrec2020_fpath:s gt_linrec2020_fpath:s "
    "f_bayer_fpath:s gt_bayer_fpath:s",
    f"""WITH {T.MANIFEST_SQL}, {_USABLE_SQL}, {T.CROPS_SQL}, leaves AS (
      SELECT image_set, x, y, path, regexp_extract(path, '([^/]*)\\.\\d+_\\d+\\.tif$', 1) AS base FROM crops)
    SELECT p.image_set, gt_path, f_path, f.x, f.y, f.path AS f_linrec2020_fpath, g.path AS gt_linrec2020_fpath,
      regexp_replace(replace(f.path, 'proc/lin_rec2020', 'src/Bayer'), '\\.tif$', '.npy') AS f_bayer_fpath,
      regexp_replace(replace(g.path, 'proc/lin_rec2020', 'src/Bayer'), '\\.tif$', '.npy') AS gt_bayer_fpath
    FROM paired p JOIN leaves f ON f.image_set = p.image_set AND f.base = regexp_extract(p.f_path, '[^/]*$')
      JOIN leaves g ON g.image_set = p.image_set AND g.base = regexp_extract(p.gt_path, '[^/]*$')
        AND g.x = f.x AND g.y = f.y""",
)
def match_crops(spark, sf):
    return C.with_bayer_crops(C.match_crops(_paired(spark, sf), T.crops(T.manifest(spark, sf))))


@query(
    "missing_bayer_crops",
    "path:s",
    f"""WITH {T.MANIFEST_SQL}, {_USABLE_SQL}, {T.CROPS_SQL}, leaves AS (
      SELECT image_set, seq, x, y, path, regexp_extract(path, '([^/]*)\\.\\d+_\\d+\\.tif$', 1) AS base,
        regexp_replace(replace(path, 'proc/lin_rec2020', 'src/Bayer'), '\\.tif$', '.npy') AS npy FROM crops),
    matched AS (SELECT f.npy AS a, g.npy AS b FROM paired p
      JOIN leaves f ON f.image_set = p.image_set AND f.base = regexp_extract(p.f_path, '[^/]*$')
      JOIN leaves g ON g.image_set = p.image_set AND g.base = regexp_extract(p.gt_path, '[^/]*$')
        AND g.x = f.x AND g.y = f.y)
    SELECT DISTINCT path FROM (SELECT a AS path FROM matched UNION ALL SELECT b FROM matched)
    WHERE path NOT IN (SELECT npy FROM leaves WHERE seq % 5 > 0)""",
)
def missing_bayer_crops(spark, sf):
    crops = T.crops(T.manifest(spark, sf))
    stored = crops.filter(F.col("seq") % 5 > 0).select(C.bayer_crop_path(F.col("path")).alias("path"))
    return C.missing_bayer_crops(C.match_crops(_paired(spark, sf), crops), stored)


@query(
    "list_unpaired_crops",
    "path:s n:i first:s last:s",
    f"""WITH {T.MANIFEST_SQL}, {T.CROPS_SQL}, leaves AS (
      SELECT x, y, path, regexp_extract(path, '([^/]*)\\.\\d+_\\d+\\.tif$', 1) AS base FROM crops)
    SELECT m.path, count(*) AS n, arg_min(l.path, (l.x, l.y, l.path)) AS first, arg_max(l.path, (l.x, l.y, l.path)) AS last
    FROM manifest m JOIN leaves l ON l.base = m.filename GROUP BY m.path, m.seq""",
)
def list_unpaired_crops(spark, sf):
    files = T.manifest(spark, sf)
    listed = C.list_unpaired_crops(files.select("path"), T.crops(files))
    return listed.select(
        "path",
        F.size("crops").alias("n"),
        F.element_at("crops", 1)["gt_linrec2020_fpath"].alias("first"),
        F.element_at("crops", -1)["gt_linrec2020_fpath"].alias("last"),
    )


@query(
    "merge_results",
    "gt_path:s f_path:s mask_mean:d",
    f"""WITH {T.MANIFEST_SQL}, {_USABLE_SQL}, {_DONE_SQL} SELECT gt_path, f_path, 1.0::DOUBLE AS mask_mean
      FROM paired p WHERE NOT (gt_path IN (SELECT path FROM done) AND f_path IN (SELECT path FROM done))
    UNION ALL SELECT g.path, f.path, NULL FROM usable g JOIN usable f ON g.image_set = f.image_set
      WHERE g.role = 'gt' AND g.path IN (SELECT path FROM done) AND f.path IN (SELECT path FROM done)
        AND g.n_chars % 2 = 0 AND f.n_chars % 2 = 0""",
)
def merge_results(spark, sf):
    recorded = T.manifest(spark, sf).filter(F.col("n_chars") % 2 == 0)
    done = C.make_pairs(C.drop_sidecars(recorded)).select("gt_path", "f_path")
    new = C.pending(_paired(spark, sf), done, ["gt_path", "f_path"]).select("gt_path", "f_path")
    return C.merge_results(new.withColumn("mask_mean", F.lit(1.0)), done)


@query(
    "missing_scenes",
    "image_set:s",
    f"""WITH {T.PAIRS_SQL}, {T.RESERVE_SQL} SELECT image_set FROM (SELECT image_set FROM reserve UNION ALL
      SELECT 'absent-' || n_nationkey FROM nation) EXCEPT SELECT image_set FROM pairs""",
)
def missing_scenes(spark, sf):
    absent = table(spark, sf, "nation").select(
        F.concat(F.lit("absent-"), F.col("n_nationkey").cast("string")).alias("image_set")
    )
    return C.missing_scenes(T.reserve(spark, sf).unionByName(absent), T.pairs(spark, sf))


@query(
    "reserved_present",
    "image_set:s",
    f"WITH {T.PAIRS_SQL}, {T.RESERVE_SQL} SELECT image_set FROM pairs INTERSECT SELECT image_set FROM reserve",
)
def reserved_present(spark, sf):
    return C.reserved_present(T.reserve(spark, sf), T.pairs(spark, sf))


@query(
    "reserve_from_content",
    "image_set:s",
    f"""WITH {T.PAIRS_SQL} SELECT DISTINCT string_split(f_fpath, '/')[-2] AS image_set FROM pairs
      WHERE string_split(f_fpath, '/')[-2] <> 'gt'""",
)
def reserve_from_content(spark, sf):
    return C.reserve_from_content(T.pairs(spark, sf))


@query(
    "path_parts",
    "path:s leaf:s parent:s parent_name:s",
    f"""WITH {T.MANIFEST_SQL} SELECT path, string_split(path, '/')[-1] AS leaf,
      array_to_string(string_split(path, '/')[:-2], '/') AS parent, string_split(path, '/')[-2] AS parent_name
    FROM manifest""",
)
def path_parts(spark, sf):
    path = F.col("path")
    return T.manifest(spark, sf).select(
        "path",
        N.path_leaf(path).alias("leaf"),
        N.path_parent(path).alias("parent"),
        N.parent_name(path).alias("parent_name"),
    )


@query(
    "mask_name",
    "mask:s",
    f"""WITH {T.PAIRS_SQL} SELECT replace(image_set || '-gt/' || repeat('long', orderkey % 70) || partkey % 5 || '.cr2-n'
      || orderkey || '_' || linenumber || '.cr2', '/', '_')[:251] || '.png' AS mask FROM pairs""",
)
def mask_name(spark, sf):
    long = F.repeat(F.lit("long"), (F.col("orderkey") % 70).cast("int"))
    gt = F.concat(F.lit("gt/"), long, (F.col("partkey") % 5).cast("string"), F.lit(".cr2"))
    noisy = F.concat(F.lit("n"), F.col("orderkey").cast("string"), F.lit("_"), F.col("linenumber").cast("string"), F.lit(".cr2"))
    return T.pairs(spark, sf).select(N.mask_name(F.col("image_set"), gt, noisy).alias("mask"))


@query(
    "image_key",
    "image_key:s",
    f"""WITH {T.PAIRS_SQL}, shown AS (SELECT CASE WHEN partkey % 4 > 0 THEN image_set END AS image_set,
        CASE WHEN partkey % 7 = 1 THEN regexp_replace(f_fpath, '/n', '/n_aligned_to_') ELSE f_fpath END AS y_fpath,
        CASE WHEN partkey % 6 = 5 THEN NULL WHEN partkey % 3 = 0 THEN 'ds/' || image_set || '_g.tif_aligned_to_x.tif'
          ELSE gt_fpath END AS gt_fpath FROM pairs),
    keyed AS (SELECT *, CASE WHEN image_set IS NULL THEN '' ELSE image_set || '_' END
        || string_split(y_fpath, '/')[-1] AS k FROM shown)
    SELECT CASE WHEN gt_fpath IS NULL OR contains(k, 'aligned_to') THEN k
      ELSE k || '_aligned_to_' || string_split(CASE WHEN contains(gt_fpath, 'aligned_to')
        AND coalesce(contains(gt_fpath, image_set), false)
        THEN string_split(string_split(gt_fpath, '_aligned_to_')[1], image_set || '_')[-1]
        ELSE gt_fpath END, '/')[-1] END AS image_key FROM keyed""",
)
def image_key(spark, sf):
    p = F.col("partkey")
    shown = T.pairs(spark, sf).select(
        F.when(p % 4 > 0, F.col("image_set")).alias("image_set"),
        F.when(p % 7 == 1, F.replace("f_fpath", F.lit("/n"), F.lit("/n_aligned_to_")))
        .otherwise(F.col("f_fpath"))
        .alias("y_fpath"),
        F.when(p % 6 == 5, F.lit(None))
        .when(p % 3 == 0, F.concat(F.lit("ds/"), "image_set", F.lit("_g.tif_aligned_to_x.tif")))
        .otherwise(F.col("gt_fpath"))
        .alias("gt_fpath"),
    )
    return shown.select(N.image_key(F.col("y_fpath"), F.col("image_set"), F.col("gt_fpath")).alias("image_key"))


_ROUND = "xor(l{0}, ((r{0} * 2654435761 + {1}) >> 7) & m) AS r{2}, r{0} AS l{2}"
_FEISTEL_SQL = "x >> b AS l0, x & m AS r0, " + ", ".join(_ROUND.format(i, (7 * 1000003 + i * 7919) % (1 << 31), i + 1) for i in range(4))


@query(
    "seeded_shuffle",
    "path:s position:i",
    f"""WITH RECURSIVE {T.MANIFEST_SQL},
    ranks AS (SELECT path, seq, row_number() OVER (ORDER BY path, seq) - 1 AS x FROM manifest),
    sizes AS (SELECT n, b, CAST(pow(2, b) AS BIGINT) - 1 AS m FROM
      (SELECT n, CAST(greatest(1, ceil(ceil(log2(n)) / 2)) AS BIGINT) AS b FROM (SELECT count(*) AS n FROM manifest))),
    walk AS (SELECT path, seq, (l4 << b) | r4 AS x, 0 AS step FROM (SELECT *, {_FEISTEL_SQL} FROM ranks, sizes)
      UNION ALL SELECT path, seq, (l4 << b) | r4, step + 1 FROM (SELECT *, {_FEISTEL_SQL} FROM walk, sizes WHERE x >= n))
    SELECT path, x AS position FROM walk, sizes WHERE x < n""",
)
def seeded_shuffle(spark, sf):
    from pairlake.operators.samples import seeded_shuffle as shuffle

    return shuffle(T.manifest(spark, sf).select("path", "seq"), ["path", "seq"], seed=7)
