"""Catalogue queries over assets, uploads, alignments and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.text import contained_path

PAGE_SIZE = (1, 500, 100)
REMESH_LIMIT = "INTERVAL 30 MINUTES"


def owned(rows: DataFrame, owner: int) -> DataFrame:
    return rows.filter(F.col("owner_id") == owner)


def filtered(rows: DataFrame, **equal) -> DataFrame:
    """Equality filters; arguments that are None or empty filter nothing."""
    for column, value in equal.items():
        if value not in (None, ""):
            rows = rows.filter(F.col(column) == value)
    return rows


def page(rows: DataFrame, number: int = 1, size: int = 100, *order: Column) -> DataFrame:
    """A page of the newest rows: size 1 to 500 (else 100), number from 1; ties by id."""
    low, high, default = PAGE_SIZE
    size = size if low <= size <= high else default
    order = order or (F.desc("created_at"), F.col("id"))
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def by_id(rows: DataFrame, owner: int, row_id, **equal) -> DataFrame:
    return filtered(owned(rows, owner), id=row_id, **equal).limit(1)


def summary(assets: DataFrame) -> DataFrame:
    """Assets as a list shows them: the colour only of point clouds, and a struct of the remesh job.

    assets: id, type, source_name, source_size, status, error_message, created_at, pointcloud_color, remesh_status, has_file
    (whether the remeshed file is there), vertex_before, face_before, vertex_after, face_after.
    """
    is_model = F.col("type") == "bim"
    counts = [F.col(c) for c in ("vertex_before", "face_before", "vertex_after", "face_after")]
    state, retry, stats = remesh_summary(F.col("remesh_status"), F.col("has_file"), counts)
    only = lambda c: F.when(is_model, c)
    done = is_model & (state == "succeeded")
    remesh = F.struct(is_model.alias("supported"), only(state).alias("status"), only(retry).alias("canRetry"), F.when(done, F.col("id")).alias("resultId"), F.when(done, stats).alias("stats"))
    color = F.when(F.col("type") == "pointcloud", F.lower(F.trim("pointcloud_color")))
    return assets.select("id", "type", F.col("source_name").alias("sourceName"), F.col("source_size").alias("sourceSize"), "status", F.col("error_message").alias("errorMessage"), F.col("created_at").alias("createdAt"), remesh.alias("meshRemesh"), color.alias("pointcloudColor"))


def detail(assets: DataFrame) -> DataFrame:
    """With addresses of model, metadata or tiles once an asset is ready."""
    ready = F.col("status") == "ready"
    url = lambda kind, tail: F.when(ready & (F.col("type") == kind), F.concat(F.lit("/assets/"), F.col("id").cast("string"), F.lit(tail)))
    return assets.select("id", "type", "status", url("bim", "/model.glb").alias("model_url"), url("bim", "/metadata.json").alias("metadata_url"), url("pointcloud", "/tiles/tileset.json").alias("tiles_url"))


def remesh_summary(status: Column, has_file: Column, counts: list[Column]) -> tuple[Column, Column, Column]:
    """(status, whether it may be tried again, counts if any is above zero) of a remesh job and its file."""
    blank = F.coalesce(F.trim(status), F.lit("")) == ""
    state = F.when(blank & has_file, "succeeded").when(blank, "idle").when((status == "succeeded") & ~has_file, "failed").otherwise(status)
    some = F.greatest(*[F.coalesce(c, F.lit(0)) for c in counts]) > 0
    return state, state.isin("failed", "idle"), F.when(some, F.struct(*counts))


def may_queue_remesh(status: Column, force: bool = False) -> Column:
    if force:
        return ~F.coalesce(status, F.lit("")).isin("queued", "processing")
    return status.isNull() | (status == "") | ~status.isin("queued", "processing", "succeeded")


def expired(status: Column, since: Column, now: Column) -> Column:
    """queued or processing for over half an hour counts as failed."""
    return F.when(status.isin("queued", "processing") & (since < now - F.expr(REMESH_LIMIT)), "failed").otherwise(status)


def reconciled(status: Column, has_file: Column) -> Column:
    return F.when((F.coalesce(status, F.lit("")) == "") & has_file, "succeeded").when((status == "succeeded") & ~has_file, "failed").otherwise(status)


def recovered(jobs: DataFrame) -> DataFrame:
    """After a crash: what was in work is queued again, oldest first."""
    again = jobs.filter(F.col("status").isin("processing", "queued"))
    return again.withColumn("status", F.lit("queued")).orderBy("created_at", "id")


def request_code(status: Column, force: bool = False) -> Column:
    return F.when(status.isin("queued", "processing"), 409).when((status == "succeeded") & F.lit(not force), 409).otherwise(202)


def result_code(status: Column, has_file: Column) -> Column:
    return F.when(status.isin("queued", "processing"), 409).when((status == "succeeded") & has_file, 200).otherwise(404)


def claimable(job_id, expected: str, token: Column | None = None) -> Column:
    """Whether a job is the one meant and still as expected (and was started when the token says)."""
    fits = (F.col("id") == job_id) & (F.col("status") == expected)
    return fits if token is None else fits & (F.col("started_at") == token)


def claimed(jobs: DataFrame, job_id, expected: str, to: str, token: Column | None = None) -> DataFrame:
    """Compare and set: the row changes only if it still is as expected (and holds the token)."""
    return jobs.withColumn("status", F.when(claimable(job_id, expected, token), F.lit(to)).otherwise(F.col("status")))


def with_alignment(scans: DataFrame, alignments: DataFrame) -> DataFrame:
    """scans with the number of their alignments, one grouped join in place of a lookup each."""
    n = alignments.groupBy("owner_id", F.col("scan_id").alias("id")).agg(F.count("*").alias("n_alignments"))
    return scans.join(n, ["owner_id", "id"], "left").withColumn("n_alignments", F.coalesce("n_alignments", F.lit(0))).withColumn("aligned", F.col("n_alignments") > 0)


def first_alignment(scans: DataFrame, alignments: DataFrame) -> DataFrame:
    """scans with the alignment of least id, or nulls. A pre-aggregated least, no sort."""
    columns = [c for c in alignments.columns if c not in ("owner_id", "scan_id")]
    first = alignments.groupBy("owner_id", "scan_id").agg(F.min(F.struct("id", *[c for c in columns if c != "id"])).alias("a"))
    return scans.join(first.withColumnRenamed("scan_id", "id"), ["owner_id", "id"], "left").select(*[scans[c] if c not in ("owner_id", "id") else F.col(c) for c in scans.columns], *[F.col(f"a.{c}").alias(f"alignment_{c}") for c in columns])


def with_model_name(alignments: DataFrame, assets: DataFrame) -> DataFrame:
    """alignments with the name of their model, null unless it is a ready model of the owner."""
    models = assets.filter("type = 'bim' and status = 'ready'").select(F.col("id").alias("bim_id"), "owner_id", F.col("source_name").alias("bim_name"))
    return alignments.join(models, ["bim_id", "owner_id"], "left")


def alignment_of(alignments: DataFrame, scan_id: int, bim_id: int, owner: int) -> DataFrame:
    return alignments.filter((F.col("scan_id") == scan_id) & (F.col("bim_id") == bim_id) & (F.col("owner_id") == owner))


def calibrated_pairs(assets: DataFrame, alignments: DataFrame) -> DataFrame:
    """One pair for each ready scan that an alignment joins with a ready model of its owner, newest scan first (none as oldest).

    The model is that of the scan's first alignment; where it isn't ready, the newest ready one that any alignment names.
    Names that are missing are made from the ids.
    """
    ready = assets.filter("status = 'ready'")
    name = lambda kind: F.coalesce(F.nullif("source_name", F.lit("")), F.concat(F.lit(kind), F.col("id").cast("string")))
    scans = ready.filter("type = 'pointcloud'").select(F.col("id").alias("scan_id"), "owner_id", name("点云-").alias("scan_name"), F.col("created_at").alias("scan_created"))
    models = ready.filter("type = 'bim'").select(F.col("id").alias("bim_id"), "owner_id", name("BIM-").alias("bim_name"), F.col("created_at").alias("bim_created"))
    first = alignments.groupBy("scan_id", "owner_id").agg(F.min_by("bim_id", "id").alias("first_bim"))
    known = alignments.select("scan_id", "bim_id", "owner_id").distinct().join(models, ["bim_id", "owner_id"]).join(first, ["scan_id", "owner_id"])
    order = F.struct((F.col("bim_id") == F.col("first_bim")).alias("is_first"), "bim_created", (-F.col("bim_id")).alias("back"))
    best = known.groupBy("scan_id", "owner_id").agg(F.max_by(F.struct("bim_id", "bim_name"), order).alias("m"))
    joined = scans.join(best, ["scan_id", "owner_id"])
    pairs = joined.select(F.concat_ws(":", "scan_id", "m.bim_id").alias("key"), "scan_id", "m.bim_id", "owner_id", "scan_name", "m.bim_name", "scan_created")
    return pairs.orderBy(F.desc_nulls_last("scan_created"), "scan_id")


def ready_models(assets: DataFrame) -> DataFrame:
    """Ready models, oldest first, as a restart goes through them."""
    return assets.filter("type = 'bim' and status = 'ready'").orderBy("id")


def user_by_name(users: DataFrame, name: str) -> DataFrame:
    return users.filter(F.lower("username") == F.lower(F.lit(name)))


def resource_path(assets: DataFrame, resource: Column) -> DataFrame:
    """(id, path, code) of what is asked for: a ready model's glb or metadata, a ready scan's tiles/...; 404 for all else, 400 for a path that climbs out."""
    ready, kind = F.col("status") == "ready", F.col("type")
    tile = F.regexp_extract(resource, "^tiles/(.+)$", 1)
    model = F.when(resource == "glb", "model.glb").when(resource == "metadata", "metadata.json")
    inside = contained_path(tile)
    below = F.when((kind == "bim") & ready, model).when((kind == "pointcloud") & ready & (tile != "") & inside, F.concat(F.lit("tiles/"), tile))
    code = F.when(below.isNotNull(), 200).when((kind == "pointcloud") & ready & (tile != "") & ~inside, 400).otherwise(404)
    return assets.select("id", F.concat_ws("/", "dir", below).alias("path"), code.alias("code")).withColumn("path", F.when(F.col("code") == 200, F.col("path")))


def colored_result(results: DataFrame, scan_id: int, bim_id: int, owner: int) -> DataFrame:
    """The coloured mesh of a pair's result, none where its path is empty."""
    return alignment_of(results, scan_id, bim_id, owner).filter("colored_ply_path <> ''").select("scan_id", "bim_id", "colored_ply_path")


def latest_results(results: DataFrame) -> DataFrame:
    """The newest result of each (scan, model, owner). A pre-aggregated greatest, no sort."""
    rest = [c for c in results.columns if c not in ("scan_id", "bim_id", "owner_id")]
    newest = results.groupBy("scan_id", "bim_id", "owner_id").agg(F.max(F.struct("created_at", "id", *[c for c in rest if c not in ("created_at", "id")])).alias("r"))
    return newest.select("scan_id", "bim_id", "owner_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def fine_alignment_refusal(matrix: Column, distance: Column, rmse_ratio: Column, fitness_ratio: Column) -> Column:
    """0, or 400 where a request for fine alignment has no 16 numbers or a limit that isn't above zero."""
    return F.when(F.coalesce(F.size(matrix), F.lit(0)) != 16, 400).when((distance <= 0) | (rmse_ratio <= 0) | (fitness_ratio <= 0), 400).otherwise(0)


def upload_view(uploads: DataFrame, assets: DataFrame) -> DataFrame:
    """uploads with status and asset; a ready upload whose asset is gone counts as failed."""
    known = assets.select(F.col("id").alias("known_id"))
    joined = uploads.join(known, F.col("asset_id") == F.col("known_id"), "left")
    gone = (F.col("status") == "ready") & F.col("known_id").isNull()
    return joined.select("id", F.when(gone, "failed").otherwise(F.col("status")).alias("status"), F.col("known_id").alias("asset_id"))


def best_source(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """One file an asset: its own first, then uploads, ready before others, newest first. existing: asset_id, path, own."""
    files = existing.join(uploads.select("asset_id", "path", "status", "created_at"), ["asset_id", "path"], "left")
    order = (F.when(F.col("own"), 0).otherwise(1), F.when(F.col("status") == "ready", 0).otherwise(1), F.desc_nulls_last("created_at"), "path")
    return files.withColumn("rank", F.row_number().over(Window.partitionBy("asset_id").orderBy(*order))).filter("rank = 1").drop("rank")


def find_element(elements: DataFrame, wanted: DataFrame) -> DataFrame:
    """The element of each wanted (key): by its id, else the first by step id, its own id or name. Three equi-joins, no disjunction."""
    at = F.struct(F.col("element_id").cast("bigint").alias("order"), "element_id", "step_id", "name", "type")
    ways = [elements.select(F.col("element_id").alias("key"), F.lit(0).alias("way"), at.alias("e")), elements.select(F.col("step_id").cast("string").alias("key"), F.lit(1).alias("way"), at.alias("e")), elements.select(F.col("name").alias("key"), F.lit(1).alias("way"), at.alias("e"))]
    every = ways[0].unionAll(ways[1]).unionAll(ways[2])
    found = every.join(wanted, "key", "left_semi").groupBy("key").agg(F.min(F.struct("way", "e")).alias("m"))
    return wanted.join(found, "key", "left").select("key", F.col("m.e.element_id").alias("element_id"), F.col("m.e.name").alias("name"), F.col("m.way").alias("way"))


def unmatched_ready(assets: DataFrame, valid: DataFrame) -> DataFrame:
    """Ready assets without valid files, to be marked failed. valid: id."""
    return assets.filter("status = 'ready'").join(valid, "id", "left_anti").withColumn("status", F.lit("failed"))


def upserted(rows: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """rows with those of new put in place of rows with equal keys; `sources.versions` publishes it."""
    return rows.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True).select(*rows.columns)


def partly_updated(rows: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """rows whose columns that new names have new's values where keys match; others stay."""
    changed = [c for c in new.columns if c not in keys]
    joined = rows.join(new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in changed], F.lit(True).alias("is_new")), list(keys), "left")
    return joined.select(*[F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in rows.columns])


def latest(rows: DataFrame, kind: str) -> DataFrame:
    return rows.filter((F.col("type") == kind) & (F.col("status") == "ready")).agg(F.max_by(F.struct("id", "source_name", "created_at"), F.struct("created_at", "id")).alias("a")).select("a.*")


def set_color(rows: DataFrame, asset_id: int, color: str) -> DataFrame:
    value = F.lit(color.lower()) if color else F.lit(None).cast("string")
    return rows.withColumn("pointcloud_color", F.when(F.col("id") == asset_id, value).otherwise(F.col("pointcloud_color")))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select("id"), "id", "left_anti")
