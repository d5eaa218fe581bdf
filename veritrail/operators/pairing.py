"""Pairing manifest rows with files: joins that never pick a winner among ambiguous names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.sources.manifest import basename, is_clutter, is_image

ISSUE = ("kind", "filename", "row_number", "message")
#: Order of the report's issues.
KINDS = ("missing_column", "invalid_row", "unsupported_file", "duplicate_file", "duplicate_row", "row_without_image", "image_without_row")


def folded(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit("ß"), F.lit("ss")))


def _unique(df: DataFrame, key: Column | str) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(key)) == 1


def pair(rows: DataFrame, files: DataFrame, invalid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (filename, row_number, file, upload_no) and issues (kind, filename, row_number, message).

    rows: row_number, filename; files: upload_no, file (a path or name); invalid: issues of the
    manifest's bad rows, whose files are explained already. A name given twice on either side is
    used by neither. Names equal but for case pair only among what exact names left over, and only
    one to one.
    """
    named = files.select("upload_no", basename(F.col("file")).alias("file")).filter(~is_clutter(F.col("file")))
    unsupported = named.filter(~is_image(F.col("file")))
    images = named.filter(is_image(F.col("file"))).withColumn("once", _unique(named, "file"))
    given = rows.withColumn("once", _unique(rows, "filename"))
    own_files, own_rows = images.filter("once").drop("once"), given.filter("once").drop("once")
    exact = own_rows.join(own_files, own_rows.filename == own_files.file)
    left_rows = own_rows.join(own_files.select("file"), own_rows.filename == F.col("file"), "left_anti").withColumn("key", folded(F.col("filename")))
    left_files = own_files.join(own_rows.select("filename"), F.col("filename") == own_files.file, "left_anti").withColumn("key", folded(F.col("file")))
    r = left_rows.withColumn("n_rows", F.count(F.lit(1)).over(Window.partitionBy("key")))
    f = left_files.withColumn("n_files", F.count(F.lit(1)).over(Window.partitionBy("key")))
    loose = r.filter("n_rows = 1").join(f.filter("n_files = 1"), "key").drop("key", "n_rows", "n_files")
    pairs = exact.unionByName(loose.select(*exact.columns)).withColumn("loose", F.col("filename") != F.col("file"))

    issue = lambda df, kind, name, row, message: df.select(F.lit(kind).alias("kind"), name.alias("filename"), row.cast("int").alias("row_number"), message.alias("message"))
    none = F.lit(None)
    two_files = images.filter(~F.col("once")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    two_rows = given.filter(~F.col("once")).groupBy("filename").agg(F.min("row_number").alias("first"), F.array_sort(F.collect_list("row_number")).alias("all"))
    # a row whose image was offered twice, and a file named by bad or doubled rows, are explained already
    explained_rows = own_rows.join(two_files.select("file"), own_rows.filename == F.col("file"), "left_semi").select("row_number")
    unmatched_rows = own_rows.join(pairs.select("row_number"), "row_number", "left_anti").join(explained_rows, "row_number", "left_anti")
    counts = f.groupBy("key").agg(F.count(F.lit(1)).alias("alike"))
    lonely = unmatched_rows.withColumn("key", folded(F.col("filename"))).join(counts, "key", "left")
    why = F.when(F.col("alike") > 0, F.lit("names that differ only in case fit it in more than one way")).otherwise(F.lit("no image has this name"))
    used_names = given.filter(~F.col("once")).select(F.col("filename").alias("bad"))
    if invalid is not None:
        used_names = used_names.unionByName(invalid.filter("filename is not null").select(F.col("filename").alias("bad")))
    unmatched_files = own_files.join(pairs.select("upload_no"), "upload_no", "left_anti").join(used_names.distinct(), own_files.file == F.col("bad"), "left_anti")
    issues = [
        issue(unsupported, "unsupported_file", F.col("file"), none, F.lit("not an image format that is read")),
        issue(two_files, "duplicate_file", F.col("file"), none, F.concat(F.col("n").cast("string"), F.lit(" files have this name"))),
        issue(two_rows, "duplicate_row", F.col("filename"), F.col("first"), F.concat(F.lit("rows "), F.array_join(F.transform("all", lambda x: x.cast("string")), ", "), F.lit(" name this file"))),
        issue(lonely, "row_without_image", F.col("filename"), F.col("row_number"), why),
        issue(unmatched_files, "image_without_row", F.col("file"), none, F.lit("no row names this image")),
    ]
    out = issues[0]
    for x in issues[1:]:
        out = out.unionByName(x)
    return pairs.select("filename", "row_number", "file", "upload_no", "loose"), out.unionByName(invalid.select(*ISSUE)) if invalid is not None else out


def report(rows: DataFrame, pairs: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: rows, pairs, issues, and whether the batch can't start."""
    a = pairs.agg(F.count(F.lit(1)).alias("pairs"))
    b = issues.agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("kind") == "missing_column").alias("missing_columns"))
    c = rows.agg(F.count(F.lit(1)).alias("rows"))
    return a.crossJoin(b).crossJoin(c).withColumn("blocking", (F.col("missing_columns") > 0) | (F.col("pairs") == 0))


def ordered_issues(issues: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return issues.orderBy(rank, F.col("row_number").asc_nulls_first(), "filename")


def local_file(items: DataFrame, files: DataFrame) -> DataFrame:
    """The file of each worklist item: by name, else by name without case if just one fits, else null."""
    pairs, _ = pair(items.select(F.col("filename"), F.col("row_number")), files)
    return items.join(pairs.select("row_number", "file"), "row_number", "left")


def selection(files: DataFrame) -> DataFrame:
    """Chosen files without clutter and without the same file twice; kind is manifest or image."""
    kept = files.filter(~is_clutter(F.col("name"))).dropDuplicates(["name", "size", "modified"])
    return kept.withColumn("kind", F.when(F.endswith(F.lower("name"), F.lit(".csv")), "manifest").otherwise("image"))
