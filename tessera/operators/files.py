"""File catalogue jobs: quotas, upload admission, paging, MIME lookups,
upload rules, access flags and rendition plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.paging import page_bounds
from tessera.sources.tables import live

# Extension → MIME fallback table.
EXT_TO_MIME = {
    "mp3": "audio/mp3", "m4a": "audio/m4a",
    "gif": "image/gif", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tiff": "image/tiff",
    "bmp": "image/bmp",
    "mov": "video/quicktime", "qt": "video/quicktime", "mpg": "video/mpeg", "mpeg": "video/mpeg", "mp4": "video/mp4",
    "pdf": "application/pdf",
    "md": "text/plain", "txt": "text/plain", "htm": "text/html", "html": "text/html",
}
DEFAULT_MIME = "application/plain"

# MIME → extension when the file name has none.
MIME_TO_EXT = {
    "audio/x-mp3": "mp3", "audio/mp3": "mp3",
    "audio/x-mp4": "mp4", "audio/mp4": "mp4", "video/mp4": "mp4",
    "audio/x-m4a": "m4a", "audio/m4a": "m4a", "video/m4a": "m4a",
    "video/m4v": "m4v", "audio/mpeg": "mpeg",
    "image/jpeg": "jpeg", "image/jpg": "jpeg",
    "image/x-windows-bmp": "bmp", "image/bmp": "bmp",
    "image/gif": "gif", "image/png": "png", "image/tiff": "tiff",
    "video/quicktime": "mov", "application/x-mpegurl": "m3u8", "video/mp2t": "ts",
}

# Accepted upload MIME types.
VALID_UPLOAD_TYPES = [
    "audio/mp3", "audio/mp4", "audio/m4a", "audio/x-mp3", "audio/x-mp4", "audio/mpeg", "audio/x-m4a",
    "image/gif", "image/jpg", "image/jpeg", "image/pjpeg", "image/png", "image/tiff", "image/bmp", "image/x-windows-bmp",
    "video/quicktime", "video/mpeg", "image/x-quicktime",
    "application/pdf", "application/x-pdf",
    "application/x-bzip", "application/x-bzip2", "application/x-compressed", "application/x-gzip", "multipart/x-gzip",
    "application/plain", "text/plain", "text/html",
    "application/msword", "application/mspowerpoint", "application/powerpoint", "application/vnd.ms-powerpoint",
    "application/x-mspowerpoint",
    "application/vnd.ms-excel", "application/x-excel", "application/excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
]
# MIME types the upload path may resize.
RESIZABLE_TYPES = ["image/jpg", "image/jpeg", "image/png", "image/tiff", "image/bmp", "image/x-windows-bmp"]
# Valid access lists.
VALID_ACL = ["private", "public-read", "public-read-write"]


def _map_lookup(table: dict[str, str], key: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(m, key)


def file_extension(name: Column) -> Column:
    """Text after the last '.', trimmed ('' when there is no dot)."""
    return F.trim(F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(F.lit("")))


def mime_icon(mime: Column) -> Column:
    """Icon class by MIME group/type (office types all map to the one icon)."""
    m = F.lower(F.trim(F.coalesce(mime, F.lit(""))))
    group = F.split_part(m, F.lit("/"), F.lit(1))
    office = (F.instr(m, "officedocument.spreadsheetml") > 1) | (F.instr(m, "vnd.ms-excel") > 1) \
        | (F.instr(m, "officedocument.presentationml") > 1) | (F.instr(m, "vnd.ms-powerpoint") > 1) \
        | (F.instr(m, "officedocument.wordprocessingml") > 1) | (F.instr(m, "vnd.ms-word") > 1)
    return (F.when(group == "audio", "file-audio").when(group == "image", "file-image")
            .when(group == "video", "file-video").when(office, "file-powerpoint")
            .when(m == "application/zip", "file-zipper").when(m == "application/pdf", "file-pdf")
            .when(m.isin("application/javascript", "application/xhtml+xml", "application/xslt+xm",
                         "application/json", "application/xml"), "file-code")
            .otherwise("file-lines"))


def with_mime(df: DataFrame, name_col: str = "name", mime_col: str | None = None) -> DataFrame:
    """Extension (from the name, else from the MIME type), MIME type
    (given, else by extension, else the default) and icon class.

    The lookup tables are fixed literals folded into the plan — no join."""
    given = F.col(mime_col) if mime_col else F.lit(None).cast("string")
    ext = file_extension(F.col(name_col))
    ext = F.when(ext == "", F.coalesce(_map_lookup(MIME_TO_EXT, F.lower(F.trim(given))), F.lit(""))).otherwise(ext)
    mime = F.coalesce(F.nullif(F.trim(given), F.lit("")),
                      _map_lookup(EXT_TO_MIME, F.lower(ext)), F.lit(DEFAULT_MIME))
    return (df.withColumn("extension", ext).withColumn("mimetype", mime)
              .withColumn("icon", mime_icon(F.col("mimetype"))))


def valid_uploads(df: DataFrame, mime_col: str = "mimetype") -> DataFrame:
    """Upload allow-list and resizable-image flags."""
    m = F.col(mime_col)
    return (df.withColumn("is_valid_upload", F.coalesce(m.isin(VALID_UPLOAD_TYPES), F.lit(False)))
              .withColumn("is_resizable", F.coalesce(F.lower(m).isin(RESIZABLE_TYPES), F.lit(False))))


def acl_flags(df: DataFrame, acl_col: str = "acl", password_col: str | None = None) -> DataFrame:
    """Unknown access → private; a password forces private; then
    is_public / is_readonly flags."""
    acl = F.lower(F.trim(F.coalesce(F.col(acl_col), F.lit(""))))
    acl = F.when(acl.isin(VALID_ACL), acl).otherwise(F.lit("private"))
    if password_col:
        acl = F.when(F.length(F.trim(F.coalesce(F.col(password_col), F.lit("")))) > 0, F.lit("private")).otherwise(acl)
    out = df.withColumn("access", acl)
    return (out.withColumn("is_public", F.col("access") != "private")
               .withColumn("is_readonly", F.col("access") != "public-read-write"))


def quota_remaining(files: DataFrame, limits: DataFrame) -> DataFrame:
    """Per account, upload limit − bytes used by live files, floored at 0.

    ``limits``: (account_id, upload_limit).  Usage is pre-aggregated
    (map-side partial sums) before the join."""
    used = live(files).groupBy("account_id").agg(F.sum("bytes").alias("upload_bytes"))
    j = limits.join(used, "account_id", "left").fillna(0, ["upload_bytes"])
    return j.withColumn("bucket_remain", F.greatest(F.col("upload_limit") - F.col("upload_bytes"), F.lit(0)))


def _late_admission(late: DataFrame, partitions: int) -> DataFrame:
    """The files of all accounts that are admitted after their account's first
    overflow: (id).  ``late``: id, account_id, arrival, bytes and ``_R``, what
    the account has left, with 0 < bytes <= _R.

    Parallel phases by size class, for all accounts at once.  While an
    account's remainder R is in [2^k, 2^(k+1)), every file below 2^k fits, and
    the first larger one that fits takes R below 2^k.  So in a phase all small
    files are accepted up to the event that takes R below 2^k: the first large
    file with bytes <= R - S, S being the small ones' running sum, or the small
    file whose S does it.  Large files before the event do not fit.  The files
    after it go on with the new remainder, one bit shorter, so
    there are at most as many phases as the largest ``_R`` has bits.

    The files are put into ranges of (account, arrival, id) once; S is summed in
    each (account, range) and the ranges' totals before it are added, so a huge
    account is as many pieces as it has ranges.  A phase is checkpointed once
    (what is left shrinks, the lineage is cut)."""
    from tessera.operators.sequence import _materialise

    at = F.struct("arrival", "id")
    inside = Window.partitionBy("account_id", "_range").orderBy("arrival", "id").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("account_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    pool = _materialise(late.select("id", "account_id", "arrival", "bytes", "_R").repartitionByRange(partitions, "account_id", "arrival", "id")
                        .withColumn("_range", F.spark_partition_id()))
    admitted = late.select("id").limit(0)
    while not pool.isEmpty():
        floor = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin("_R")) - 1)
        x = pool.withColumn("_small", F.col("bytes") < floor)
        x = x.withColumn("_used", F.when(F.col("_small"), F.col("bytes")).otherwise(F.lit(0)).cast("long")).withColumn("_floor", floor)
        totals = x.groupBy("account_id", "_range").agg(F.sum("_used").alias("_sum"))
        totals = totals.select("account_id", "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
        x = x.withColumn("_S", F.sum("_used").over(inside)).join(totals, ["account_id", "_range"])
        x = x.withColumn("_left", F.col("_R") - F.col("_before") - F.col("_S"))
        ends = F.when(F.col("_small"), F.col("_left") < F.col("_floor")).otherwise(F.col("bytes") <= F.col("_left"))
        after = F.col("_left") - F.when(F.col("_small"), F.lit(0)).otherwise(F.col("bytes"))
        event = x.filter(ends).groupBy("account_id").agg(F.min(at).alias("_at"), F.min_by(after, at).alias("_next"))
        x = x.select("id", "account_id", "arrival", "bytes", "_range", "_small").join(event, "account_id", "left")
        # decided in this phase: up to the event, and what can never fit again
        x = x.withColumn("_now", F.col("_at").isNull() | (at <= F.col("_at")))
        x = x.withColumn("_in", F.col("_now") & (F.col("_small") | F.coalesce(at == F.col("_at"), F.lit(False))))
        x = _materialise(x.filter(F.col("_in") | (~F.col("_now") & (F.col("bytes") <= F.col("_next")))))
        admitted = admitted.unionByName(x.filter("_in").select("id"))
        pool = x.filter(~F.col("_in")).select("id", "account_id", "arrival", "bytes", F.col("_next").alias("_R"), "_range")
    return admitted


def admit_uploads(uploads: DataFrame, quotas: DataFrame, partitions: int | None = None) -> DataFrame:
    """Greedy upload admission per account in arrival order: a file is
    accepted if 0 < bytes ≤ remaining, and only accepted files use space
    (so it is not a plain running sum).  Output: id, account_id, accepted,
    remaining (after the file).

    ``uploads``: id (unique), account_id, arrival, bytes (NULL: nothing to
    admit); ``quotas``: account_id, quota (missing: 0).

    Exact, one way for accounts of every size, and no task goes through an
    account file by file:

    1. A skew-safe running sum P of the positive sizes per account (range
       partitions; a huge account spans many tasks).  Until the first file
       with P > quota every file fits, so all of them are decided at once:
       accepted iff bytes > 0, remaining = quota − P.
    2. After that first overflow the remainder R is below the overflowing
       file's size and only shrinks, so only files with 0 < bytes ≤ R can
       still be accepted: parallel phases by size class (``_late_admission``).
    3. Remaining for every later file is R minus a second skew-safe running
       sum of the accepted candidate sizes.
    """
    from tessera.operators.sequence import running_sum

    n = partitions or int(uploads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    u = uploads.select("id", "account_id", "arrival", F.coalesce(F.col("bytes").cast("long"), F.lit(0)).alias("bytes"))
    j = u.join(quotas.select("account_id", F.col("quota").cast("long").alias("_quota")), "account_id", "left") \
        .fillna(0, ["_quota"]).withColumn("_pos", F.greatest(F.col("bytes"), F.lit(0)))
    p = running_sum(j, "account_id", ["arrival", "id"], "_pos", "_P", partitions=n)
    head = p.filter(F.col("_P") <= F.col("_quota")).select(
        "id", "account_id", (F.col("bytes") > 0).alias("accepted"), (F.col("_quota") - F.col("_P")).alias("remaining"))
    tail = p.filter(F.col("_P") > F.col("_quota"))
    rest = tail.groupBy("account_id").agg((F.min("_quota") - F.min(F.col("_P") - F.col("_pos"))).alias("_R"))
    tail = tail.join(rest, "account_id")
    admitted = _late_admission(tail.filter((F.col("bytes") > 0) & (F.col("bytes") <= F.col("_R"))), n)
    tail = tail.join(admitted.withColumn("accepted", F.lit(True)), "id", "left").fillna(False, ["accepted"]) \
        .withColumn("_used", F.when(F.col("accepted"), F.col("bytes")).otherwise(F.lit(0)).cast("long"))
    tail = running_sum(tail.select("id", "account_id", "arrival", "accepted", "_used", "_R"), "account_id",
                       ["arrival", "id"], "_used", "_U", partitions=n)
    tail = tail.select("id", "account_id", "accepted", (F.col("_R") - F.col("_U")).alias("remaining"))
    return head.unionByName(tail).select(F.col("id").cast("int"), F.col("account_id").cast("int"), "accepted",
                                         F.col("remaining").cast("long"))


def page(df: DataFrame, order: list[Column], count: int | None, page_no: int | None,
         cap: int, default: int) -> DataFrame:
    """One page of an ordered result: count above the cap → cap, ≤ 0 →
    default; page below 0 → 0; offset = page × count.  Planned as a
    TakeOrdered of offset + count rows (each task keeps only that many), for
    the first pages; ``paging.build_page_index`` serves any page."""
    offset, size = page_bounds(count, page_no, cap, default)
    return df.orderBy(*order).offset(offset).limit(size)


def plan_renditions(df: DataFrame, name_col: str = "name", width_col: str = "width",
                    animated_col: str | None = None, password_col: str | None = None) -> DataFrame:
    """Which reduced copies an image upload gets and their names.

    Not animated and wider than 960 → a ``_medium`` copy; wider than 480 → a
    ``_thumb`` copy; a password-protected file exposes no rendition names.
    Also the base name (rendition suffixes removed) and the owner id taken
    from the numeric name prefix before the first '-' (0 when none).
    """
    name = F.col(name_col)
    width = F.coalesce(F.col(width_col), F.lit(0))
    animated = F.coalesce(F.col(animated_col), F.lit(False)) if animated_col else F.lit(False)
    locked = F.length(F.trim(F.coalesce(F.col(password_col).cast("string"), F.lit("")))) > 0 if password_col \
        else F.lit(False)
    if password_col and dict(df.dtypes).get(password_col) == "boolean":
        locked = F.coalesce(F.col(password_col), F.lit(False))
    ext = file_extension(name)
    medium = ~animated & (width > 960)
    thumb = ~animated & (width > 480)

    def renamed(suffix: str) -> Column:
        return F.when(ext != "", F.replace(name, F.concat(F.lit("."), ext), F.concat(F.lit(suffix + "."), ext)))

    base = name
    for s in ("_original", "_medium", "_small", "_thumb"):
        base = F.replace(base, F.lit(s), F.lit(""))
    token = F.regexp_replace(F.split_part(name, F.lit("-"), F.lit(1)), r"[^0-9.+\-]", "")
    owner = token.try_cast("double").try_cast("int")
    return (df.withColumn("make_medium", medium).withColumn("make_thumb", thumb)
              .withColumn("medium_name", F.when(medium & ~locked, renamed("_medium")))
              .withColumn("thumb_name", F.when(thumb & ~locked, renamed("_thumb")))
              .withColumn("base_name", base)
              .withColumn("owner_id", F.greatest(F.coalesce(owner, F.lit(0)), F.lit(0))))
