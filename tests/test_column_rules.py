"""Hand cases for column rules."""

from pyspark.sql import functions as F

from tessera.operators import content as C
from tessera.operators import dates as D
from tessera.operators import files as FL
from tessera.operators import images as I
from tessera.operators import text as T


def _one(spark, value, ddl="x string"):
    return spark.createDataFrame([(value,)], ddl)


def test_exif_rules(spark):
    rows = [(["35/1", "30/1", "0/1"], "N", ["139/1", "45/1", "3600/100"], "E", "90/1"),
            (["35/1", "30/1", "0/1"], "S", ["139/1", "45/1", "0/1"], "W", "5/0"),
            (["35/1", "30/1", "0/1"], None, ["139/1", "45/1", "0/1"], "E", None),
            (["35/1", "30/1", "7/0"], "N", ["139/1", "45/1", "0/1"], "E", None)]
    df = spark.createDataFrame(rows, "GPSLatitude array<string>, GPSLatitudeRef string, GPSLongitude array<string>, "
                                     "GPSLongitudeRef string, GPSImgDirection string")
    out = [(r.latitude, r.longitude, r.direction) for r in I.exif_to_decimal(df).collect()]
    assert out[0] == (35.5, 139.76, 90.0)
    assert out[1] == (-35.5, -139.75, None)        # S/W negate; zero denominator → no direction
    assert out[2] == (None, None, None)            # missing reference
    assert out[3][0] is None and out[3][1] == 139.75  # zero denominator in a part


def test_slug_url_and_identity(spark):
    df = _one(spark, " Crème Brûlée & Straße's Café ")
    assert T.slugify(df, "x").first().slug == "creme-brulee-and-strasses-cafe"
    u = _one(spark, "https://www.Twitter.com/Some%20User/index.html?x=1")
    assert T.clean_urls(u, "x").first().clean_url == "x.com/some user"
    ok = _one(spark, "https://example.com/a/b/").select(T.url_guid_expr(F.col("x")).alias("g")).first().g
    same = _one(spark, "http://example.com//a/b").select(T.url_guid_expr(F.col("x")).alias("g")).first().g
    # '//' → '/' runs first, so 20 trailing slashes count as 10 (invalid)
    bad = _one(spark, "https://example.com/a" + "/" * 20).select(T.url_guid_expr(F.col("x")).alias("g")).first().g
    assert ok == same and len(ok) == 36 and bad is None


def test_plain_text_and_names(spark):
    df = _one(spark, "a<BR>b</p>\r\n\r\n\r\nc")
    assert T.plain_text(df, "x").first().plain_text == "a\n\nb\n\nc"
    n = _one(spark, "Ｓｈｏｐ＿Ｎａｍｅ [branch] (old) #1")
    assert T.clean_names(n, "x").first().clean_name == "Shop Name 1"


def test_negotiate_locale(spark):
    rows = [(None, "/ja-jp/x", "de"), ("fr-FR", "/", ""), (None, "/", "es-MX,es;q=0.9"), (None, "/", "zz"),
            ("toolongvalue", "/", "de-DE")]
    df = spark.createDataFrame(rows, "cookie_lang string, request_uri string, accept_language string")
    got = [r.display_lang for r in C.negotiate_locale(df, ["en-us", "ja-jp", "fr-fr", "de-de", "es-es"], "en-us").collect()]
    assert got == ["ja-jp", "fr-fr", "es-es", "en-us", "de-de"]


def test_acl_and_sizes(spark):
    df = spark.createDataFrame([("PUBLIC-READ", ""), ("public-read-write", "secret"), ("odd", None)],
                               "acl string, password string")
    got = [(r.access, r.is_public, r.is_readonly) for r in FL.acl_flags(df, "acl", "password").collect()]
    assert got == [("public-read", True, True), ("private", False, True), ("private", False, True)]
    s = spark.createDataFrame([(0,), (1023,), (1536,), (5 * 1024 ** 4 * 1024,)], "b long")
    assert [r.t for r in s.select(D.format_bytes(F.col("b")).alias("t")).collect()] == \
        ["0 B", "1023 B", "1.5 KB", "5120 TB"]
    p = spark.createDataFrame([(42,), (0,), (123456789,)], "n long")
    assert [r.t for r in p.select(D.pad_number(F.col("n"), 8).alias("t")).collect()] == ["00000042", "", "23456789"]


def test_hms_and_age(spark):
    df = spark.createDataFrame([(59,), (3600,), (3725,)], "s long")
    assert [r.t for r in df.select(D.seconds_to_hms(F.col("s")).alias("t")).collect()] == ["00:59", "00:00", "01:02:05"]  # hours shown only above 3600 s
    back = spark.createDataFrame([("01:02:05",), ("12:34",), ("x",)], "t string")
    assert [r.s for r in back.select(D.hms_to_seconds(F.col("t")).alias("s")).collect()] == [3725, 34 * 60 + 12 * 3600, 0]
    ages = spark.createDataFrame([(59,), (61,), (7200,), (86400 * 9,)], "a long")
    assert [r.t for r in ages.select(D.age_text(F.col("a")).alias("t")).collect()] == \
        ["59 seconds", "1 minute", "2 hours", "1 week"]
