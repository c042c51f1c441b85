"""Data-quality jobs: CHECK rules, orphan keys, duplicate keys, schema drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def check_rules(df: DataFrame, table: str, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """Q1: one row per (row, failed rule) in a single pass.

    A rule holds when its condition is true *or NULL* (SQL CHECK
    semantics); NOT NULL rules are written as ``isNotNull``.  All rules are
    evaluated in one projection into an array of failed names, which is
    exploded — no per-rule scan, no shuffle.
    """
    failed = F.array(*[F.when(~F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in rules])
    return (df.select(F.lit(table).alias("table_name"), F.col(key).cast("string").alias("row_key"),
                      F.array_compact(failed).alias("_f"))
              .select("table_name", "row_key", F.explode("_f").alias("rule")))


def rule_counts(violations: DataFrame) -> DataFrame:
    """Q1 summary: violations per (table, rule)."""
    return violations.groupBy("table_name", "rule").agg(F.count("*").alias("violations"))


# The declared constraints, as column predicates.
def usage_rules() -> list[tuple[str, Column]]:
    return [
        ("http_code_range", F.col("http_code").between(100, 599)),
        ("seconds_non_negative", F.col("seconds") >= 0),
        ("sqlops_non_negative", F.col("sqlops") >= 0),
        ("request_uri_not_null", F.col("request_uri").isNotNull()),
        ("request_type_len_8", F.length("request_type") <= 8),
        ("request_uri_len_512", F.length("request_uri") <= 512),
        ("referrer_len_1024", F.length("referrer") <= 1024),
        ("locale_code_len_6", F.length("locale_code") <= 6),
        ("from_ip_len_64", F.length("from_ip") <= 64),
        ("agent_len_2048", F.length("agent") <= 2048),
    ]


def account_rules() -> list[tuple[str, Column]]:
    return [
        ("email_pattern", F.col("email").like("%@%.%")),
        ("login_not_null", F.col("login").isNotNull()),
        ("display_name_len_80", F.length("display_name") <= 80),
        ("email_len_160", F.length("email") <= 160),
    ]


def note_rules() -> list[tuple[str, Column]]:
    return [("type_prefix", F.col("type").like("note.%")), ("content_not_null", F.col("content").isNotNull())]


def file_rules() -> list[tuple[str, Column]]:
    return [("bytes_positive", F.col("bytes") > 0), ("until_after_start", F.col("until_at") > F.col("start_at"))]


def location_rules() -> list[tuple[str, Column]]:
    return [("longitude_range", F.col("longitude").between(-180, 180)),
            ("latitude_range", F.col("latitude").between(-90, 90)),
            ("name_len_256", F.length("name") <= 256)]


def country_rules() -> list[tuple[str, Column]]:
    return [("sort_order_range", F.col("sort_order").between(0, 999))]


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id", name: str | None = None,
            child_key: str = "id") -> DataFrame:
    """Q2: child rows whose non-NULL foreign key has no parent row
    (anti join on the key; NULL keys pass, as in SQL)."""
    p = parent.select(F.col(pk).alias("_pk")).distinct()
    c = child.filter(F.col(fk).isNotNull())
    bad = c.join(p, F.col(fk) == F.col("_pk"), "left_anti")
    return bad.select(F.lit(name or fk).alias("fk_name"), F.col(child_key).cast("string").alias("row_key"),
                      F.col(fk).cast("string").alias("fk_value"))


def orphans_of_all(children: list[tuple[DataFrame, str, list[tuple[str, str, str]]]], parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Q2 for many keys at once: ``children`` lists (rows, row key, keys), each
    key as (name, column, parent), and ``parents`` names (rows, key column).

    A child table is scanned once for all of its keys: each row gives its (key
    name, parent, value), of which only the different (parent, value) pairs are
    shuffled, together with the parents' keys (partial aggregation; a value that
    most rows hold is one pair a task), and one aggregate finds the pairs that
    no parent row has.  A second scan gives the rows that hold one; Spark
    broadcasts the pairs while they are few.  NULL keys pass.

    Semi and anti joins are avoided on purpose: Spark pushes them below the
    union, with a copy of the other side's whole plan for every table."""
    def refs(df: DataFrame, row_key: str, keys: list[tuple[str, str, str]]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(n).alias("fk_name"), F.lit(p).alias("parent"), F.col(c).cast("string").alias("value")) for n, c, p in keys])
        return df.select(F.col(row_key).cast("string").alias("row_key"), F.explode(each).alias("k")) \
            .select("k.fk_name", "row_key", "k.parent", "k.value").filter(F.col("value").isNotNull())

    def all_refs() -> DataFrame:
        return reduce(DataFrame.unionByName, [refs(*child) for child in children])

    own = [df.select(F.lit(n).alias("parent"), F.col(pk).cast("string").alias("value"), F.lit(1).alias("known")) for n, (df, pk) in parents.items()]
    pairs = reduce(DataFrame.unionByName, own, all_refs().select("parent", "value", F.lit(0).alias("known")))
    missing = pairs.groupBy("parent", "value").agg(F.max("known").alias("known")).filter("known = 0").select("parent", "value")
    found = all_refs().join(missing, ["parent", "value"])
    return found.select("fk_name", "row_key", F.col("value").alias("fk_value"))


def duplicates_of_all(tables: list[tuple[DataFrame, list[tuple[str, list[str]]]]]) -> DataFrame:
    """Q3 for many keys at once: ``tables`` lists (rows, keys), each key as
    (name, columns).  One scan a table and one aggregate for all keys, counted
    map-side first.  A key with a NULL column is left out."""
    def keyed(df: DataFrame, keys: list[tuple[str, list[str]]]) -> DataFrame:
        # a NULL in any column makes the text of the key NULL
        text = lambda cols: F.concat(*[x for c in cols for x in (F.lit("|"), F.col(c).cast("string"))][1:])
        each = F.array(*[F.struct(F.lit(n).alias("check_name"), text(cols).alias("key_value")) for n, cols in keys])
        return df.select(F.explode(each).alias("k")).select("k.check_name", "k.key_value").filter(F.col("key_value").isNotNull())

    rows = reduce(DataFrame.unionByName, [keyed(*t) for t in tables])
    return rows.groupBy("check_name", "key_value").agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def duplicates(df: DataFrame, cols: list[str], name: str | None = None) -> DataFrame:
    """Q3: key values that occur more than once (NULL keys excluded, as a
    UNIQUE index allows them).  Partial counts are combined map-side."""
    keyed = df.filter(F.greatest(*[F.col(c).isNull() for c in cols]) == F.lit(False)) if len(cols) > 1 \
        else df.filter(F.col(cols[0]).isNotNull())
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    return (keyed.groupBy(key.alias("key_value")).agg(F.count("*").alias("n"))
                 .filter(F.col("n") > 1)
                 .select(F.lit(name or "+".join(cols)).alias("check_name"), "key_value", "n"))


# Canonical type names used to compare catalogues from different engines.
def canonical_type(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return (F.when(t.isin("bigint", "long", "int8"), "BIGINT")
            .when(t.isin("int", "integer", "int4"), "INTEGER")
            .when(t.isin("smallint", "short", "int2"), "SMALLINT")
            .when(t.isin("string", "varchar", "text"), "VARCHAR")
            .when(t.isin("double", "float8"), "DOUBLE")
            .when(t.isin("float", "real", "float4"), "FLOAT")
            .when(t.isin("boolean", "bool"), "BOOLEAN")
            .when(t.isin("timestamp", "timestamp_ntz"), "TIMESTAMP")
            .when(t == "date", "DATE")
            .when(t.startswith("decimal"), F.upper(F.regexp_replace(t, " ", "")))
            .otherwise(F.upper(t)))


def table_catalogue(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Column catalogue (table_name, column_name, column_type, is_nullable)
    read from the schemas of the given DataFrames (metadata only)."""
    rows = [(name, f.name, f.dataType.simpleString(), "YES" if f.nullable else "NO")
            for name, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, column_type string, is_nullable string")


def schema_drift(expected: DataFrame, actual: DataFrame, key: tuple[str, ...] = ("table_name", "column_name"),
                 attrs: tuple[str, ...] = ("column_type", "is_nullable")) -> DataFrame:
    """Q4: compare an expected column catalogue with the actual one.

    For every expected column: 'not found' when it is missing, else one
    issue per attribute that differs (types compared by canonical name).
    Returns (table_name, column_name, issue).
    """
    e = expected.select(*key, *[F.col(a).alias(f"e_{a}") for a in attrs])
    a = actual.select(*key, *[F.col(x).alias(f"a_{x}") for x in attrs]).withColumn("_found", F.lit(True))
    j = e.join(a, list(key), "left")
    issues = [F.when(F.col("_found").isNull(), F.lit("not found"))]
    for x in attrs:
        ev, av = F.col(f"e_{x}"), F.col(f"a_{x}")
        if x == "column_type":
            ev, av = canonical_type(ev), canonical_type(av)
        issues.append(F.when(F.col("_found") & ~ev.eqNullSafe(av), F.lit(f"{x} does not match")))
    return (j.select(*key, F.explode(F.array_compact(F.array(*issues))).alias("issue")))


