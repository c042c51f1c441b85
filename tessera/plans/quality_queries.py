"""Data-quality queries over the stand-in and driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.fixtures import DRIVER_TABLES, fixture, table, with_fixtures
from tessera.operators import quality as Q
from tessera.plans.registry import register


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda n: fixture(spark, sf_dir, n)
    loc = f("location").withColumn("name", F.concat(F.col("name"), F.lit("")))
    parts = [
        Q.check_rules(f("usage_raw"), "usage", "id", Q.usage_rules()),
        Q.check_rules(f("account"), "account", "id", Q.account_rules()),
        Q.check_rules(f("note"), "note", "id", Q.note_rules()),
        Q.check_rules(f("file_stamp").join(f("file_req").select("id", "bytes"), "id"), "file", "id", Q.file_rules()),
        Q.check_rules(loc, "location", "id", Q.location_rules()),
        Q.check_rules(f("country"), "country", "code", Q.country_rules()),
    ]
    return reduce(DataFrame.unionByName, parts)


_Q1 = with_fixtures("usage_raw", "account", "note", "file_stamp", "file_req", "location", "country") + """
, v AS (
  SELECT 'usage' AS table_name, CAST(id AS VARCHAR) AS row_key, unnest(list_filter([
           CASE WHEN NOT coalesce(http_code BETWEEN 100 AND 599, true) THEN 'http_code_range' END,
           CASE WHEN NOT coalesce(seconds >= 0, true) THEN 'seconds_non_negative' END,
           CASE WHEN NOT coalesce(sqlops >= 0, true) THEN 'sqlops_non_negative' END,
           CASE WHEN request_uri IS NULL THEN 'request_uri_not_null' END,
           CASE WHEN NOT coalesce(length(request_type) <= 8, true) THEN 'request_type_len_8' END,
           CASE WHEN NOT coalesce(length(request_uri) <= 512, true) THEN 'request_uri_len_512' END,
           CASE WHEN NOT coalesce(length(referrer) <= 1024, true) THEN 'referrer_len_1024' END,
           CASE WHEN NOT coalesce(length(locale_code) <= 6, true) THEN 'locale_code_len_6' END,
           CASE WHEN NOT coalesce(length(from_ip) <= 64, true) THEN 'from_ip_len_64' END,
           CASE WHEN NOT coalesce(length(agent) <= 2048, true) THEN 'agent_len_2048' END], lambda x: x IS NOT NULL)) AS rule
    FROM usage_raw
  UNION ALL
  SELECT 'account', CAST(id AS VARCHAR), unnest(list_filter([
           CASE WHEN NOT coalesce(email LIKE '%@%.%', true) THEN 'email_pattern' END,
           CASE WHEN login IS NULL THEN 'login_not_null' END,
           CASE WHEN NOT coalesce(length(display_name) <= 80, true) THEN 'display_name_len_80' END,
           CASE WHEN NOT coalesce(length(email) <= 160, true) THEN 'email_len_160' END], lambda x: x IS NOT NULL))
    FROM account
  UNION ALL
  SELECT 'note', CAST(id AS VARCHAR), unnest(list_filter([
           CASE WHEN NOT coalesce(type LIKE 'note.%', true) THEN 'type_prefix' END,
           CASE WHEN content IS NULL THEN 'content_not_null' END], lambda x: x IS NOT NULL))
    FROM note
  UNION ALL
  SELECT 'file', CAST(s.id AS VARCHAR), unnest(list_filter([
           CASE WHEN NOT coalesce(r.bytes > 0, true) THEN 'bytes_positive' END,
           CASE WHEN NOT coalesce(s.until_at > s.start_at, true) THEN 'until_after_start' END], lambda x: x IS NOT NULL))
    FROM file_stamp s JOIN file_req r ON r.id = s.id
  UNION ALL
  SELECT 'location', CAST(id AS VARCHAR), unnest(list_filter([
           CASE WHEN NOT coalesce(longitude BETWEEN -180 AND 180, true) THEN 'longitude_range' END,
           CASE WHEN NOT coalesce(latitude BETWEEN -90 AND 90, true) THEN 'latitude_range' END,
           CASE WHEN NOT coalesce(length(name) <= 256, true) THEN 'name_len_256' END], lambda x: x IS NOT NULL))
    FROM location
  UNION ALL
  SELECT 'country', code, unnest(list_filter([
           CASE WHEN NOT coalesce(sort_order BETWEEN 0 AND 999, true) THEN 'sort_order_range' END], lambda x: x IS NOT NULL))
    FROM country)
"""


@register("q1_check_rules", oracle=_Q1 + "SELECT table_name, row_key, rule FROM v")
def q1_check_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: every CHECK / NOT NULL / length violation in usage, accounts, notes, files, locations, countries."""
    return _violations(spark, sf_dir)


@register("q1_rule_counts", oracle=_Q1 + "SELECT table_name, rule, count(*) AS violations FROM v GROUP BY table_name, rule")
def q1_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: violation counts per table and rule."""
    return Q.rule_counts(_violations(spark, sf_dir))


# The 27 declared foreign keys: (child, row key, [(column, parent)]).
_FKS = [
    ("country_region", "id", [("country_code", "country")]),
    ("state", "id", [("country_code", "country"), ("region_id", "country_region")]),
    ("locale", "code", [("language_code", "language")]),
    ("site", "id", [("locale_code", "locale")]),
    ("site_url", "id", [("site_id", "site")]),
    ("site_meta", "key", [("site_id", "site")]),
    ("account", "id", [("locale_code", "locale")]),
    ("account_meta", "key", [("account_id", "account")]),
    ("tokens", "id", [("account_id", "account")]),
    ("note", "id", [("updated_by", "account")]),
    ("note_meta", "key", [("note_id", "note")]),
    ("note_history", "id", [("note_id", "note"), ("updated_by", "account")]),
    ("file", "id", [("account_id", "account")]),
    ("file_meta", "key", [("file_id", "file")]),
    ("file_url", "id", [("file_id", "file"), ("account_id", "account"), ("token_id", "tokens")]),
    ("usage_raw", "id", [("site_id", "site"), ("token_id", "tokens")]),
    ("contact_meta", "key", [("contact_id", "contact")]),
    ("location", "id", [("country_code", "country"), ("state_id", "state"), ("created_by", "account")]),
    ("location_key", "id", [("updated_by", "account")]),
    ("location_meta", "key", [("location_id", "location")]),
]
_PARENT_KEYS = {"country": "code", "locale": "code", "language": "code"}
_PARENTS = sorted({p for _, _, keys in _FKS for _, p in keys})


@register("q2_orphans", oracle=with_fixtures(*sorted({ch for ch, _, _ in _FKS} | set(_PARENTS))) + "\n UNION ALL\n".join(
    f"SELECT '{ch}.{fk}' AS fk_name, CAST(c.{k} AS VARCHAR) AS row_key, CAST(c.{fk} AS VARCHAR) AS fk_value FROM {ch} c "
    f"WHERE c.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} p WHERE p.{_PARENT_KEYS.get(p, 'id')} = c.{fk})"
    for ch, k, keys in _FKS for fk, p in keys))
def q2_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: rows whose foreign key names no parent row, for all 27 declared keys."""
    f = lambda n: fixture(spark, sf_dir, n)
    return Q.orphans_of_all([(f(ch), k, [(f"{ch}.{fk}", fk, p) for fk, p in keys]) for ch, k, keys in _FKS],
                            {p: (f(p), _PARENT_KEYS.get(p, "id")) for p in _PARENTS})


# Unique columns (the nine declared ones) and primary keys that several columns make up.
_DUPS = [("account", [["login"], ["email"], ["guid"]]), ("site", [["guid"]]), ("note_key", [["guid"]]), ("file", [["guid"]]),
         ("file_url", [["guid"]]), ("contact", [["guid"]]), ("location_key", [["guid"]]), ("account_meta", [["account_id", "key"]]),
         ("site_url", [["url"]]), ("location_meta", [["location_id", "key"]]), ("note_history", [["id"]])]


@register("q3_duplicates", oracle=with_fixtures(*[t for t, _ in _DUPS]) + "\n UNION ALL\n".join(
    f"SELECT '{t}.{'+'.join(cols)}' AS check_name, concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}) AS key_value, "
    f"count(*) AS n FROM {t} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)} "
    f"GROUP BY {', '.join(cols)} HAVING count(*) > 1"
    for t, keys in _DUPS for cols in keys))
def q3_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: duplicate values of the unique columns and of primary keys."""
    f = lambda n: fixture(spark, sf_dir, n)
    return Q.duplicates_of_all([(f(t), [(f"{t}.{'+'.join(cols)}", cols) for cols in keys]) for t, keys in _DUPS])


# Declared column catalogue of the driver tables: FIXTURES §2 for the
# application stand-in sources, the TPC-H specification for lineitem.
EXPECTED_COLUMNS = [
    ("events", "event_id", "BIGINT"), ("events", "ts", "TIMESTAMP"), ("events", "user_id", "BIGINT"),
    ("events", "event_type", "VARCHAR"), ("events", "value", "DOUBLE"), ("events", "props", "VARCHAR"),
    ("customer", "c_custkey", "BIGINT"), ("customer", "c_name", "VARCHAR"), ("customer", "c_nationkey", "INTEGER"),
    ("customer", "c_acctbal", "DOUBLE"), ("customer", "c_mktsegment", "VARCHAR"),
    ("supplier", "s_suppkey", "BIGINT"), ("supplier", "s_name", "VARCHAR"), ("supplier", "s_nationkey", "INTEGER"),
    ("supplier", "s_acctbal", "DOUBLE"),
    ("orders", "o_orderkey", "BIGINT"), ("orders", "o_custkey", "BIGINT"), ("orders", "o_orderstatus", "VARCHAR"),
    ("orders", "o_totalprice", "DOUBLE"), ("orders", "o_orderdate", "TIMESTAMP"), ("orders", "o_orderpriority", "VARCHAR"),
    ("part", "p_partkey", "BIGINT"), ("part", "p_name", "VARCHAR"), ("part", "p_brand", "VARCHAR"),
    ("part", "p_type", "VARCHAR"), ("part", "p_size", "INTEGER"), ("part", "p_retailprice", "DOUBLE"),
    ("nation", "n_nationkey", "INTEGER"), ("nation", "n_name", "VARCHAR"), ("nation", "n_regionkey", "INTEGER"),
    ("region", "r_regionkey", "INTEGER"), ("region", "r_name", "VARCHAR"),
    ("documents", "doc_id", "BIGINT"), ("documents", "text", "VARCHAR"), ("documents", "lang", "VARCHAR"),
    ("documents", "source", "VARCHAR"), ("documents", "n_chars", "BIGINT"),
    ("conversations", "conv_id", "BIGINT"), ("conversations", "turn", "BIGINT"), ("conversations", "role", "VARCHAR"),
    ("conversations", "text", "VARCHAR"),
    ("pages", "page_id", "BIGINT"), ("pages", "url", "VARCHAR"), ("pages", "html", "VARCHAR"),
    ("lineitem", "l_orderkey", "BIGINT"), ("lineitem", "l_partkey", "BIGINT"), ("lineitem", "l_suppkey", "BIGINT"),
    ("lineitem", "l_linenumber", "INTEGER"), ("lineitem", "l_quantity", "DECIMAL(15,2)"),
    ("lineitem", "l_extendedprice", "DECIMAL(15,2)"), ("lineitem", "l_discount", "DECIMAL(15,2)"),
    ("lineitem", "l_tax", "DECIMAL(15,2)"), ("lineitem", "l_returnflag", "VARCHAR"),
    ("lineitem", "l_linestatus", "VARCHAR"), ("lineitem", "l_shipdate", "DATE"), ("lineitem", "l_commitdate", "DATE"),
    ("lineitem", "l_receiptdate", "DATE"),
]
_CHECKED_TABLES = sorted({t for t, _, _ in EXPECTED_COLUMNS})


def _canon_sql(x: str) -> str:
    t = f"lower(trim({x}))"
    return (f"CASE WHEN {t} IN ('bigint', 'long', 'int8') THEN 'BIGINT' WHEN {t} IN ('int', 'integer', 'int4') THEN 'INTEGER' "
            f"WHEN {t} IN ('smallint', 'short', 'int2') THEN 'SMALLINT' WHEN {t} IN ('string', 'varchar', 'text') THEN 'VARCHAR' "
            f"WHEN {t} IN ('double', 'float8') THEN 'DOUBLE' WHEN {t} IN ('float', 'real', 'float4') THEN 'FLOAT' "
            f"WHEN {t} IN ('boolean', 'bool') THEN 'BOOLEAN' WHEN {t} IN ('timestamp', 'timestamp_ntz') THEN 'TIMESTAMP' "
            f"WHEN {t} = 'date' THEN 'DATE' WHEN starts_with({t}, 'decimal') THEN upper(replace({t}, ' ', '')) "
            f"ELSE upper({t}) END")


_Q4 = ("WITH expected AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}', '{ty}', 'YES')" for t, c, ty in EXPECTED_COLUMNS)
       + ") v(table_name, column_name, column_type, is_nullable)),\n"
       + "actual AS (SELECT table_name, column_name, data_type AS column_type, is_nullable FROM information_schema.columns "
       + "WHERE table_name IN (" + ", ".join(f"'{t}'" for t in _CHECKED_TABLES) + ")),\n"
       + f"""j AS (SELECT e.*, a.column_type AS a_type, a.is_nullable AS a_null, a.column_name IS NOT NULL AS found
        FROM expected e LEFT JOIN actual a ON a.table_name = e.table_name AND a.column_name = e.column_name)
SELECT table_name, column_name, 'not found' AS issue FROM j WHERE NOT found
UNION ALL SELECT table_name, column_name, 'column_type does not match' FROM j
 WHERE found AND {_canon_sql('column_type')} IS DISTINCT FROM {_canon_sql('a_type')}
UNION ALL SELECT table_name, column_name, 'is_nullable does not match' FROM j
 WHERE found AND is_nullable IS DISTINCT FROM a_null
""")


@register("q4_schema_drift", oracle=_Q4)
def q4_schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: declared column catalogue vs the schemas of the given tables."""
    actual = Q.table_catalogue(spark, {t: table(spark, sf_dir, t) for t in _CHECKED_TABLES if t in DRIVER_TABLES})
    expected = spark.createDataFrame([(t, c, ty, "YES") for t, c, ty in EXPECTED_COLUMNS],
                                     "table_name string, column_name string, column_type string, is_nullable string")
    return Q.schema_drift(expected, actual)
