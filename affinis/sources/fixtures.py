"""Business records derived from customers and parts: the same SQL runs in Spark and DuckDB.

S1-k matches S2-k where k mod 5 is 0, 1 or 2, and S3-k where k mod 4 is 0 or 1. S2-D rows match
nothing. EXTRA adds hand-written records for what the derived ones lack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RECORDS_SQL = """
  SELECT entity_id, business_name, business_address, country FROM (
    WITH base AS (
      SELECT CAST(c.c_custkey AS BIGINT) AS k, p.p_name AS pname, p.p_type AS ptype, c.c_mktsegment AS seg
      FROM customer c JOIN part p ON p.p_partkey = c.c_custkey % 200
    ), biz AS (
      SELECT k, lower(pname) || ' ' || lower(ptype) AS core,
        CASE k % 4 WHEN 0 THEN ' Private Limited' WHEN 1 THEN ' LLC' WHEN 2 THEN ' Inc' ELSE '' END AS suf_long,
        CASE k % 4 WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN ', L.L.C' WHEN 2 THEN ' Incorporated' ELSE ' Co' END AS suf_short,
        CAST((k * 37) % 8999 + 100 AS STRING) AS house, lower(seg) AS street, CAST((k * 7919) % 90000 + 10000 AS STRING) AS postal,
        CASE k % 8 WHEN 0 THEN 'Boston' WHEN 1 THEN 'Austin' WHEN 2 THEN 'Pune' WHEN 3 THEN 'Jaipur' WHEN 4 THEN 'Paris' WHEN 5 THEN 'Lyon' WHEN 6 THEN 'New Delhi' ELSE 'Seattle' END AS city,
        CASE k % 8 WHEN 0 THEN 'MA' WHEN 1 THEN 'TX' WHEN 2 THEN 'Maharashtra' WHEN 3 THEN 'Rajasthan' WHEN 6 THEN 'Delhi' WHEN 7 THEN 'WA' ELSE '' END AS state,
        CASE k % 8 WHEN 2 THEN 'India' WHEN 3 THEN 'India' WHEN 6 THEN 'India' WHEN 4 THEN 'France' WHEN 5 THEN 'France' ELSE 'US' END AS country
      FROM base
    )
    SELECT 'S1-' || CAST(k AS STRING) AS entity_id, core || suf_long AS business_name,
      CASE WHEN state = '' THEN house || ' Rue ' || street || ', ' || postal || ' ' || city ELSE house || ' ' || street || ' Street, ' || city || ', ' || state || ' ' || postal END AS business_address, country FROM biz
    UNION ALL
    SELECT 'S2-' || CAST(k AS STRING), core || suf_short,
      CASE WHEN state = '' THEN house || ' r ' || street || ', ' || postal || ' ' || city ELSE house || ' ' || street || ' St, ' || city || ', ' || state || ' ' || postal END,
      CASE WHEN country = 'US' THEN 'USA' ELSE country END FROM biz WHERE k % 5 IN (0, 1, 2)
    UNION ALL
    SELECT 'S3-' || CAST(k AS STRING), substr(core, 1, 3) || substr(core, 5) || suf_long,
      CASE WHEN state = '' THEN house || ' Rue ' || street || ', ' || city ELSE house || ' ' || street || ' Street, ' || city || ', ' || state END, country FROM biz WHERE k % 4 IN (0, 1)
    UNION ALL
    SELECT 'S2-D' || CAST(k AS STRING), core || suf_long, CAST((k * 53) % 8999 + 100 AS STRING) || 'B ' || street || ' Road, ' || city || ', ' || postal, country FROM biz WHERE k % 7 = 3
  ) derived
"""

#: Records for aliases, accents, landmarks, units, phones, blanks, ordinals and other states.
EXTRA = [
    ("X-01", "Café Zürich GmbH dba Blue Bottle Inc", "Unit No 12B, Near City Mall Gate 4, MG Road, Pune, Maharashtra 411001, India", "IN"),
    ("X-02", "Łódź & Søn A/S", "", ""),
    ("X-03", "Acme Intl Trading As Zenith Mfg Pvt Ltd", "348th St 21st Ave, Miami, FL 33101", "USA"),
    ("X-04", "Widgets, L.L.C", "11169 Clear Lake Drive, St Louis, MO 63101", "United States of America"),
    ("X-05", "Straße Öl Co", "12 bis Rue de la Paix, 75001 Paris, France", "FR"),
    ("X-06", "d b a", "Opp. Old Fort 5 Gate, Sector 9, Chandigarh 160009", "India"),
    ("X-07", "", "Flat 4, Floor 2, +33 (0)1 42 68 53 00, Lyon 69001", "France"),
    ("X-08", "Northwind Private Limited Company", "Plot 9; Near Lake View\nBoston, Massachusetts", "us"),
    ("X-09", "Café Zürich GmbH", "Suite number 7, 1 N Main St, New York, New York 10001", "US"),
    ("X-10", "T A Robert Store", "behind 7 the Station, Kolkata, West Bengal", "Republic of India"),
    ("X-11", "Rupert Store AKA Bob", "Beside Temple Road, Leh, Jammu and Kashmir 194101", "India"),
    ("X-12", "Tymczak Ashcraft", "Seattle", "Germany"),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def extra_sql() -> str:
    rows = ", ".join("(" + ", ".join(_quoted(x) for x in row) + ")" for row in EXTRA)
    return f"SELECT entity_id, business_name, business_address, country FROM (VALUES {rows}) AS extra(entity_id, business_name, business_address, country)"


TRUTH_SQL = """
  SELECT 'S1-' || CAST(k AS STRING) AS entity_id, 'S2-' || CAST(k AS STRING) AS candidate_id FROM (SELECT CAST(c.c_custkey AS BIGINT) AS k FROM customer c JOIN part p ON p.p_partkey = c.c_custkey % 200) b WHERE k % 5 IN (0, 1, 2)
  UNION ALL
  SELECT 'S1-' || CAST(k AS STRING), 'S3-' || CAST(k AS STRING) FROM (SELECT CAST(c.c_custkey AS BIGINT) AS k FROM customer c JOIN part p ON p.p_partkey = c.c_custkey % 200) b WHERE k % 4 IN (0, 1)
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def _sql(spark: SparkSession, text: str) -> DataFrame:
    """Spark reads escapes in literals, DuckDB doesn't: a line end is written as it is."""
    return spark.sql(text)


def records(spark: SparkSession, sf_dir: str, extra: bool = False) -> DataFrame:
    tables(spark, sf_dir, "customer", "part")
    found = _sql(spark, RECORDS_SQL)
    if extra:
        found = found.unionByName(spark.createDataFrame(EXTRA, "entity_id string, business_name string, business_address string, country string"))
    return found


def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries (S1) and targets (S2 and S3)."""
    return found.filter("entity_id like 'S1-%'"), found.filter("entity_id like 'S2-%' or entity_id like 'S3-%'")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "customer", "part")
    return _sql(spark, TRUTH_SQL)
