"""A messy property schedule that Spark SQL and DuckDB derive alike from the customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridmend.scratch import spread

#: Text for both engines; the table behind {source} has c_custkey.
SOV_SQL = """
SELECT CAST(c_custkey + 2 AS BIGINT) AS sheet_row,
 CASE WHEN c_custkey % 97 = 5 THEN NULL ELSE 'LOC-' || lpad(CAST(c_custkey % 1400 AS STRING), 5, '0') END AS reference,
 CAST(100 + c_custkey % 101 AS STRING) || ' ' || CASE c_custkey % 5 WHEN 0 THEN 'Main Street' WHEN 1 THEN 'Main St.' WHEN 2 THEN 'Oak Avenue' WHEN 3 THEN 'OAK AVE' ELSE 'Harbor Blvd' END AS address,
 CASE c_custkey % 7 WHEN 0 THEN 'Austin' WHEN 1 THEN ' Boston ' WHEN 2 THEN 'unknown' WHEN 3 THEN 'St. Paul' ELSE 'Albany' END AS city,
 CASE c_custkey % 12 WHEN 0 THEN 'TX' WHEN 1 THEN 'tx' WHEN 2 THEN 'Texas' WHEN 3 THEN 'MA' WHEN 4 THEN 'Massachusetts' WHEN 5 THEN 'V.I.' WHEN 6 THEN 'NY' WHEN 7 THEN 'N.Y.' WHEN 8 THEN 'Atlantis' WHEN 9 THEN 'CA' WHEN 10 THEN 'Calif.' ELSE NULL END AS state,
 CASE (c_custkey % 101) % 10 WHEN 0 THEN '78701' WHEN 1 THEN '02110' WHEN 2 THEN '2110' WHEN 3 THEN '02110-1234' WHEN 4 THEN '90210' WHEN 5 THEN '7520' WHEN 6 THEN 'see attached' WHEN 7 THEN '00802' WHEN 8 THEN 'ZIP 10001' ELSE NULL END AS zip,
 CASE c_custkey % 13 WHEN 0 THEN '$' || CAST(100000 + (c_custkey * 7919) % 5000000 AS STRING) || '.00' WHEN 1 THEN '(45,000)' WHEN 2 THEN 'N/A' WHEN 3 THEN '1' WHEN 4 THEN 'see schedule' WHEN 5 THEN '-5000' WHEN 6 THEN '$2,100,000.00' WHEN 7 THEN NULL ELSE CAST(100000 + (c_custkey * 7919) % 5000000 AS STRING) END AS building_value,
 CASE c_custkey % 9 WHEN 0 THEN 'TBD' WHEN 1 THEN '90000000' ELSE CAST(20000 + (c_custkey * 104729) % 900000 AS STRING) END AS contents,
 CASE c_custkey % 8 WHEN 0 THEN '-' WHEN 1 THEN '0' ELSE CAST(5000 + (c_custkey * 1299709) % 400000 AS STRING) END AS bi,
 CASE c_custkey % 4 WHEN 0 THEN 'Office' WHEN 1 THEN 'Warehouse' WHEN 2 THEN '' ELSE 'Retail' END AS occupancy,
 CASE c_custkey % 6 WHEN 0 THEN 'Wood Frame' WHEN 1 THEN 'Masonry Non-Combustible (ISO 4)' WHEN 2 THEN 'Steel Frame' WHEN 3 THEN 'Joisted Masonry' WHEN 4 THEN 'frame' ELSE 'Fire Resistive' END AS construction,
 CASE c_custkey % 11 WHEN 0 THEN '0' WHEN 1 THEN '1.5' WHEN 2 THEN 'two' WHEN 3 THEN '14' ELSE CAST(1 + c_custkey % 9 AS STRING) END AS storeys,
 CASE c_custkey % 10 WHEN 0 THEN '0' WHEN 1 THEN '2.0' ELSE '1' END AS number_of_buildings,
 CASE c_custkey % 14 WHEN 0 THEN '0' WHEN 1 THEN '1900' WHEN 2 THEN '3015' WHEN 3 THEN '1920''s' WHEN 4 THEN '01/01/1990' ELSE CAST(1950 + c_custkey % 70 AS STRING) END AS year_built,
 CASE c_custkey % 10 WHEN 0 THEN 'Yes' WHEN 1 THEN 'N' WHEN 2 THEN 'Partial' WHEN 3 THEN '0.5' WHEN 4 THEN '50%' WHEN 5 THEN 'NFPA 13R' WHEN 6 THEN 'halon' WHEN 7 THEN 'None' WHEN 8 THEN 'Y13' ELSE '1' END AS sprinklers
FROM {source}
"""


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of a folder: one row per customer."""
    return spark.sql(SOV_SQL.replace("{source}", "{customer}"), customer=spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")))
