"""Fixture views over the driver's read-only Parquet tables.

The reference's own inputs (a listings CSV, live requests, a database of
saved predictions) are not available, so each input of the application is
derived from the TPC-H-like tables by plain SQL that runs unchanged on Spark
and DuckDB. These views only give rows in the schema each job expects; the
jobs do not rely on how the rows were made.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from dealerlens.session import keep_compiled

BASE_TABLES = ("lineitem", "events", "orders", "part", "customer")

LISTINGS_SQL = """
SELECT
  concat(CAST(b.l_orderkey AS STRING), '-', CAST(b.l_partkey AS STRING), '-',
         CAST(b.l_suppkey AS STRING), '-', CAST(b.l_linenumber AS STRING)) AS listing_id,
  CASE WHEN i % 97 = 0 THEN NULL WHEN i % 89 = 0 THEN 'call'
       ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) END AS price,
  CASE WHEN i % 101 = 0 THEN NULL WHEN i % 83 = 0 THEN 'n/a'
       ELSE CAST(1996 + i % 30 AS STRING) END AS year,
  v.manufacturer, v.model,
  CASE i % 8 WHEN 0 THEN 'new' WHEN 1 THEN 'Like New' WHEN 2 THEN 'excellent' WHEN 3 THEN ' good '
             WHEN 4 THEN 'fair' WHEN 5 THEN 'salvage' WHEN 6 THEN 'mystery' END AS condition,
  CASE i % 10 WHEN 0 THEN '3 cylinders' WHEN 1 THEN '4 cylinders' WHEN 2 THEN '5 cylinders'
              WHEN 3 THEN '6 cylinders' WHEN 4 THEN '8 cylinders' WHEN 5 THEN '10 cylinders'
              WHEN 6 THEN '12 cylinders' WHEN 7 THEN 'other' WHEN 8 THEN '16 cylinders' END AS cylinders,
  CASE l_suppkey % 6 WHEN 0 THEN 'gas' WHEN 1 THEN 'GAS' WHEN 2 THEN 'diesel' WHEN 3 THEN 'hybrid'
                     WHEN 4 THEN 'electric' END AS fuel,
  CASE WHEN i % 79 = 0 THEN NULL
       ELSE CAST(CAST(l_quantity AS BIGINT) * 6500 + i % 6500 AS STRING) END AS odometer,
  CASE l_orderkey % 9 WHEN 6 THEN 'rebuilt' WHEN 7 THEN 'salvage' WHEN 8 THEN NULL ELSE 'clean' END AS title_status,
  CASE l_linenumber % 4 WHEN 0 THEN 'automatic' WHEN 1 THEN 'manual' WHEN 2 THEN 'other' END AS transmission,
  CASE l_partkey % 4 WHEN 0 THEN '4wd' WHEN 1 THEN 'fwd' WHEN 2 THEN 'rwd' END AS drive,
  CASE WHEN i % 200 < 90 THEN 'sedan' WHEN i % 200 < 130 THEN 'suv' WHEN i % 200 < 150 THEN 'pickup'
       WHEN i % 200 < 160 THEN 'truck' WHEN i % 200 < 167 THEN 'coupe' WHEN i % 200 < 173 THEN 'van'
       WHEN i % 200 < 178 THEN 'wagon' WHEN i % 200 < 182 THEN 'hatchback' WHEN i % 200 < 185 THEN 'mini-van'
       WHEN i % 200 < 187 THEN 'offroad' WHEN i % 200 < 188 THEN 'bus' WHEN i % 200 < 189 THEN 'convertible'
       WHEN i % 200 < 190 THEN 'other' END AS type
FROM (SELECT l.*, l_orderkey * 7 + l_partkey * 13 + l_suppkey * 31 + l_linenumber AS i FROM lineitem l) b
JOIN (VALUES
  (0,'toyota','Camry LE'),(1,' Toyota ','4 Runner SR5'),(2,'toyota','rav4 xle awd'),(3,'toyota','mr-2'),
  (4,'toyota','MR2'),(5,'toyota','prius v three'),(6,'honda','2014 accord EX-L V6'),(7,'honda','cr v ex'),
  (8,'honda','civic type r'),(9,'HONDA','CRV'),(10,'ford','f150 lariat'),(11,'ford','f-150 xlt (clean title)'),
  (12,'ford','super duty f-250'),(13,'ford','500'),(14,'ram','1500'),(15,'ram','1500 big horn'),
  (16,'ram','2500 hd'),(17,'ram','pickup 1500'),(18,'bmw','328i xdrive'),(19,'bmw','3-series'),
  (20,'bmw','x5 xdrive35i'),(21,'lexus','es350'),(22,'lexus','rx 350 f sport'),(23,'lexus','es 300h'),
  (24,'mercedes-benz','benz c300'),(25,'mercedes-benz','c-class c 300'),(26,'mercedes-benz','gle-class'),
  (27,'mercedes-benz','ml350'),(28,'mazda','cx-30 select'),(29,'mazda','3 i touring'),
  (30,'chrysler','town & country touring'),(31,'chrysler','300c'),(32,'chevrolet','suburban 1500 lt'),
  (33,'chevrolet','silverado'),(34,'chevrolet','2500 hd'),(35,'volvo','certified'),(36,'volvo','xc90 t6'),
  (37,'mini','cooper s'),(38,'mini','cooper countryman'),(39,'rover','rover range rover sport'),
  (40,'alfa-romeo','romeo giulia ti'),(41,'harley-davidson','davidson'),(42,'subaru','impreza wrx sti'),
  (43,'jeep','wrangler unlimited sahara'),(44,'nissan','rouge sv'),(45,'nissan','altima 2.5 s'),
  (46,'gmc','sierra denali'),(47,'dodge','grand'),(48,'tesla','model 3 long range'),(49,'tesla','s'),
  (50,'kia','lifted sportage lx'),(51,'hyundai','(one owner) 2014 elantra'),(52,'acura','mdx tech'),
  (53,'unknownco','superlongname x'),(54,'audi','a4 2.0t premium'),(55,'infiniti','g 37 coupe'),
  (56,'volkswagen','golf gti s'),(57,'pontiac','grand prix gt'),(58,NULL,'orphan'),(59,'ford',NULL)
) AS v(idx, manufacturer, model) ON v.idx = b.i % 60
"""

REQUESTS_SQL = """
SELECT e.event_id AS request_id, concat('10.0.0.', CAST(e.user_id % 20 AS STRING)) AS client_ip,
       e.ts AS requested_at, v.payload
FROM events e JOIN (VALUES
 (0,'{"year":2020,"manufacturer":"toyota","model":"camry","odometer":50000,"fuel":"gas","transmission":"automatic","condition":"good","drive":"fwd","type":"sedan","cylinders":"4 cylinders","title_status":"clean"}'),
 (1,'{"year":2020,"manufacturer":"toyota","model":"camry"}'),
 (2,'{"model_year":"2018","brand":" BMW ","model":"x5 xdrive35i","mileage":"60000","fuel_type":"diesel"}'),
 (3,'{"year":2015,"brand":"ford","model":"f150 lariat","milage":90000,"clean_title":false}'),
 (4,'{"year":2015,"brand":"ford","model":"f150","odometer":null,"mileage":90000}'),
 (5,'{"year":1899,"brand":"ford","model":"t","odometer":10}'),
 (6,'{"year":2999,"brand":"ford","model":"t","odometer":10}'),
 (7,'{"year":2016,"brand":"kia","model":"soul","odometer":1000001}'),
 (8,'{"year":"20x6","brand":"kia","model":"soul","odometer":1000}'),
 (9,'{"year":2016,"brand":"kia","model":"soul","odometer":1000,"clean_title":"false","title_status":"salvage"}'),
 (10,'{"brand":"kia","model":"soul","odometer":""}'),
 (11,'{"year":2016,"brand":"nobody","model":"nothing","odometer":-5}')
) AS v(idx, payload) ON v.idx = e.event_id % 12
"""

FAVORITES_SQL = """
SELECT CAST(o_orderkey AS BIGINT) AS id, o_orderkey % users AS user_id, p.p_brand AS brand, p.p_name AS model,
       CAST(1996 + o_orderkey % 30 AS INT) AS model_year, CAST(o_orderkey % 200000 AS DOUBLE) AS mileage,
       CAST(0 AS DOUBLE) AS engine, CASE o_orderkey % 3 WHEN 0 THEN 'gas' WHEN 1 THEN '' END AS fuel_type,
       'automatic' AS transmission, o_orderkey % 5 <> 0 AS clean_title, false AS has_accident,
       o_totalprice / 10 AS predicted_price, o_orderdate AS created_at, CAST(NULL AS STRING) AS prediction_data
FROM (SELECT *, (SELECT count(*) FROM part) AS parts, (SELECT count(*) FROM customer) AS users FROM orders) o
JOIN part p ON p.p_partkey = o_orderkey % parts
"""

USERS_SQL = """
SELECT c_custkey AS id, concat('user', CAST(c_custkey AS STRING), '@example.com') AS email,
       c_custkey % 4 <> 0 AS enabled
FROM customer
"""

USER_SIGNUPS_SQL = """
SELECT c_custkey AS id, concat('user', CAST(c_custkey % (SELECT 1 + CAST(floor(count(*) * 0.8) AS BIGINT) FROM customer) AS STRING),
       '@example.com') AS email
FROM customer
"""

# A ninth of the users change a dozen ids each, most of them their own; some users and ids do not exist.
CHANGES_SQL = """
SELECT e.event_id AS change_id, e.ts AS changed_at,
       CASE e.event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'create' ELSE 'update' END AS op,
       concat(CASE WHEN e.event_id % 41 = 0 THEN 'ghost' ELSE 'user' END, CAST(e.event_id % active AS STRING), '@example.com') AS user_email,
       CASE WHEN e.event_type IN ('signup','purchase') THEN CAST(NULL AS BIGINT)
            ELSE e.event_id % active + users * (CAST(floor(e.event_id / 7) AS BIGINT) % 12) + CASE WHEN e.event_id % 5 = 0 THEN 1 ELSE 0 END
       END AS favorite_id,
       CASE WHEN e.event_id % 17 = 0 THEN ' ' ELSE concat('brand', CAST(e.event_id % 9 AS STRING)) END AS brand,
       CASE WHEN e.event_id % 19 = 0 THEN NULL ELSE concat('model', CAST(e.event_id % 31 AS STRING)) END AS model,
       CASE WHEN e.event_id % 29 = 0 THEN NULL ELSE CAST(1990 + e.event_id % 35 AS INT) END AS model_year,
       CASE WHEN e.event_id % 31 = 0 THEN NULL ELSE CAST(e.event_id * 7 % 200000 AS DOUBLE) END AS mileage,
       CASE WHEN e.event_id % 37 = 0 THEN NULL ELSE CAST(e.event_id % 8 AS DOUBLE) / 2 END AS engine,
       CASE e.event_id % 4 WHEN 0 THEN 'gas' WHEN 1 THEN 'diesel' WHEN 2 THEN '' END AS fuel_type,
       CASE e.event_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'automatic' END AS transmission,
       CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE e.event_id % 7 <> 0 END AS clean_title,
       CASE WHEN e.event_id % 13 = 0 THEN NULL ELSE e.event_id % 6 = 0 END AS has_accident,
       CASE WHEN e.event_id % 23 = 0 THEN NULL ELSE e.value * 100 END AS predicted_price,
       e.props AS prediction_data
FROM (SELECT *, (SELECT count(*) FROM customer) AS users, (SELECT 1 + CAST(floor(count(*) / 9) AS BIGINT) FROM customer) AS active
      FROM events) e
"""

VIEWS = {
    "listings": LISTINGS_SQL,
    "requests": REQUESTS_SQL,
    "favorites": FAVORITES_SQL,
    "users": USERS_SQL,
    "user_signups": USER_SIGNUPS_SQL,
    "changes": CHANGES_SQL,
}


def register_base_tables(spark: SparkSession, sf_dir: str) -> None:
    for name in BASE_TABLES:
        spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).createOrReplaceTempView(name)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a DataFrame (lazy; column pruning reaches the scan)."""
    keep_compiled(spark)
    register_base_tables(spark, sf_dir)
    return spark.sql(VIEWS[name])


def register_fixtures(spark: SparkSession, sf_dir: str) -> None:
    register_base_tables(spark, sf_dir)
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)


def with_clause(*names: str) -> str:
    """``WITH`` prefix defining the named fixture views, for oracle SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n"
