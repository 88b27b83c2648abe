"""DuckDB SQL for every registered query with an exact SQL answer.

Written directly in SQL against the fixture views (inlined as CTEs) and the
shipped lookup files; it shares no expression code with the Spark side.
DuckDB regexes are RE2, ``regexp_replace`` needs the ``'g'`` option for
global replacement, ``quantile_cont`` is the interpolated percentile.
"""

from __future__ import annotations

from dealerlens.functions.text import NA_TOKENS
from dealerlens.sources import dims
from dealerlens.sources.fixtures import VIEWS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def na(x: str) -> str:
    return f"CASE WHEN {x} IN ({', '.join(_q(t) for t in NA_TOKENS)}) THEN NULL ELSE {x} END"


def num(x: str) -> str:
    return f"CASE WHEN isfinite(TRY_CAST(trim({x}) AS DOUBLE)) THEN TRY_CAST(trim({x}) AS DOUBLE) END"


def views(*names: str) -> str:
    return ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)


def lookup_tables() -> str:
    return f"""
known_tbl AS (SELECT manufacturer AS k_mfr, model AS k_name FROM read_csv({_q(str(dims.KNOWN_MODELS_FILE))},
    header = true, comment = '#', quote = '"', escape = '"', all_varchar = true)),
alias_tbl AS (SELECT manufacturer AS a_mfr, alias AS a_alias, coalesce(canonical, '') AS a_canon
    FROM read_csv({_q(str(dims.MODEL_ALIASES_FILE))}, header = true, comment = '#', quote = '"', escape = '"',
    all_varchar = true)),
trim_tbl AS (SELECT w FROM read_csv({_q(str(dims.TRIM_WORDS_FILE))}, header = false, comment = '#',
    delim = '\\t', quote = '', columns = {{'w': 'VARCHAR'}}))"""


SCAN = """
scan AS (SELECT listing_id, {cols} FROM listings)"""

LISTING_COLS = ("price", "year", "manufacturer", "model", "condition", "cylinders", "fuel", "odometer",
                "title_status", "transmission", "drive", "type")

FILL = (("fuel", "gas"), ("transmission", "automatic"), ("drive", "unknown"), ("type", "unknown"),
        ("condition", "unknown"), ("title_status", "clean"), ("cylinders", "unknown"))


def token_class(c: str) -> str:
    return f"""CASE WHEN {c} IS NULL OR {c} = '' THEN 0
        WHEN {c} IN (SELECT w FROM trim_tbl) THEN 0
        WHEN regexp_full_match({c}, '[0-9]{{5,}}') THEN 0
        WHEN regexp_full_match({c}, '[0-9]+') OR regexp_full_match({c}, '[a-z]?[0-9]{{2,4}}') THEN 1
        WHEN contains({c}, '-') AND regexp_matches({c}, '[0-9]') THEN 1
        WHEN regexp_full_match({c}, '[a-z]{{1,6}}') THEN 2
        ELSE 0 END"""


def canonical_chain(src: str) -> str:
    """CTEs pre -> strp -> kn -> tok -> walk -> canon over ``src`` (needs manufacturer, model_raw)."""
    pre = strip(
        "regexp_replace(regexp_replace(regexp_replace(lower(" + strip("model_raw") + "), "
        "'\\(.*?\\)', '', 'g'), '[*#@!$%&/\\\\]', '', 'g'), '^[0-9]{4}\\s+', '')"
    )
    s = "regexp_replace(pre, '^lifted\\s+', '')"
    brand = f"""CASE manufacturer
        WHEN 'mercedes-benz' THEN regexp_replace(regexp_replace(regexp_replace({s}, '^benz\\s+', ''),
             '^mercedes-amg\\s*', ''), '^[a-z]{{1,3}}-class\\s*', '')
        WHEN 'ford' THEN regexp_replace({s}, '^super\\s+duty\\s+', '')
        WHEN 'ram' THEN regexp_replace({s}, '^all-new\\s+', '')
        WHEN 'alfa-romeo' THEN regexp_replace({s}, '^romeo\\s*', '')
        WHEN 'rover' THEN regexp_replace({s}, '^rover\\s+', '')
        WHEN 'harley-davidson' THEN regexp_replace({s}, '^davidson\\s*', '')
        WHEN 'mini' THEN regexp_replace({s}, '^cooper\\s+', '')
        ELSE {s} END"""
    return f""",
pre AS (SELECT *, {pre} AS pre FROM {src}),
strp AS (SELECT *, {strip(brand)} AS stripped FROM pre),
kn AS (SELECT strp.*, (SELECT k_name FROM known_tbl WHERE k_mfr = strp.manufacturer
          AND starts_with(strp.stripped, k_name) ORDER BY length(k_name) DESC LIMIT 1) AS known_model FROM strp),
tok0 AS (SELECT *, list_filter(string_split_regex(stripped, '\\s+'), lambda t: t <> '') AS toks0 FROM kn),
tok AS (SELECT *, CASE WHEN regexp_full_match(toks0[1], '[0-9]{{4}}') THEN toks0[2:] ELSE toks0 END AS toks
        FROM tok0),
tokc AS (SELECT *, toks[1] AS t1, regexp_replace(toks[2], '[^a-z0-9-]', '', 'g') AS c2,
                regexp_replace(toks[3], '[^a-z0-9-]', '', 'g') AS c3 FROM tok),
walk AS (SELECT *, CASE WHEN stripped = '' THEN ''
        WHEN known_model IS NOT NULL THEN known_model
        WHEN t1 IS NULL THEN ''
        WHEN ({token_class('c2')}) = 0 THEN t1
        WHEN ({token_class('c2')}) = 1 THEN t1 || ' ' || c2
        WHEN ({token_class('c3')}) = 0 THEN t1 || ' ' || c2
        ELSE t1 || ' ' || c2 || ' ' || c3 END AS model_walk FROM tokc),
canon AS (SELECT walk.*, CASE WHEN a_alias IS NOT NULL THEN a_canon ELSE model_walk END AS model
          FROM walk LEFT JOIN alias_tbl ON a_mfr = manufacturer AND a_alias = model_walk)"""


def cleaned_chain() -> str:
    """listings -> scan -> req -> nums -> ranged -> filled (with model_raw) -> canonical chain -> kept."""
    cols = ", ".join(f"{na(c)} AS {c}" for c in LISTING_COLS)
    fills = ", ".join(f"lower({strip(f'coalesce({c}, {_q(d)})')}) AS {c}" for c, d in FILL)
    return (
        "WITH " + views("listings") + "," + lookup_tables() + "," + SCAN.format(cols=cols) + f""",
req AS (SELECT * FROM scan WHERE price IS NOT NULL AND year IS NOT NULL AND manufacturer IS NOT NULL
        AND model IS NOT NULL AND odometer IS NOT NULL),
nums AS (SELECT listing_id, {num('price')} AS price, {num('year')} AS year, {num('odometer')} AS odometer,
         manufacturer, model, {', '.join(c for c, _ in FILL)} FROM req),
ranged AS (SELECT * FROM nums WHERE price BETWEEN 1000 AND 100000 AND year BETWEEN 2000 AND 2025
           AND odometer BETWEEN 0 AND 300000),
filled AS (SELECT listing_id, price, year, odometer, lower({strip('manufacturer')}) AS manufacturer,
           lower({strip('model')}) AS model_raw, {fills} FROM ranged)"""
        + canonical_chain("filled")
        + """,
kept AS (SELECT * EXCLUDE (model_walk, known_model, stripped, pre, toks0, toks, t1, c2, c3)
         FROM canon WHERE length(model) > 0)
"""
    )


def oracle_sql() -> dict[str, str]:
    base = cleaned_chain()
    scan_only = "WITH " + views("listings") + "," + SCAN.format(
        cols=", ".join(f"{na(c)} AS {c}" for c in LISTING_COLS))
    pop = base + ", pop AS (SELECT manufacturer, model, count(*) AS n FROM kept GROUP BY ALL HAVING count(*) >= 15)\n"
    gm = "(SELECT avg(price) FROM kept)"
    enc = lambda n, m: f"(({n}) / (({n}) + 50.0)) * ({m}) + (1 - ({n}) / (({n}) + 50.0)) * {gm}"
    top = base + """, tt AS (SELECT type, count(*) AS n FROM kept GROUP BY type ORDER BY n DESC, type LIMIT 12)
"""
    out = {
        "listings_scan": scan_only + "\nSELECT * FROM scan",
        "coerced_numbers": scan_only + f"""
SELECT listing_id, {num('price')} AS price, {num('year')} AS year, {num('odometer')} AS odometer FROM scan
WHERE price IS NOT NULL AND year IS NOT NULL AND manufacturer IS NOT NULL AND model IS NOT NULL
  AND odometer IS NOT NULL""",
        "filled_categories": scan_only + f"""
SELECT listing_id, lower({strip('manufacturer')}) AS manufacturer,
  {', '.join(f"lower({strip(f'coalesce({c}, {_q(d)})')}) AS {c}" for c, d in FILL)} FROM scan""",
        "clean_listings": base + """
SELECT listing_id, price, year, odometer, manufacturer, model_raw, fuel, transmission, drive, type, condition,
       title_status, cylinders FROM filled""",
        "model_precleaned": base + "SELECT listing_id, manufacturer, model_raw, pre AS model_pre FROM canon",
        "model_prefix_stripped": base + "SELECT listing_id, manufacturer, stripped AS model_stripped FROM canon",
        "known_model_match": base + "SELECT listing_id, manufacturer, known_model FROM canon",
        "normalized_models": base + "SELECT listing_id, manufacturer, model_walk FROM canon",
        "aliased_models": base + "SELECT listing_id, manufacturer, model_raw, model FROM canon",
        "cleaning_funnel": base + """
SELECT (SELECT count(*) FROM listings) AS raw_rows, (SELECT count(*) FROM ranged) AS filtered_rows,
       count(*) AS kept_rows, count(DISTINCT model_raw) AS models_before, count(DISTINCT model) AS models_after
FROM kept""",
        "model_counts": base + "SELECT manufacturer, model, count(*) AS n FROM kept GROUP BY manufacturer, model",
        "popular_models": pop + "SELECT * FROM pop",
        "popular_summary": pop + """
SELECT count(*) AS popular_pairs, count(DISTINCT model) AS popular_model_names FROM pop""",
        "popular_sample": pop + """
SELECT manufacturer, position, model FROM (SELECT manufacturer, model,
  row_number() OVER (PARTITION BY manufacturer ORDER BY model) AS position FROM pop
  WHERE manufacturer IN ('toyota', 'honda', 'lexus', 'ford', 'bmw')) WHERE position <= 20""",
        "models_for_brand": pop + """
SELECT manufacturer, row_number() OVER (PARTITION BY manufacturer ORDER BY model) AS position, model FROM pop""",
        "brands_models": pop + """
SELECT manufacturer, count(*) AS n_models, to_json(list(model ORDER BY model)) AS models_json
FROM pop GROUP BY manufacturer""",
        "top_types": top + "SELECT type, n, row_number() OVER (ORDER BY n DESC, type) AS rank FROM tt",
        "category_values": top + """
SELECT category, row_number() OVER (PARTITION BY category ORDER BY value) AS position, value FROM (
  SELECT DISTINCT 'manufacturers' AS category, manufacturer AS value FROM kept
  UNION SELECT DISTINCT 'fuel_types', fuel FROM kept
  UNION SELECT DISTINCT 'transmissions', transmission FROM kept
  UNION SELECT DISTINCT 'drive_types', drive FROM kept WHERE drive IS NOT NULL
  UNION SELECT 'vehicle_types', type FROM tt)
UNION ALL SELECT * FROM (VALUES ('conditions', 1, 'new'), ('conditions', 2, 'like new'),
  ('conditions', 3, 'excellent'), ('conditions', 4, 'good'), ('conditions', 5, 'fair'),
  ('conditions', 6, 'salvage')) c(category, position, value)""",
        "car_options": pop.replace("\n", "\n", 1) + """, tt AS (SELECT type, count(*) AS n FROM kept GROUP BY type
   ORDER BY n DESC, type LIMIT 12),
bm AS (SELECT manufacturer, list(model ORDER BY model) AS models FROM pop GROUP BY manufacturer)
SELECT to_json(struct_pack(
  brands_models := (SELECT map(list(manufacturer ORDER BY manufacturer), list(models ORDER BY manufacturer)) FROM bm),
  conditions := ['new', 'like new', 'excellent', 'good', 'fair', 'salvage'],
  drive_types := (SELECT list(DISTINCT drive ORDER BY drive) FROM kept WHERE drive IS NOT NULL),
  fuel_types := (SELECT list(DISTINCT fuel ORDER BY fuel) FROM kept),
  transmissions := (SELECT list(DISTINCT transmission ORDER BY transmission) FROM kept),
  vehicle_types := (SELECT list(type ORDER BY type) FROM tt)))::VARCHAR AS options""",
        "global_mean": base + "SELECT avg(price) AS global_mean, count(*) AS n FROM kept",
        "encode_manufacturer": base + f"""
SELECT manufacturer, count(*) AS n, avg(price) AS mean_price, {enc('count(*)', 'avg(price)')} AS encoding
FROM kept GROUP BY manufacturer""",
        "encode_model": base + f"""
SELECT manufacturer, model, count(*) AS n, avg(price) AS mean_price, {enc('count(*)', 'avg(price)')} AS encoding
FROM kept GROUP BY manufacturer, model""",
        "price_cap": base + "SELECT quantile_cont(price, 0.99) AS price_cap FROM kept",
    }
    out.update(feature_sql(base))
    out.update(request_sql(base))
    out.update(favorites_sql())
    out.update(quota_sql())
    return out


#: M1: hold-out rows by the first 32 bits of an MD5 of seed and key.
SPLIT = ("CASE WHEN ('0x' || substr(md5('42:' || listing_id::VARCHAR), 1, 8))::BIGINT % 10000 < 1500 "
         "THEN 'test' ELSE 'train' END")


def favorites_sql() -> dict[str, str]:
    head = "WITH " + views("favorites", "users", "changes", "user_signups") + """,
rs AS (SELECT c.*, u.id AS actor_id FROM changes c LEFT JOIN users u ON u.email = c.user_email),
cr AS (SELECT rs.* REPLACE (coalesce(clean_title, true) AS clean_title, coalesce(has_accident, false) AS has_accident),
   (SELECT max(id) FROM favorites) + change_id AS new_id,
   CASE WHEN mileage IS NULL THEN 'Mileage must be a number' WHEN engine IS NULL THEN 'Engine must be a number'
        WHEN model_year IS NULL THEN 'Model year must be a number'
        WHEN predicted_price IS NULL THEN 'Predicted price is required'
        WHEN actor_id IS NULL THEN 'User not found'
        WHEN brand IS NULL OR trim(brand) = '' THEN 'Brand is required'
        WHEN model IS NULL OR trim(model) = '' THEN 'Model is required' END AS message
   FROM rs WHERE op = 'create'),
tg AS (SELECT id, user_id AS owner, NULL::TIMESTAMP AS born_at, NULL::BIGINT AS born_cid FROM favorites
       UNION ALL SELECT new_id, actor_id, changed_at, change_id FROM cr WHERE message IS NULL),
ud AS (SELECT rs.*, tg.id AS tid, owner,
   tg.id IS NOT NULL AND (born_at IS NULL OR changed_at > born_at OR (changed_at = born_at AND change_id > born_cid))
     AS ex
   FROM rs LEFT JOIN tg ON tg.id = rs.favorite_id WHERE op IN ('update', 'delete')),
fd AS (SELECT favorite_id AS fd_id, changed_at AS fd_at, change_id AS fd_cid FROM (
   SELECT *, row_number() OVER (PARTITION BY favorite_id ORDER BY changed_at, change_id) AS rn FROM ud
   WHERE op = 'delete' AND ex AND actor_id = owner) WHERE rn = 1),
acc AS (SELECT ud.*, CASE
   WHEN NOT ex OR (fd_id IS NOT NULL AND (changed_at > fd_at OR (changed_at = fd_at AND change_id > fd_cid)))
     THEN 'Favorite prediction not found'
   WHEN actor_id IS NULL THEN 'User not found'
   WHEN actor_id <> owner THEN 'You don''t have permission to access this resource' END AS message
   FROM ud LEFT JOIN fd ON fd_id = favorite_id),
dl AS (SELECT favorite_id AS id, change_id FROM acc WHERE op = 'delete' AND message IS NULL),
lu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY favorite_id ORDER BY changed_at DESC, change_id DESC)
   AS rn FROM acc WHERE op = 'update' AND message IS NULL) WHERE rn = 1),
created AS (SELECT new_id AS id, actor_id AS user_id, brand, model, model_year,
   mileage, engine, fuel_type, transmission, clean_title, has_accident, predicted_price, NULL::VARCHAR AS prediction_data, changed_at AS created_at
   FROM cr WHERE message IS NULL),
base AS (SELECT id, user_id, brand, model, model_year, mileage, engine, fuel_type, transmission, clean_title,
   has_accident, predicted_price, prediction_data, created_at FROM favorites UNION ALL SELECT * FROM created),
fin AS (SELECT b.id, b.user_id,
   CASE WHEN lu.favorite_id IS NULL THEN b.brand ELSE lu.brand END AS brand,
   CASE WHEN lu.favorite_id IS NULL THEN b.model ELSE lu.model END AS model,
   CASE WHEN lu.favorite_id IS NULL THEN b.model_year ELSE lu.model_year END AS model_year,
   CASE WHEN lu.favorite_id IS NULL THEN b.mileage ELSE lu.mileage END AS mileage,
   CASE WHEN lu.favorite_id IS NULL THEN b.engine ELSE lu.engine END AS engine,
   CASE WHEN lu.favorite_id IS NULL THEN b.fuel_type ELSE lu.fuel_type END AS fuel_type,
   CASE WHEN lu.favorite_id IS NULL THEN b.transmission ELSE lu.transmission END AS transmission,
   CASE WHEN lu.favorite_id IS NULL THEN b.clean_title ELSE coalesce(lu.clean_title, true) END AS clean_title,
   CASE WHEN lu.favorite_id IS NULL THEN b.has_accident ELSE coalesce(lu.has_accident, false) END AS has_accident,
   CASE WHEN lu.favorite_id IS NULL THEN b.predicted_price ELSE lu.predicted_price END AS predicted_price,
   CASE WHEN lu.favorite_id IS NULL THEN b.prediction_data ELSE lu.prediction_data END AS prediction_data,
   b.created_at, lu.change_id AS last_change_id
   FROM base b LEFT JOIN lu ON lu.favorite_id = b.id WHERE b.id NOT IN (SELECT id FROM dl))
"""
    code = ("CASE WHEN op = 'create' THEN 400 WHEN lower(message) LIKE '%expired%' OR lower(message) LIKE '%invalid%' "
            "THEN 400 WHEN lower(message) LIKE '%not verified%' THEN 401 WHEN lower(message) LIKE '%not found%' "
            "THEN 404 ELSE 400 END")
    fmt0 = "format('{:,.0f}', round(predicted_price))"
    return {
        "users_scan": head + "SELECT id, email, enabled FROM users",
        "duplicate_emails": head + "SELECT email, count(*) AS n FROM user_signups GROUP BY email HAVING count(*) > 1",
        "favorites_by_user": head + """SELECT u.email, f.id, f.brand, f.model, f.predicted_price
FROM favorites f JOIN users u ON u.id = f.user_id""",
        "favorite_access": head + f"""SELECT change_id, op, favorite_id, message,
  CASE WHEN message IS NULL THEN NULL ELSE {code} END AS code FROM acc""",
        "favorite_exists": head + """SELECT change_id, favorite_id FROM rs
WHERE EXISTS (SELECT 1 FROM favorites f WHERE f.id = rs.favorite_id AND f.user_id = rs.actor_id)""",
        "favorites_created": head + "SELECT * FROM created",
        "favorites_updated": head + "SELECT * FROM fin WHERE last_change_id IS NOT NULL",
        "favorites_deleted": head + "SELECT * FROM dl",
        "favorites_snapshot": head + "SELECT * EXCLUDE (last_change_id) FROM fin",
        "favorites_rejected": head + f"""SELECT change_id, op, favorite_id, message, {code} AS code FROM acc
WHERE message IS NOT NULL UNION ALL
SELECT change_id, op, new_id AS favorite_id, message, 400 AS code FROM cr WHERE message IS NOT NULL""",
        "favorites_report": head + f"""SELECT id,
  CASE WHEN brand IS NULL OR brand = '' THEN '-' ELSE brand END AS brand,
  CASE WHEN model IS NULL OR model = '' THEN '-' ELSE model END AS model,
  CASE WHEN model_year IS NULL OR model_year = 0 THEN '-' ELSE model_year::VARCHAR END AS model_year,
  CASE WHEN mileage IS NULL OR mileage = 0 THEN '-'
       ELSE rtrim(rtrim(format('{{:,.3f}}', round(mileage, 3)), '0'), '.') || ' mi' END AS mileage,
  CASE WHEN fuel_type IS NULL OR fuel_type = '' THEN '-' ELSE fuel_type END AS fuel_type,
  CASE WHEN transmission IS NULL OR transmission = '' THEN '-' ELSE transmission END AS transmission,
  CASE WHEN clean_title THEN 'Yes' ELSE 'No' END AS clean_title,
  '$' || CASE WHEN predicted_price IS NULL THEN '0' ELSE {fmt0} END AS price FROM fin""",
    }


def quota_sql() -> dict[str, str]:
    head = "WITH " + views("requests") + """,
w AS (SELECT request_id, client_ip, requested_at, 'hour' AS period, date_trunc('hour', requested_at) AS window_start,
        2 AS max_requests FROM requests
      UNION ALL SELECT request_id, client_ip, requested_at, 'day', date_trunc('day', requested_at), 15 FROM requests)
"""
    return {
        "quota_usage": head + """SELECT client_ip, period, window_start, max_requests, count(*) AS n,
  count(*) > max_requests AS over_limit FROM w
GROUP BY client_ip, period, window_start, max_requests""",
        "quota_rejected": head + """SELECT request_id, client_ip, period, window_start FROM (
  SELECT *, row_number() OVER (PARTITION BY client_ip, period, window_start ORDER BY requested_at, request_id) AS rn
  FROM w) WHERE rn > max_requests""",
    }


def _pick(keys, fn) -> str:
    """First key whose JSON path exists (present, possibly null)."""
    whens = " ".join(f"WHEN json_type(payload, '$.{k}') IS NOT NULL THEN {fn(k)}" for k in keys)
    return f"CASE {whens} END"


def _nullish(keys, fn) -> str:
    whens = " ".join(f"WHEN json_type(payload, '$.{k}') <> 'NULL' THEN {fn(k)}" for k in keys)
    return f"CASE {whens} END"


def _pystr(k: str) -> str:
    t = f"json_type(payload, '$.{k}')"
    return (f"CASE {t} WHEN 'NULL' THEN 'None' WHEN 'VARCHAR' THEN json_extract_string(payload, '$.{k}') "
            f"WHEN 'BOOLEAN' THEN CASE WHEN json_extract(payload, '$.{k}')::BOOLEAN THEN 'True' ELSE 'False' END "
            f"ELSE json_extract(payload, '$.{k}')::VARCHAR END")


def _truthy(k: str) -> str:
    t = f"json_type(payload, '$.{k}')"
    return (f"CASE {t} WHEN 'NULL' THEN false WHEN 'BOOLEAN' THEN json_extract(payload, '$.{k}')::BOOLEAN "
            f"WHEN 'VARCHAR' THEN length(json_extract_string(payload, '$.{k}')) > 0 "
            f"WHEN 'ARRAY' THEN json_array_length(payload, '$.{k}') > 0 "
            f"WHEN 'OBJECT' THEN json_extract(payload, '$.{k}')::VARCHAR <> '{{}}' "
            f"ELSE json_extract(payload, '$.{k}')::DOUBLE <> 0 END")


def _jsnumber(k: str) -> str:
    t = f"json_type(payload, '$.{k}')"
    sv = f"json_extract_string(payload, '$.{k}')"
    return (f"CASE {t} WHEN 'BOOLEAN' THEN CASE WHEN json_extract(payload, '$.{k}')::BOOLEAN THEN 1.0 ELSE 0.0 END "
            f"WHEN 'VARCHAR' THEN CASE WHEN trim({sv}) = '' THEN 0.0 "
            f"WHEN regexp_full_match(trim({sv}), '[+-]?([0-9]+[.]?[0-9]*([eE][+-]?[0-9]+)?|[.][0-9]+([eE][+-]?[0-9]+)?|Infinity)') "
            f"THEN TRY_CAST(trim({sv}) AS DOUBLE) END "
            f"WHEN 'ARRAY' THEN NULL WHEN 'OBJECT' THEN NULL ELSE json_extract(payload, '$.{k}')::DOUBLE END")


def _jsbool(k: str) -> str:
    t = f"json_type(payload, '$.{k}')"
    return (f"CASE {t} WHEN 'VARCHAR' THEN length(json_extract_string(payload, '$.{k}')) > 0 "
            f"WHEN 'BOOLEAN' THEN json_extract(payload, '$.{k}')::BOOLEAN WHEN 'ARRAY' THEN true "
            f"WHEN 'OBJECT' THEN true ELSE json_extract(payload, '$.{k}')::DOUBLE <> 0 END")


REQ_FIELDS = (("manufacturer", ("manufacturer", "brand"), ""), ("model_raw", ("model",), ""),
              ("fuel", ("fuel", "fuel_type"), "gas"), ("transmission", ("transmission",), "automatic"),
              ("drive", ("drive",), "unknown"), ("type", ("type",), "unknown"), ("condition", ("condition",), "good"),
              ("cylinders", ("cylinders",), "4 cylinders"), ("title_status", ("title_status",), "clean"))


def request_sql(base: str) -> dict[str, str]:
    odo_keys, year_keys = ("odometer", "mileage", "milage"), ("year", "model_year")
    odo = _pick(odo_keys, lambda k: f"json_extract(payload, '$.{k}')")
    yr = _pick(year_keys, lambda k: f"json_extract(payload, '$.{k}')")
    kind = ("CASE WHEN NOT json_valid(payload) THEN 'empty' WHEN json_type(payload) = 'OBJECT' THEN 'object' "
            "WHEN json_extract(payload, '$')::VARCHAR IN ('[]', '\"\"', '0', 'false', 'null') THEN 'empty' "
            "ELSE 'bad' END")
    parsed = "WITH " + views("requests") + f""",
r0 AS (SELECT *, {kind} AS body_kind FROM requests),
r AS (SELECT *, CASE WHEN body_kind = 'object' THEN {odo} END AS odo,
                CASE WHEN body_kind = 'object' THEN {yr} END AS yr FROM r0),
rp AS (SELECT *, json_type(odo) AS ot, json_type(yr) AS yt FROM r),
rv AS (SELECT *,
  CASE WHEN yr IS NULL THEN 0.0
       WHEN yt IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN trunc(yr::DOUBLE)
       WHEN yt = 'BOOLEAN' THEN CASE WHEN yr::BOOLEAN THEN 1.0 ELSE 0.0 END
       WHEN yt = 'VARCHAR' AND regexp_full_match(trim(json_extract_string(yr, '$')), '[+-]?[0-9]+(_[0-9]+)*')
         THEN replace(trim(json_extract_string(yr, '$')), '_', '')::DOUBLE END AS year,
  CASE WHEN ot IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN odo::DOUBLE
       WHEN ot = 'BOOLEAN' THEN CASE WHEN odo::BOOLEAN THEN 1.0 ELSE 0.0 END
       WHEN ot = 'VARCHAR' THEN TRY_CAST(replace(trim(json_extract_string(odo, '$')), '_', '') AS DOUBLE) END AS odometer
  FROM rp),
rc AS (SELECT *, CASE
  WHEN body_kind = 'bad' THEN 'An unexpected error occurred. Please try again.'
  WHEN body_kind = 'empty' OR odo IS NULL OR ot = 'NULL' OR (ot = 'VARCHAR' AND json_extract_string(odo, '$') = '')
    THEN 'Missing mileage/odometer'
  WHEN year IS NULL OR odometer IS NULL THEN 'Invalid input — check your values and try again.'
  WHEN year < 1900 OR year > 2027 THEN 'Year must be between 1900 and 2026'
  WHEN (odometer < 0 OR odometer > 1000000) AND NOT isnan(odometer) THEN 'Mileage must be between 0 and 1,000,000'
  END AS error FROM rv)"""
    fields = ", ".join(
        f"lower({strip(f'coalesce({_pick(keys, _pystr)}, {_q(d)})')}) AS {name}" for name, keys, d in REQ_FIELDS)
    norm = base.rstrip() + ",\n" + parsed.replace("WITH ", "", 1).replace(
        "requests AS (", "requests AS (", 1) + f""",
rn AS (SELECT request_id, year, odometer, {fields},
  CASE WHEN json_type(payload, '$.clean_title') IS NOT NULL AND json_type(payload, '$.clean_title') <> 'NULL'
       THEN CASE WHEN {_truthy('clean_title')} THEN 1 ELSE 0 END ELSE NULL END AS ct_given,
  greatest(2025 - year, 0.0) AS age, odometer / (greatest(2025 - year, 0.0) + 1) AS miles_per_year
  FROM rc WHERE error IS NULL),
rn2 AS (SELECT * EXCLUDE (ct_given), coalesce(ct_given, CASE WHEN title_status = 'clean' THEN 1 ELSE 0 END)
  AS clean_title FROM rn)"""
    chain = canonical_chain("rn2").replace("pre AS (", "rq_pre AS (").replace("FROM pre)", "FROM rq_pre)")
    for cte in ("strp", "kn", "tok0", "tokc", "tok", "walk", "canon"):
        chain = chain.replace(f"{cte} AS (", f"rq_{cte} AS (").replace(f"FROM {cte})", f"FROM rq_{cte})") \
            .replace(f"FROM {cte} LEFT", f"FROM rq_{cte} LEFT").replace(f" {cte}.", f" rq_{cte}.") \
            .replace(f"({cte}.", f"(rq_{cte}.")
    chain = chain.replace("rq_tok0)", "rq_tok0)")
    normalized = norm + chain
    cyl = ("CASE cylinders WHEN '3 cylinders' THEN 3 WHEN '4 cylinders' THEN 4 WHEN '5 cylinders' THEN 5 "
           "WHEN '6 cylinders' THEN 6 WHEN '8 cylinders' THEN 8 WHEN '10 cylinders' THEN 10 "
           "WHEN '12 cylinders' THEN 12 ELSE 4 END")
    cond = ("CASE condition WHEN 'new' THEN 6 WHEN 'like new' THEN 5 WHEN 'excellent' THEN 4 WHEN 'good' THEN 3 "
            "WHEN 'fair' THEN 2 WHEN 'salvage' THEN 1 ELSE 3 END")
    rfeat = normalized + f""",
gm AS (SELECT avg(price) AS g FROM kept),
me AS (SELECT manufacturer AS me_m, count(*) AS n, avg(price) AS mp FROM kept GROUP BY 1),
pe AS (SELECT manufacturer AS pe_m, model AS pe_model, count(*) AS n, avg(price) AS mp FROM kept GROUP BY 1, 2),
tt AS (SELECT type AS tt_type FROM kept GROUP BY type ORDER BY count(*) DESC, type LIMIT 12),
ktc AS (SELECT CASE WHEN type IN (SELECT tt_type FROM tt) THEN type ELSE 'other' END AS tc FROM kept),
rf AS (SELECT c.*, {cyl} AS cylinders_num, {cond} AS condition_ord,
   coalesce(me.n / (me.n + 50.0) * me.mp + (1 - me.n / (me.n + 50.0)) * gm.g, gm.g) AS manufacturer_encoded,
   coalesce(pe.n / (pe.n + 50.0) * pe.mp + (1 - pe.n / (pe.n + 50.0)) * gm.g, gm.g) AS model_encoded,
   CASE WHEN type IN (SELECT tt_type FROM tt) THEN type ELSE 'other' END AS type_clean
 FROM rq_canon c CROSS JOIN gm LEFT JOIN me ON me_m = c.manufacturer
 LEFT JOIN pe ON pe_m = c.manufacturer AND pe_model = c.model),
rfa AS (SELECT *, concat_ws(',',
   CASE WHEN fuel IN (SELECT fuel FROM kept) THEN 'fuel_' || fuel END,
   CASE WHEN transmission IN (SELECT transmission FROM kept) THEN 'trans_' || transmission END,
   CASE WHEN drive IN (SELECT drive FROM kept) THEN 'drive_' || drive END,
   CASE WHEN type_clean IN (SELECT tc FROM ktc) THEN 'type_' || type_clean END) AS one_hot_active FROM rf)
"""
    cap_txt = ("CASE WHEN ot = 'VARCHAR' THEN json_extract_string(odo, '$') ELSE odo::VARCHAR END")
    pref = (f"regexp_extract({cap_txt}, '^\\s*([+-]?(Infinity|[0-9]+[.]?[0-9]*([eE][+-]?[0-9]+)?"
            f"|[.][0-9]+([eE][+-]?[0-9]+)?))', 1)")
    pay_text = lambda keys: f"coalesce({_nullish(keys, _pystr)}, '')"
    return {
        "requests_parsed": parsed + f"""
SELECT request_id, client_ip, requested_at, body_kind,
  CASE WHEN body_kind = 'object' THEN {_pick(odo_keys, _q)} END AS odometer_key, odo::VARCHAR AS odometer_json,
  CASE WHEN body_kind = 'object' THEN {_pick(year_keys, _q)} END AS year_key, yr::VARCHAR AS year_json,
  CASE WHEN body_kind = 'object' THEN {_pick(('manufacturer', 'brand'), _q)} END AS manufacturer_key,
  CASE WHEN body_kind = 'object' THEN {_pick(('fuel', 'fuel_type'), _q)} END AS fuel_key FROM rp""",
        "score_outcomes": parsed + """
SELECT request_id, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, error,
  CASE WHEN error IS NULL THEN 200 WHEN error LIKE 'An unexpected%' THEN 500 ELSE 400 END AS code,
  CASE WHEN error IS NULL THEN true END AS within_bounds FROM rc""",
        "request_validation": parsed + """
SELECT request_id, CASE WHEN error IS NULL THEN 200 WHEN error LIKE 'An unexpected%' THEN 500 ELSE 400 END AS code,
  error FROM rc""",
        "requests_normalized": normalized + """
SELECT request_id, year, odometer, manufacturer, model, fuel, transmission, drive, type, condition, cylinders,
  title_status, clean_title, age, miles_per_year FROM rq_canon""",
        "requests_features": rfeat + """
SELECT request_id, odometer, age, miles_per_year, CAST(cylinders_num AS DOUBLE) AS cylinders_num,
  CAST(condition_ord AS DOUBLE) AS condition_ord, CAST(clean_title AS DOUBLE) AS clean_title,
  manufacturer_encoded, model_encoded, one_hot_active FROM rfa""",
        "price_postprocess": rfeat + """
SELECT request_id, round(least(greatest(model_encoded, 500), (SELECT quantile_cont(price, 0.99) FROM kept)), 2)
  AS prediction FROM rfa""",
        "capped_odometer": parsed + f"""
SELECT request_id, CASE WHEN {pref} <> '' THEN least(TRY_CAST({pref} AS DOUBLE), 300000.0) END AS odometer_capped
FROM rp""",
        "favorite_payload": parsed + f"""
SELECT request_id, {pay_text(('brand',))} AS brand, {pay_text(('model',))} AS model,
  coalesce({_nullish(('mileage', 'milage'), _jsnumber)}, CASE WHEN coalesce(json_type(payload, '$.mileage'), 'NULL') = 'NULL'
    AND coalesce(json_type(payload, '$.milage'), 'NULL') = 'NULL' THEN 0.0 END) AS mileage,
  coalesce({_nullish(('engine',), _jsnumber)}, CASE WHEN coalesce(json_type(payload, '$.engine'), 'NULL') = 'NULL'
    THEN 0.0 END) AS engine,
  coalesce({_nullish(('modelYear', 'model_year'), _jsnumber)}, CASE WHEN coalesce(json_type(payload, '$.modelYear'), 'NULL')
    = 'NULL' AND coalesce(json_type(payload, '$.model_year'), 'NULL') = 'NULL' THEN 0.0 END) AS model_year,
  {pay_text(('fuelType', 'fuel_type'))} AS fuel_type, {pay_text(('transmission',))} AS transmission,
  coalesce({_nullish(('cleanTitle', 'clean_title'), _jsbool)}, false) AS clean_title,
  coalesce({_nullish(('hasAccident', 'has_accident'), _jsbool)}, false) AS has_accident,
  coalesce({_nullish(('predictedPrice', 'prediction'), _jsnumber)}, CASE WHEN coalesce(json_type(payload, '$.predictedPrice'),
    'NULL') = 'NULL' AND coalesce(json_type(payload, '$.prediction'), 'NULL') = 'NULL' THEN 0.0 END) AS predicted_price
FROM rp""",
    }


def feature_sql(base: str) -> dict[str, str]:
    cyl = ("CASE cylinders WHEN '3 cylinders' THEN 3 WHEN '4 cylinders' THEN 4 WHEN '5 cylinders' THEN 5 "
           "WHEN '6 cylinders' THEN 6 WHEN '8 cylinders' THEN 8 WHEN '10 cylinders' THEN 10 "
           "WHEN '12 cylinders' THEN 12 ELSE 4 END")
    cond = ("CASE condition WHEN 'new' THEN 6 WHEN 'like new' THEN 5 WHEN 'excellent' THEN 4 WHEN 'good' THEN 3 "
            "WHEN 'fair' THEN 2 WHEN 'salvage' THEN 1 ELSE 3 END")
    feats = base + f""",
gm AS (SELECT avg(price) AS g FROM kept),
me AS (SELECT manufacturer AS me_m, count(*) AS n, avg(price) AS mp FROM kept GROUP BY 1),
pe AS (SELECT manufacturer AS pe_m, model AS pe_model, count(*) AS n, avg(price) AS mp FROM kept GROUP BY 1, 2),
tt AS (SELECT type AS tt_type FROM kept GROUP BY type ORDER BY count(*) DESC, type LIMIT 12),
feat AS (SELECT k.*, greatest(2021 - year, 0) AS age, odometer / (greatest(2021 - year, 0) + 1) AS miles_per_year,
   {cyl} AS cylinders_num, {cond} AS condition_ord, CASE WHEN title_status = 'clean' THEN 1 ELSE 0 END AS clean_title,
   coalesce(me.n / (me.n + 50.0) * me.mp + (1 - me.n / (me.n + 50.0)) * gm.g, gm.g) AS manufacturer_encoded,
   coalesce(pe.n / (pe.n + 50.0) * pe.mp + (1 - pe.n / (pe.n + 50.0)) * gm.g, gm.g) AS model_encoded,
   CASE WHEN type IN (SELECT tt_type FROM tt) THEN type ELSE 'other' END AS type_clean
 FROM kept k CROSS JOIN gm LEFT JOIN me ON me_m = k.manufacturer
 LEFT JOIN pe ON pe_m = k.manufacturer AND pe_model = k.model),
act AS (SELECT *, 'fuel_' || fuel || ',trans_' || transmission || ',drive_' || drive || ',type_' || type_clean
   AS one_hot_active FROM feat)
"""
    n_feat = ("8 + (SELECT count(DISTINCT fuel) + count(DISTINCT transmission) + count(DISTINCT drive) "
              "+ count(DISTINCT type_clean) FROM feat)")
    return {
        "age_features": feats + "SELECT listing_id, CAST(age AS DOUBLE) AS age, miles_per_year FROM feat",
        "ordinal_features": feats + "SELECT listing_id, cylinders_num, condition_ord, clean_title FROM feat",
        "encoded_listings": feats + "SELECT listing_id, manufacturer_encoded, model_encoded FROM feat",
        "type_bucketed": feats + "SELECT listing_id, type, type_clean FROM feat",
        "split_counts": base + f"SELECT {SPLIT} AS split, count(*) AS n FROM kept GROUP BY 1",
        "held_out_rows": base + f"SELECT listing_id, price, true AS predicted FROM kept WHERE {SPLIT} = 'test'",
        "spot_check_rows": base + f"""SELECT listing_id, price AS actual, true AS predicted FROM kept WHERE {SPLIT} = 'test'
ORDER BY md5('1:' || listing_id::VARCHAR), listing_id LIMIT 10""",
        "one_hot": feats + "SELECT listing_id, one_hot_active, CAST(4 AS BIGINT) AS one_hot_sum FROM act",
        "feature_matrix": feats + f"""
SELECT listing_id, odometer, CAST(age AS DOUBLE) AS age, miles_per_year, CAST(cylinders_num AS DOUBLE) AS cylinders_num,
  CAST(condition_ord AS DOUBLE) AS condition_ord, CAST(clean_title AS DOUBLE) AS clean_title,
  manufacturer_encoded, model_encoded, one_hot_active, CAST({n_feat} AS BIGINT) AS n_features FROM act""",
        "regression_metrics": feats + """
SELECT count(*) AS n, avg(abs(price - model_encoded)) AS mae,
  1 - sum((price - model_encoded) * (price - model_encoded)) / (var_pop(price) * count(*)) AS r2 FROM feat""",
    }
