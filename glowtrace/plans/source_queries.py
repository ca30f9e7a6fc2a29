"""Metadata: settings, attribute maps, names and dates, planes."""

from pyspark.sql import functions as F

from glowtrace.plans.catalogue import query, r8
from glowtrace.sources import recording as rec
from glowtrace.sources import tables as src


def attributes(spark, sf):
    """Events as frames of a recording a type: their columns are attributes, their JSON's key is a setting."""
    rows = src.table(spark, sf, "events")
    attrs = F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    return rows.select(F.col("event_type").alias("rec_id"), F.lit("frame").alias("kind"), F.lit(0).alias("sequence"), F.col("event_id").cast("int").alias("frame"), attrs.alias("attrs"))


@query("typed_settings", f"SELECT event_id, CASE WHEN regexp_full_match(k, '[0-9]+') THEN CAST(k AS BIGINT) END AS as_long, CASE WHEN NOT regexp_full_match(k, '[0-9]+') THEN TRY_CAST(k AS DOUBLE) END AS as_double, CASE WHEN TRY_CAST(k AS DOUBLE) IS NULL THEN k END AS as_text FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN json_extract_string(props, '$.k') WHEN 1 THEN event_type ELSE json_extract_string(props, '$.k') || '.5' END AS k FROM events)")
def typed_settings(spark, sf):
    k = F.get_json_object("props", "$.k")
    value = F.when(F.col("event_id") % 3 == 0, k).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.concat(k, F.lit(".5")))
    return src.table(spark, sf, "events").withColumn("k", value).select("event_id", *rec.typed("k"))


@query("constant_attributes", "SELECT event_type AS source, 'type' AS key, event_type AS value FROM events GROUP BY 1")
def constant_attributes(spark, sf):
    return rec.settings(attributes(spark, sf)).where("key in ('type', 'user', 'value')").select(F.col("rec_id").alias("source"), "key", "value")


@query("attribute_counts", "SELECT event_type AS source, unnest(['k', 'type', 'user', 'value']) AS key, count(*) AS n FROM events GROUP BY 1, 2")
def attribute_counts(spark, sf):
    return rec.long_attributes(attributes(spark, sf)).groupBy(F.col("rec_id").alias("source"), "key").agg(F.count("*").alias("n"))


@query("merged_attributes", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'later' ELSE event_type END AS type, CAST(user_id AS VARCHAR) AS user_vin FROM events")
def merged_attributes(spark, sf):
    """Maps merged, later keys first asked; all keys of one suffixed."""
    rows = src.table(spark, sf, "events")
    first = F.create_map(F.lit("type"), F.col("event_type"))
    later = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("type"), F.lit("later"))).otherwise(F.create_map().cast("map<string,string>"))
    suffixed = F.transform_keys(F.create_map(F.lit("user"), F.col("user_id").cast("string")), lambda k, _: F.concat(k, F.lit("Vin")))
    return rows.select("event_id", F.coalesce(F.try_element_at(later, F.lit("type")), F.try_element_at(first, F.lit("type"))).alias("type"), F.try_element_at(suffixed, F.lit("userVin")).alias("user_vin"))


@query("folder_names", "SELECT event_id, 'TSeries-' || strftime(ts - to_days(CAST(b AS INTEGER)), '%m%d%Y') || '-????-' || CASE WHEN length(CAST(event_id AS VARCHAR)) >= 3 THEN CAST(event_id AS VARCHAR) ELSE lpad(CAST(event_id AS VARCHAR), 3, '0') END AS name FROM events, (SELECT unnest(generate_series(0, 2)) AS b)")
def folder_names(spark, sf):
    number = F.col("event_id").cast("string")
    filled = F.when(F.length(number) >= 3, number).otherwise(F.lpad(number, 3, "0"))
    rows = src.table(spark, sf, "events").withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(2))))
    day = F.date_format(F.date_sub(F.to_date("ts"), F.col("back")), "MMddyyyy")
    return rows.select("event_id", F.concat(F.lit("TSeries-"), day, F.lit("-????-"), filled).alias("name"))


@query("path_parts", "SELECT page_id, string_split(url, '/')[-1] AS name, list_aggregate(string_split(url, '/')[1:-2], 'string_agg', '/') AS folder FROM pages")
def path_parts(spark, sf):
    parts = F.split("url", "/")
    return src.table(spark, sf, "pages").select("page_id", F.element_at(parts, -1).alias("name"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("folder"))


@query("volume_planes", f"SELECT label AS plane, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t_idx, vec_id, {r8('vec_id * 0.1', 'ts')} FROM embeddings")
def volume_planes(spark, sf):
    """Frames of several planes, told apart by an attribute and numbered within each."""
    attrs = F.create_map(F.lit("index"), F.col("label").cast("string"), F.lit("absoluteTime"), (F.col("vec_id") * 0.1).cast("string"), F.lit("filename"), F.col("vec_id").cast("string"))
    meta = src.table(spark, sf, "embeddings").select(F.lit("r0").alias("rec_id"), F.lit("frame").alias("kind"), F.lit(0).alias("sequence"), F.col("vec_id").cast("int").alias("frame"), attrs.alias("attrs"))
    return rec.frame_table(meta).select("plane", "t_idx", F.col("filename").cast("long").alias("vec_id"), "ts")


@query("appended_sequences", "SELECT event_id, event_type, value, CAST(NULL AS BIGINT) AS user_id FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, event_type, NULL, user_id FROM events WHERE event_type <> 'view'")
def appended_sequences(spark, sf):
    rows = src.table(spark, sf, "events")
    return rows.where("event_type = 'view'").select("event_id", "event_type", "value").unionByName(rows.where("event_type <> 'view'").select("event_id", "event_type", "user_id"), allowMissingColumns=True)
