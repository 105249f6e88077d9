"""Queries that write tables in the formats of sources and sinks, read them back, and run streams over them.

What they write lies in the shared folder and is deleted when the driver ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.operators import learning, quality, relations
from tessitura.plans.warehouse import Asset, Warehouse, edges, reach
from tessitura.session import materialize, scratch
from tessitura.sources import artifacts, history, interactions, shapes, sinks, snapshots
from tessitura.streaming import events as streams
from tessitura.tables import table

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()
_schema = lambda **kinds: T.StructType([T.StructField(n, k) for n, k in kinds.items()])


def s3_history_files(spark: SparkSession, folder: str) -> DataFrame:
    """The history as export files, each a JSON array of some thousand records, read and put in the bronze form."""
    rows = table(spark, folder, "streaming_history").select(
        F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), "platform", "ms_played", "skipped", F.col("shuffle"), F.col("track_uri").alias("svc_track_uri"), F.col("episode_uri").alias("svc_episode_uri"),
        F.col("event_id").cast("string").alias("audiobook_chapter_title"), F.when(F.col("event_id") % 101 == 0, F.concat(F.lit("book:"), "event_id")).alias("audiobook_uri"), F.lit("10.0.0.1").alias("ip_addr"),
    )
    parts = max(1, rows.count() // 5_000)
    path = scratch(spark, "exports")
    filed = rows.groupBy(F.pmod(F.xxhash64("audiobook_chapter_title"), F.lit(parts)).alias("f")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    filed.repartition(parts, "f").select("value").write.option("maxRecordsPerFile", 1).text(path)
    found = history.bronze_history(history.read_history(spark, [path], "svc"))
    return found.select(F.col("audiobook_chapter_title").cast("long").alias("event_id"), F.unix_micros("played_at").alias("us"), F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "content_type", F.col("skipped").cast("string").alias("skipped"), "ms_played")


def s5_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "csv")
    table(spark, folder, "supplier").select(F.col("s_acctbal").cast("string").alias("s_acctbal"), "s_name", F.when(F.col("s_suppkey") % 10 == 0, "oops").otherwise(F.col("s_suppkey").cast("string")).alias("s_suppkey"), F.lit("x").alias("extra")).write.option("header", True).csv(path)
    return artifacts.read_csv(spark, path, _schema(s_suppkey=_L, s_name=_S, s_acctbal=_D, missing=_S)).drop("missing")


def s14_interactions(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "plays")
    table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string"), F.concat(F.lit("s"), "l_partkey"), F.when(F.col("l_linenumber") == 3, "many").otherwise(F.col("l_quantity").cast("string"))).write.option("sep", "\t").csv(path)
    found = interactions.read_interactions(spark, path, interactions.TASTE_PROFILE)
    return found.groupBy("source_dataset", "event_type", "item_id").agg(F.count(F.lit(1)).alias("n"), F.count("interaction_value").alias("known"), F.coalesce(F.sum("interaction_value"), F.lit(0.0)).alias("plays"))


def s14_checks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.lit("d").alias("source_dataset"), F.when(F.col("l_linenumber") < 6, F.col("l_partkey").cast("string")).otherwise(" ").alias("item_id"), (F.col("l_discount") * 12).alias("propensity"), (F.col("l_quantity") - 3).alias("dwell_ms"))
    return interactions.check_interactions(shapes.align(rows, interactions.INTERACTIONS))


def s16_two_row_header(spark: SparkSession, folder: str) -> DataFrame:
    """Names made of the schema's prefix and name of a table's columns."""
    columns = table(spark, folder, "lineitem").columns
    first = ["line" if i % 3 == 0 else "" for i, _ in enumerate(columns)]
    names = shapes.two_row_header(first, [c.split("_")[1] for c in columns])
    return spark.createDataFrame(list(enumerate(names)), "i long, name string")


def k3_partitioned(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "partitioned")
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    sinks.write_partitioned(rows, path, ["year", "month"])
    return spark.read.parquet(path).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def k5_k10_append(spark: SparkSession, folder: str) -> DataFrame:
    """Texts brought to a schema and appended twice."""
    path = scratch(spark, "appended")
    rows = table(spark, folder, "customer").select(F.when(F.col("c_custkey") % 5 == 0, "none").otherwise(F.col("c_custkey").cast("string")).alias("key"), F.when(F.col("c_acctbal") > 0, "Yes").when(F.col("c_acctbal") < -500, "no").otherwise("perhaps").alias("paid"), F.col("c_nationkey").cast("string").alias("nation"))
    for _ in range(2):
        sinks.append(rows, path, _schema(key=_L, paid=T.BooleanType(), nation=_D, extra=_S))
    return spark.read.parquet(path).groupBy("paid", "nation").agg(F.count(F.lit(1)).alias("n"), F.count("key").alias("keys"), F.count("extra").alias("extras"))


def k7_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every table of an export, as counted after it was written."""
    tables = {n: table(spark, folder, n) for n in ("nation", "orders", "supplier")}
    report = sinks.export_tables(scratch(spark, "bundle"), tables, {n: d.schema for n, d in tables.items()}, {"orders": ["o_orderstatus"]})
    return spark.createDataFrame(sorted(report.items()), "name string, n long")


def k6_ddl(spark: SparkSession, folder: str) -> DataFrame:
    text = sinks.ddl("supplier", table(spark, folder, "supplier").schema, "s3://bucket/prefix/supplier", ["s_nationkey"])
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.splitlines())], "i long, line string")


def _assets(spark: SparkSession, folder: str) -> list[Asset]:
    return [
        Asset("orders", "bronze", [], lambda _: table(spark, folder, "orders")),
        Asset("customers", "bronze", [], lambda _: table(spark, folder, "customer")),
        Asset("spending", "silver", ["orders", "customers"], lambda t: t["orders"].join(t["customers"], F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "o_orderpriority").agg(F.sum("o_totalprice").alias("total"))),
        Asset("best", "gold", ["spending"], lambda t: relations.top_one(t["spending"], ["c_nationkey"], F.desc("total"), F.asc("o_orderpriority"))),
    ]


def k1_warehouse(spark: SparkSession, folder: str) -> DataFrame:
    """What a second refresh decides about every table, with its rows and all that lies below it."""
    w = Warehouse(scratch(spark, "warehouse"), _assets(spark, folder))
    w.refresh(spark)
    done = w.refresh(spark)["assets"]
    wrong = w.verify(spark)
    return spark.createDataFrame([(n, x["layer"], x["rows"], x["decision"], x["reason"], ",".join(x["downstream"]), len(wrong.get(n, []))) for n, x in done.items()], "name string, layer string, n long, decision string, reason string, downstream string, wrong long")


def a42_edges(spark: SparkSession, folder: str) -> DataFrame:
    assets = _assets(spark, folder)
    return spark.createDataFrame([(a, b, ",".join(reach(assets, b, False))) for a, b in edges(assets)], "source string, target string, upstream string")


def a40_content_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a table and the same rows in another order have one hash, and those without one row another."""
    o = table(spark, folder, "orders")
    a, b, c = (quality.content_hash(d).first() for d in (o, o.repartition(7, "o_custkey").sortWithinPartitions("o_totalprice"), o.where("o_orderkey > 1")))
    return spark.createDataFrame([(a["rows"], a == b, a != c)], "n long, same boolean, differs boolean")


def a43_blocked(spark: SparkSession, folder: str) -> DataFrame:
    return quality.blocked_content(table(spark, folder, "customer"), "^c_acct", "(?i)machine|0000000[1-5]$").withColumnRenamed("rows", "n")


def a46_findings(spark: SparkSession, folder: str) -> DataFrame:
    n = {t: table(spark, folder, t).count() for t in ("orders", "customer")} | {"empty": 0, "void": 0}
    found = quality.row_count_findings(n, {"orders": 0, "empty": 5, "customer": 1}, {"void": ["orders"]})
    return spark.createDataFrame(found, "name string, finding string")


def p21_violations(spark: SparkSession, folder: str) -> DataFrame:
    return quality.violations(table(spark, folder, "streaming_history"), {"time": "ts is not null", "duration": "ms_played between 0 and 86400000", "user": "user_id is not null"})


def p23_rest_as_json(spark: SparkSession, folder: str) -> DataFrame:
    return shapes.rest_as_json(table(spark, folder, "nation"), ["n_nationkey"], "rest").select("n_nationkey", F.get_json_object("rest", "$.n_name").alias("name"), F.get_json_object("rest", "$.n_regionkey").alias("region"), F.size(F.json_object_keys("rest")).alias("fields"))


def maps_sorted(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of event types per user as a map, written as sorted text, with a SHA-256 of it."""
    n = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return per.select("user_id", F.size("m").alias("kinds"), text.alias("counts")).withColumn("digest", F.sha2("counts", 256))


def u5_inbox(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with orders that are new in each of three parts of the orders, one part after the other."""
    path, found = scratch(spark, "state"), None
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    for part in range(3):
        new = relations.inbox(orders.where(F.col("o_orderkey") % 3 == part).select("o_custkey").distinct(), "o_custkey", path).withColumn("part", F.lit(part))
        found = new if found is None else found.unionByName(new)
    return found


def k11_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Ranking rows with their arrays, written and read back."""
    path = scratch(spark, "arrays")
    learning.save_arrays(table(spark, folder, "track_reranking_split").select("query_id", "candidate_item_ids", "labels"), path)
    a = spark.read.parquet(path).select("query_id", F.coalesce(F.size("candidate_item_ids"), F.lit(-1)).alias("n"), F.aggregate(F.coalesce("labels", F.array()), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0))).alias("targets"))
    return a.groupBy(F.greatest("n", F.lit(0)).alias("n"), "targets").agg(F.count(F.lit(1)).alias("queries"))


def s7_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Run manifests as documents, read and flattened: made of customers."""
    c = table(spark, folder, "customer")
    gate = F.struct(F.expr("case when c_acctbal > 0 then 'pass' else 'fail' end").alias("status"), (F.col("c_acctbal") > 5000).alias("promoted"), (F.col("c_acctbal") / 10_000).alias("champion_score"))
    whole = F.struct(F.concat(F.lit("run-"), "c_custkey").alias("run_id"), F.col("c_mktsegment").alias("profile"), F.lit("2026-01-02T03:04:05").alias("timestamp"), (F.col("c_custkey") * 10).alias("data_records"), F.array(F.lit("a"), F.lit("b")).alias("deep_models"), gate.alias("champion_gate"))
    documents = c.select(F.concat(F.lit("runs/"), "c_custkey").alias("path"), F.when(F.col("c_custkey") % 50 > 0, F.to_json(whole)).otherwise("{}").alias("text"))
    found = snapshots.run_manifests(documents).where("run_id is not null")
    return found.select("run_id", "profile", F.date_format("run_timestamp", "yyyy").alias("year"), "data_records", "deep_models_json", "champion_gate_status", "champion_gate_promoted", F.round("champion_gate_champion_score", 9).alias("score"))


def s11_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Review actions of documents, one for every nation with its suppliers as actions."""
    n = table(spark, folder, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("s_name").alias("title"), F.when(F.col("s_acctbal") > 5000, "high").otherwise("low").alias("priority"), F.array(F.lit(" a "), F.lit(""), F.lit("b")).alias("inspect")))).alias("review_actions"))
    whole = F.struct(F.col("s_nationkey").cast("string").alias("generated_at"), F.struct(F.struct(F.lit("r1").alias("run_id")).alias("selected_run")).alias("run_selection"), "review_actions")
    return snapshots.review_actions(n.select(F.lit("x").alias("path"), F.to_json(whole).alias("text"))).select("generated_at", "selected_run_id", F.col("action_order").cast("long").alias("action_order"), "priority", "title", "inspect_targets")


def a9_status(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "orders").selectExpr("concat('r', o_orderkey) run_id", "o_orderpriority profile", "cast(o_orderdate as string) timestamp")
    benchmarks = table(spark, folder, "part").selectExpr("concat('b', p_partkey) benchmark_id", "case when p_size > 25 then 'yes' else 'no' end comparison_ready", "case when p_partkey % 4 = 0 then 'n/a' else cast(p_retailprice as string) end benchmark_strength_score")
    claims = table(spark, folder, "customer").selectExpr("case when c_acctbal < 0 then 'true' when c_acctbal < 100 then null else 'false' end blocked", "case when c_custkey % 2 = 0 then '1' else '0' end benchmark_comparison_ready", "case when c_custkey % 3 = 0 then ' Live' else 'none' end live_signal_status", "case when c_custkey % 5 = 0 then 'Ready' else 'open' end claim_readiness_status")
    found = snapshots.platform_status(runs, benchmarks, claims)
    return found.withColumn("strongest_benchmark_score", F.round("strongest_benchmark_score", 4))


def a10_branches(spark: SparkSession, folder: str) -> DataFrame:
    scores = table(spark, folder, "nation").selectExpr("n_nationkey branch_key", "case when n_regionkey = 1 then 'n/a' else cast(n_nationkey / 4 as string) end risk_score")
    queue = table(spark, folder, "supplier").selectExpr("s_nationkey branch_key", "cast(round(s_acctbal) as string) rank", "s_name initiative", "concat('run ', s_suppkey) command")
    cards = table(spark, folder, "customer").where("c_acctbal > 9000").selectExpr("c_nationkey branch_key", "c_name development_mode")
    return snapshots.branch_health(scores, queue, cards)


def _stream(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A stream over the files of a table, several a batch."""
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(materialize(df.repartition(spark.sparkContext.defaultParallelism), name)._tessitura_path)


def _run(stream: DataFrame, mode: str, each) -> None:
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(stream.sparkSession, "stream")).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def x4_counters(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.concat(F.lit("k"), F.col("user_id") % 50).alias("artist_key"), F.when(F.col("event_type") == "view", "like").when(F.col("event_type") == "click", "skip").otherwise("repeat").alias("signal"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    path = scratch(spark, "counters")
    _run(streams.feedback_counters(_stream(spark, e, "signals")), "complete", lambda df, n: df.write.mode("overwrite").parquet(path))
    return spark.read.parquet(path)


def x6_upserts(spark: SparkSession, folder: str) -> DataFrame:
    """The latest event of each user, kept by a stream."""
    e = table(spark, folder, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type", F.round("value", 4).alias("value"))
    path = scratch(spark, "upserts")
    _run(_stream(spark, e, "latest"), "append", streams.upsert_batches(["user_id"], "at", path, buckets=8))
    return streams.upserted(spark, path).select("user_id", F.col("at.event_id").alias("event_id"), "event_type", "value")


def x2_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Events with versions from their order, each sent twice: by user, how many were applied and how many were replayed."""
    e = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").cast("string").alias("event_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("expected_version"), F.col("event_type").alias("payload"))
    once = materialize(e, "versions")
    stream = spark.readStream.schema(e.schema).parquet(materialize(once.unionByName(once), "twice")._tessitura_path)
    path = scratch(spark, "outcomes")
    _run(streams.apply_versions(stream), "append", lambda df, n: df.write.mode("append").parquet(path))
    found = spark.read.parquet(path)
    return found.groupBy("session_id").agg(F.count_if(F.col("outcome") == "applied").alias("applied"), F.count_if(F.col("outcome") == "replayed").alias("replayed"), F.max("version").alias("version"))


QUERIES = {
    f.__name__: f
    for f in (
        s3_history_files, s5_csv, s14_interactions, s14_checks, s16_two_row_header, k3_partitioned, k5_k10_append, k7_bundle, k6_ddl, k1_warehouse, a42_edges, a40_content_hash, a43_blocked, a46_findings, x4_counters, x6_upserts, x2_versions, u5_inbox, k11_arrays, s7_manifests, s11_actions, a9_status, a10_branches,
    )
} | {"violations": p21_violations, "rest_as_json": p23_rest_as_json, "maps_sorted": maps_sorted}

ORACLE = {
    "s3_history_files": """SELECT event_id, epoch_us(ts) AS us, year(ts AT TIME ZONE 'UTC') AS year, month(ts AT TIME ZONE 'UTC') AS month, CASE WHEN event_id % 101 = 0 THEN 'audiobook' WHEN trim(coalesce(episode_uri, '')) <> '' THEN 'episode' WHEN trim(coalesce(track_uri, '')) <> '' THEN 'track' ELSE 'unknown' END AS content_type,
  CASE WHEN lower(trim(skipped)) IN ('true', '1', 'yes', 'y') THEN 'true' WHEN lower(trim(skipped)) IN ('false', '0', 'no', 'n') THEN 'false' END AS skipped, ms_played FROM streaming_history WHERE ts IS NOT NULL""",
    "s5_csv": "SELECT CASE WHEN s_suppkey % 10 > 0 THEN s_suppkey END AS s_suppkey, s_name, s_acctbal FROM supplier",
    "s14_interactions": "SELECT 'taste_profile' AS source_dataset, 'play_count' AS event_type, 's' || l_partkey AS item_id, count(*) AS n, count(*) FILTER (l_linenumber <> 3) AS known, coalesce(sum(l_quantity) FILTER (l_linenumber <> 3), 0) AS plays FROM lineitem GROUP BY 3",
    "s14_checks": "SELECT 'source_dataset' AS \"constraint\", 0 AS violations UNION ALL SELECT 'item_id', count(*) FILTER (l_linenumber >= 6) FROM lineitem UNION ALL SELECT 'propensity', count(*) FILTER (NOT (l_discount * 12 > 0 AND l_discount * 12 <= 1)) FROM lineitem UNION ALL SELECT 'dwell_ms', count(*) FILTER (l_quantity < 3) FROM lineitem",
    "s16_two_row_header": "SELECT CAST(i AS BIGINT) AS i, 'line_' || n AS name FROM (VALUES (0, 'orderkey'), (1, 'partkey'), (2, 'suppkey'), (3, 'linenumber'), (4, 'quantity'), (5, 'extendedprice'), (6, 'discount'), (7, 'tax'), (8, 'returnflag'), (9, 'linestatus'), (10, 'shipdate')) v(i, n)",
    "k3_partitioned": "SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2",
    "k5_k10_append": "SELECT CASE WHEN c_acctbal > 0 THEN true WHEN c_acctbal < -500 THEN false END AS paid, c_nationkey::DOUBLE AS nation, 2 * count(*) AS n, 2 * count(*) FILTER (c_custkey % 5 > 0) AS keys, 0 AS extras FROM customer GROUP BY 1, 2",
    "k7_bundle": "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'supplier', count(*) FROM supplier",
    "k6_ddl": """SELECT CAST(i AS BIGINT) AS i, line FROM (VALUES (0, 'CREATE EXTERNAL TABLE IF NOT EXISTS `supplier` ('), (1, '  `s_suppkey` BIGINT,'), (2, '  `s_name` STRING,'), (3, '  `s_acctbal` DOUBLE'), (4, ')'), (5, 'PARTITIONED BY (`s_nationkey` INT)'), (6, 'STORED AS PARQUET'), (7, 'LOCATION ''s3://bucket/prefix/supplier'';'), (8, 'MSCK REPAIR TABLE `supplier`;')) v(i, line)""",
    "k1_warehouse": """WITH s AS (SELECT DISTINCT c_nationkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT 'orders' AS name, 'bronze' AS layer, count(*) AS n, 'best,spending' AS downstream FROM orders UNION ALL SELECT 'customers', 'bronze', count(*), 'best,spending' FROM customer
UNION ALL SELECT 'spending', 'silver', count(*), 'best' FROM s UNION ALL SELECT 'best', 'gold', count(DISTINCT c_nationkey), '' FROM s) SELECT *, 'reused' AS decision, 'content_unchanged' AS reason, 0 AS wrong FROM n""",
    "a42_edges": "SELECT * FROM (VALUES ('customers', 'spending', 'customers,orders'), ('orders', 'spending', 'customers,orders'), ('spending', 'best', 'customers,orders,spending')) v(source, target, upstream)",
    "a40_content_hash": "SELECT count(*) AS n, true AS same, true AS differs FROM orders",
    "a43_blocked": "SELECT 'c_name' AS \"column\", count(*) AS n FROM customer WHERE regexp_matches(c_name, '(?i)machine|0000000[1-5]$') HAVING count(*) > 0 UNION ALL SELECT 'c_mktsegment', count(*) FROM customer WHERE regexp_matches(c_mktsegment, '(?i)machine|0000000[1-5]$') HAVING count(*) > 0 UNION ALL SELECT 'c_acctbal', -1",
    "a46_findings": "SELECT * FROM (VALUES ('empty', 'dropped to zero'), ('orders', 'recovered'), ('void', 'empty below data')) v(name, finding)",
    "violations": "SELECT 'time' AS \"constraint\", count(*) FILTER (ts IS NULL) AS violations FROM streaming_history UNION ALL SELECT 'duration', count(*) FILTER (ms_played IS NULL OR ms_played < 0 OR ms_played > 86400000) FROM streaming_history UNION ALL SELECT 'user', count(*) FILTER (user_id IS NULL) FROM streaming_history",
    "rest_as_json": "SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, 2 AS fields FROM nation",
    "maps_sorted": "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT user_id, count(*) AS kinds, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM n GROUP BY 1) SELECT *, sha256(counts) AS digest FROM t",
    "x4_counters": """WITH e AS (SELECT 'k' || user_id % 50 AS artist_key, CASE WHEN event_type = 'view' THEN 'like' WHEN event_type = 'click' THEN 'skip' ELSE 'repeat' END AS signal, ts, event_id FROM events)
SELECT artist_key, count(*) FILTER (signal = 'like') AS likes, count(*) FILTER (signal = 'repeat') AS repeats, count(*) FILTER (signal = 'skip') AS skips, 0 AS dislikes, arg_max(signal, (ts, event_id)) AS last_signal FROM e GROUP BY 1""",
    "x6_upserts": "SELECT user_id, event_id, event_type, round(value, 4) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "u5_inbox": "SELECT o_custkey, min(o_orderkey % 3) AS part FROM orders GROUP BY 1",
    "k11_arrays": "SELECT greatest(coalesce(len(candidate_item_ids), -1), 0) AS n, CAST(coalesce(list_sum(labels), 0) AS BIGINT) AS targets, count(*) AS queries FROM track_reranking_split GROUP BY 1, 2",
    "s7_manifests": "SELECT 'run-' || c_custkey AS run_id, c_mktsegment AS profile, '2026' AS year, c_custkey * 10 AS data_records, '[\"a\",\"b\"]' AS deep_models_json, CASE WHEN c_acctbal > 0 THEN 'pass' ELSE 'fail' END AS champion_gate_status, c_acctbal > 5000 AS champion_gate_promoted, round(c_acctbal / 10000, 9) AS score FROM customer WHERE c_custkey % 50 > 0",
    "s11_actions": "SELECT CAST(s_nationkey AS VARCHAR) AS generated_at, 'r1' AS selected_run_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS action_order, CASE WHEN s_acctbal > 5000 THEN 'high' ELSE 'low' END AS priority, s_name AS title, 'a|b' AS inspect_targets FROM supplier",
    "a9_status": """WITH l AS (SELECT 'r' || o_orderkey AS anchor_run_id, o_orderpriority AS anchor_profile FROM orders ORDER BY o_orderdate DESC, 'r' || o_orderkey DESC LIMIT 1), s AS (SELECT 'b' || p_partkey AS strongest_benchmark_id, round(p_retailprice, 4) AS strongest_benchmark_score FROM part WHERE p_partkey % 4 > 0 ORDER BY p_retailprice DESC, 'b' || p_partkey LIMIT 1),
c AS (SELECT count(*) AS claim_total_count, count(*) FILTER (c_acctbal < 0) AS claim_blocked_count, count(*) FILTER (c_custkey % 5 = 0) AS claim_ready_count, count(*) FILTER (c_acctbal < 0 AND c_custkey % 3 = 0) AS blocked_live_signal_count, count(*) FILTER (c_acctbal < 0 AND c_custkey % 2 = 1) AS blocked_benchmark_gap_count FROM customer)
SELECT l.*, c.*, (SELECT count(*) FROM part WHERE p_size > 25) AS comparison_ready_benchmark_count, s.* FROM l, c, s""",
    "a10_branches": """WITH q AS (SELECT s_nationkey AS branch_key, CAST(CAST(round(s_acctbal) AS BIGINT) AS VARCHAR) || '.0' AS queue_rank, s_name AS next_initiative, 'run ' || s_suppkey AS next_command FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY round(s_acctbal), s_name) = 1)
SELECT n_nationkey AS branch_key, CASE WHEN n_regionkey <> 1 THEN n_nationkey / 4.0::DOUBLE END AS risk_score, queue_rank, next_initiative, next_command, (SELECT min(c_name) FROM customer WHERE c_acctbal > 9000 AND c_nationkey = n_nationkey) AS development_mode FROM nation LEFT JOIN q ON q.branch_key = n_nationkey""",
    "x2_versions": "SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS applied, count(*) AS replayed, count(*) AS version FROM events GROUP BY 1",
}
