"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .control import Election, Peers, observed
from .envelope import COLUMNS, SCHEMA, from_events, serialize
from .functions import security
from .operators import ordered, stateless
from .plans import pipelines
from .sources import generators, sinks
from .state import SchemaCompatibility, StateStore, check_compatibility, latest_offsets
from .streaming import processors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ENVELOPE_SQL = """SELECT 'evt-' || event_id AS id, 'app' AS source_database, 'events' AS source_table_or_collection,
 CASE WHEN event_id % 4 = 3 THEN CASE WHEN (event_id // 4) % 10 = 0 THEN 'Rollback' ELSE 'Commit' END
      WHEN event_type = 'signup' THEN 'Create' WHEN event_type = 'error' THEN 'Delete' ELSE 'Update' END AS operation,
 ts AS "timestamp", json_object('user_id', user_id)::VARCHAR AS key, NULL::VARCHAR AS before,
 json_object('event_type', event_type, 'user_id', user_id, 'value', value)::VARCHAR AS after,
 'tx-' || (1000 + event_id // 4) AS transaction_id, event_id::VARCHAR AS "offset", event_id AS seq FROM events"""
COMMITTED_SQL = """SELECT * FROM (SELECT *, first_value(CASE WHEN operation IN ('Commit','Rollback') THEN operation END IGNORE NULLS)
   OVER w AS terminator, first_value(CASE WHEN operation IN ('Commit','Rollback') THEN seq END IGNORE NULLS) OVER w AS terminator_seq FROM e
   WINDOW w AS (PARTITION BY source_database, transaction_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 WHERE operation NOT IN ('Commit','Rollback')"""
BUCKET_SQL = "('0x' || substr(md5({0}), 1, 8))::BIGINT % {1}"


def events(spark: SparkSession, d: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{d}/events.parquet"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f'SELECT id, operation, "timestamp", key, after, transaction_id, "offset", seq FROM ({ENVELOPE_SQL})')
def cdc_envelope(spark, d):
    return events(spark, d).select("id", "operation", "timestamp", "key", "after", "transaction_id", "offset", "seq")


@query(f"SELECT id, '{{\"user_id\":' || user_id || '}}' AS key_json, true AS has_null_before FROM (SELECT 'evt-' || event_id AS id, user_id FROM events)")
def cdc_serialize_json(spark, d):
    v = F.try_parse_json("json")
    return serialize(events(spark, d)).select(F.try_variant_get(v, "$.id", "string").alias("id"), F.to_json(F.try_variant_get(v, "$.key", "variant")).alias("key_json"), F.contains("json", F.lit('"before":null')).alias("has_null_before"))


_AT = "2024-01-01 00:00:00"


@query("""SELECT 'pg-evt-' || n AS id, CASE WHEN n % 4 = 0 THEN 'Commit' WHEN n % 4 = 1 THEN 'Create' ELSE 'Update' END AS operation,
 CASE WHEN n % 4 <> 0 THEN '{"id":' || n || ',"name":"User ' || n || '","email":"user' || n || '@example.com"}' END AS after,
 'tx-' || ((n - 1) // 4 + 1000) AS transaction_id, n AS seq FROM range(1, 2001) t(n)""")
def pg_source_replay(spark, d):
    return generators.transactional(generators.numbers(spark, None, 2000), F.lit(_AT)).select("id", "operation", "after", "transaction_id", "seq")


@query("SELECT 'cas-evt-' || n AS id, 'sensor-' || (n % 10) AS sensor, round(20 + n * 0.1::DOUBLE, 3) AS reading, n AS seq FROM range(1, 2001) t(n)")
def cassandra_source_replay(spark, d):
    v = F.try_parse_json("after")
    return generators.commit_log(generators.numbers(spark, None, 2000), F.lit(_AT)).select("id", F.try_variant_get(v, "$.sensor_id", "string").alias("sensor"), F.try_variant_get(v, "$.reading_value", "double").alias("reading"), "seq")


@query("SELECT seq, coalesce(TRY_CAST(o AS BIGINT), 0) AS position FROM (SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'offset-' || event_id ELSE event_id::VARCHAR END AS o FROM events)")
def resume_from_offset(spark, d):
    e = events(spark, d)
    o = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("offset-"), F.col("offset"))).otherwise(F.col("offset"))
    return e.select("seq", generators.resume_position(o).alias("position"))


def repeated(spark, d, gap: int = 25):
    e = events(spark, d).withColumn("seq", F.col("seq") * 10)
    return e.unionByName(e.where((F.col("seq") / 10) % 7 == 0).withColumn("seq", F.col("seq") + gap))


@query("SELECT 'evt-' || event_id AS id, event_id * 10 AS seq FROM events")
def dedup_keep_first(spark, d):
    return ordered.dedup_keep_first(repeated(spark, d)).select("id", "seq")


@query("SELECT 'evt-' || event_id AS id, event_id * 10 AS seq FROM events UNION ALL SELECT 'evt-' || event_id, event_id * 10 + 1055 FROM events WHERE event_id % 7 = 0 AND event_id < (SELECT count(*) FROM events) - 200")
def dedup_fifo_exact(spark, d):
    """Repeats come 105 or more events after an id, beyond a capacity of 100, so all are accepted again."""
    e = events(spark, d)
    rows = repeated(spark, d, 1055).where(F.col("seq") < (e.count() - 200) * 10 + 1055)
    tail = e.where(F.col("seq") * 10 >= (e.count() - 200) * 10 + 1055).withColumn("seq", F.col("seq") * 10)
    return ordered.dedup_fifo(rows.unionByName(tail).select("id", "source_database", "seq"), 100).select("id", "seq")


def fifo_rows(spark, d):
    """Repeats of every seventh id: some within three events of it, which a capacity of 100 drops, and some 105 or more events later, each with one soon after."""
    e = events(spark, d).withColumn("seq", F.col("seq") * 10)
    sevenths = e.where((F.col("seq") / 10) % 7 == 0)
    far = sevenths.where(F.col("seq") < (e.count() - 200) * 10)
    for rows, gap in ((sevenths, 25), (far, 1055), (far, 1083)):
        e = e.unionByName(rows.withColumn("seq", F.col("seq") + gap))
    return e


@query("SELECT 'evt-' || event_id AS id, event_id * 10 AS seq FROM events UNION ALL SELECT 'evt-' || event_id, event_id * 10 + 1055 FROM events WHERE event_id % 7 = 0 AND event_id < (SELECT count(*) FROM events) - 200")
def dedup_fifo_mixed(spark, d):
    """Repeats inside a capacity of 100 are dropped, those beyond it are accepted again."""
    return ordered.dedup_fifo(fifo_rows(spark, d).select("id", "source_database", "seq"), 100).select("id", "seq")


FIELDS = {"fields": {"event_type": "string", "user_id": "integer", "value": "float"}}
_BAD = """SELECT event_id AS seq, 'Update' AS operation, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '[1]'
 WHEN event_id % 11 = 0 THEN '{"event_type":"' || event_type || '","user_id":' || user_id || '}'
 WHEN event_id % 13 = 0 THEN '{"event_type":"' || event_type || '","user_id":"x","value":1.5}'
 ELSE '{"event_type":"' || event_type || '","user_id":' || user_id || '.0,"value":1e3}' END AS after FROM events"""
_REASON = """CASE WHEN after IS NULL THEN 'Validation failed: Event payload ''after'' is missing' WHEN after = '[1]' THEN 'Validation failed: Event payload is not a JSON object'
 WHEN json_type(after, '$.value') IS NULL THEN 'Validation failed: Missing required field ''value'''
 WHEN json_type(after, '$.user_id') = 'VARCHAR' THEN 'Validation failed: Field ''user_id'' expected integer, found "x"' END"""


def _payloads(spark, d):
    spark.read.parquet(f"{d}/events.parquet").createOrReplaceTempView("rillforge_events")
    return stateless.validate(spark.sql(_BAD.replace("FROM events", "FROM rillforge_events")), FIELDS)


@query(f"SELECT seq FROM ({_BAD}) WHERE {_REASON} IS NULL")
def schema_validate_ok(spark, d):
    return stateless.split(_payloads(spark, d))[0].select("seq")


@query(f"SELECT seq, {_REASON} AS error_reason FROM ({_BAD}) WHERE {_REASON} IS NOT NULL")
def schema_validate_dlq(spark, d):
    return stateless.split(_payloads(spark, d))[1].select("seq", "error_reason")


@query(f"SELECT 'SchemaValidation' AS failed_step, count(*) AS n, 1 AS retries FROM ({_BAD}) WHERE {_REASON} IS NOT NULL")
def dlq_counts_by_step(spark, d):
    bad = _payloads(spark, d).where("error_reason is not null")
    full = events(spark, d).drop("after", "operation").join(bad, "seq")
    letters = sinks.dead_letters(full, F.col("error_reason"), "SchemaValidation")
    return letters.groupBy("failed_step").agg(F.count("*").alias("n"), F.max("retry_attempts").alias("retries"))


@query("SELECT * FROM (VALUES ('None','add',true),('None','delete',true),('None','type',true),('None','same',true),('Backward','add',true),('Backward','delete',false),('Backward','type',false),('Backward','same',true),('Forward','add',false),('Forward','delete',true),('Forward','type',false),('Forward','same',true),('Full','add',false),('Full','delete',false),('Full','type',false),('Full','same',true)) t(mode, change, ok)")
def schema_compat_matrix(spark, d):
    old = {"fields": {"id": "integer", "name": "string"}}
    new = {"add": old["fields"] | {"email": "string"}, "delete": {"id": "integer"}, "type": {"id": "string", "name": "string"}, "same": old["fields"]}
    return spark.createDataFrame([(m.value, c, check_compatibility(old, {"fields": f}, m) is None) for m in SchemaCompatibility for c, f in new.items()], "mode string, change string, ok boolean")


_N = "(SELECT count(*) FROM orders)"


def _log(spark, d):
    """Orders as a log on customers, with two pairs of marker rows."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    op = F.when(F.col("o_orderstatus") == "F", "Delete").when(F.col("o_orderstatus") == "O", "Update").otherwise("Create")
    log = o.select(F.lit("db").alias("source_database"), F.lit("customer").alias("source_table_or_collection"), op.alias("operation"), F.col("o_orderdate").alias("timestamp"), F.col("o_custkey").cast("string").alias("key"), F.col("o_totalprice").cast("string").alias("after"), (F.col("o_orderkey") * 2).alias("seq"))
    marks = spark.createDataFrame([("db", stateless.MARKER_TABLE, op, s) for op, s in (("Create", 4001), ("Update", 4501), ("Commit", 5001), ("Commit", 7001), ("Create", 7301))], "source_database string, source_table_or_collection string, operation string, seq long")
    return log.unionByName(marks, allowMissingColumns=True)


@query("SELECT o_orderkey * 2 AS seq, o_custkey::VARCHAR AS key FROM orders")
def watermark_forwarded(spark, d):
    return stateless.drop_markers(_log(spark, d)).select("seq", "key")


@query("""WITH inside AS (SELECT o_custkey AS k, o_orderstatus AS s, o_totalprice AS p, o_orderkey * 2 AS seq FROM orders
  WHERE (o_orderkey * 2 > 4001 AND o_orderkey * 2 < 5001) OR (o_orderkey * 2 > 7001 AND o_orderkey * 2 < 7301)),
 patch AS (SELECT k, bool_or(s = 'F') AS gone, arg_max(p, seq) FILTER (WHERE s <> 'F') AS price FROM inside GROUP BY k)
 SELECT c_custkey::VARCHAR AS key, coalesce(price, c_acctbal) AS value FROM customer LEFT JOIN patch ON k = c_custkey WHERE NOT coalesce(gone, false)""")
def watermark_reconciled_chunk(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_acctbal").cast("string").alias("after"), F.lit(None).cast("timestamp_ntz").alias("timestamp"))
    return ordered.reconcile(c, _log(spark, d)).select("key", F.col("after").cast("double").alias("value"))


@query(f"WITH e AS ({ENVELOPE_SQL}) SELECT id, seq, terminator_seq AS emit_seq FROM ({COMMITTED_SQL}) WHERE terminator = 'Commit'")
def tx_committed(spark, d):
    return ordered.tx_committed(events(spark, d)).select("id", "seq", "emit_seq")


@query(f"WITH e AS ({ENVELOPE_SQL}) SELECT id, seq FROM ({COMMITTED_SQL}) WHERE terminator = 'Rollback'")
def tx_rolled_back(spark, d):
    return ordered.tx_rolled_back(events(spark, d)).select("id", "seq")


@query(f"WITH e AS (SELECT * FROM ({ENVELOPE_SQL}) WHERE seq % 28 <> 3) SELECT id, seq FROM ({COMMITTED_SQL}) WHERE terminator IS NULL")
def tx_in_flight(spark, d):
    return ordered.tx_in_flight(events(spark, d).where("seq % 28 <> 3")).select("id", "seq")


@query(f"WITH e AS (SELECT * FROM ({ENVELOPE_SQL}) WHERE seq % 28 <> 3), f AS (SELECT * FROM ({COMMITTED_SQL}) WHERE terminator IS NULL) SELECT id FROM f WHERE (SELECT count(DISTINCT transaction_id) FROM f) <= 100000")
def tx_prune(spark, d):
    return ordered.tx_prune(events(spark, d).where("seq % 28 <> 3"), 100_000).select("id")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
 ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n FROM lineitem) WHERE n = 1""")
def lww_latest_per_key(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    order = [F.col("l_shipdate"), *(-F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))]
    return ordered.last_write_wins(rows, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


@query("""SELECT a.event_id AS a_id, CASE WHEN a.ts >= b.ts THEN a.event_id ELSE b.event_id END AS winner FROM events a JOIN events b ON b.event_id = a.event_id + 1""")
def lww_pairwise(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id"), F.struct("event_id", F.col("ts").alias("timestamp")).alias("e"))
    pair = e.select("event_id", F.col("e").alias("a")).join(e.select((F.col("event_id") - 1).alias("event_id"), F.col("e").alias("b")), "event_id")
    return pair.select(F.col("event_id").alias("a_id"), ordered.pairwise_winner(F.col("a"), F.col("b"))["event_id"].alias("winner"))


@query("SELECT event_id AS seq FROM events WHERE event_id % 5 NOT IN (0, 1)")
def loop_suppression(spark, d):
    lane = F.col("seq") % 5
    tx = F.when(lane == 0, "remote-us-east-1-tx").when(lane == 1, "remote-us-east-10-tx").when(lane == 2, F.lit(None)).otherwise("tx")
    return events(spark, d).withColumn("transaction_id", tx).where(stateless.should_forward("us-east-1")).select("seq")


@query(f"SELECT i::INT AS chunk_id, i * 2500 + 1 AS min_key, least((i + 1) * 2500, {_N}) AS max_key FROM range(0, ({_N} + 2499) // 2500) t(i)")
def snapshot_chunks(spark, d):
    return ordered.plan_chunks(spark, spark.read.parquet(f"{d}/orders.parquet").count(), 2500)


@query(f"SELECT (o_orderkey // 700)::INT AS chunk_id, count(*) AS n_rows, 'Completed' AS status FROM orders WHERE o_orderkey < {_N} GROUP BY 1, 3")
def snapshot_chunk_rows(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") + 1).alias("k"))
    return pipelines.snapshot(o, "k", o.count(), 700).select("chunk_id", "n_rows", "status")


@query(f"SELECT (({_N} + 2499) // 2500) || '/' || (({_N} + 2499) // 2500) AS progress")
def snapshot_progress(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") + 1).alias("k"))
    return ordered.progress(pipelines.snapshot(o, "k", o.count(), 2500))


@query(f"SELECT id, 'audits' AS source_table_or_collection, replace(after, 'user', 'account') AS after FROM (SELECT replace(id, 'user', 'account') AS id, after FROM ({ENVELOPE_SQL}))")
def smt_inline_replace(spark, d):
    e = events(spark, d).withColumn("source_table_or_collection", F.lit("users"))
    out = stateless.split(stateless.replace_text("user", "account")(e))[0]
    return out.withColumn("source_table_or_collection", F.replace("source_table_or_collection", F.lit("accounts"), F.lit("audits"))).select("id", "source_table_or_collection", "after")


@query("SELECT 'evt-' || event_id AS id FROM events")
def smt_passthrough(spark, d):
    return stateless.split(stateless.passthrough(65536)(events(spark, d)))[0].select("id")


@query("SELECT 'evt-' || event_id AS id, 'audit' AS source_table_or_collection FROM events WHERE event_id % 10 <> 0")
def smt_envelope_function(spark, d):
    def change(raw: bytes) -> bytes:
        if b'"offset":"' in raw and raw.split(b'"offset":"')[1].split(b'"')[0].endswith(b"0"):
            raise ValueError("poison")
        return raw.replace(b'"events"', b'"audit"')

    return stateless.split(stateless.envelope_function(change)(events(spark, d)))[0].select("id", "source_table_or_collection")


@query("SELECT c_custkey, '{\"c_acctbal\":\"[REDACTED]\",\"c_name\":\"' || c_name || '\"}' AS masked FROM customer")
def mask_redact(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.to_json(F.struct("c_name", "c_acctbal")).alias("j"))
    return c.select("c_custkey", security.mask(F.col("j"), {"c_acctbal": security.MaskingRule.REDACT, "absent": security.MaskingRule.HASH}).alias("masked"))


@query("""SELECT c_custkey, lower(lpad(to_hex(list_reduce(list_transform(range(1, length(c_name) + 1), lambda i: ascii(c_name[i])::HUGEINT),
 lambda h, b: (h * 33 + b) % 18446744073709551616::HUGEINT, 5381::HUGEINT)::UBIGINT), 16, '0')) AS hashed FROM customer""")
def mask_hash_djb2(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", security.djb2(F.col("c_name")).alias("hashed"))


@query("SELECT c_custkey, c_name AS plain, 'ENC:v2' AS prefix FROM customer")
def mask_encrypt_roundtrip(spark, d):
    keys = security.KeyStore(b"first test key")
    keys.rotate(b"second test key")
    c = security.encrypt_column(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_name").alias("plain")), "plain", keys)
    return security.decrypt_column(c.withColumn("prefix", F.substring("plain", 1, 6)), "plain", keys)


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'v1' ELSE 'v2' END AS version, c_name AS plain FROM customer")
def kms_rotation(spark, d):
    """Values under an old key stay readable after a rotation."""
    keys, c = security.KeyStore(b"first test key"), spark.read.parquet(f"{d}/customer.parquet")
    half = lambda r: c.where(f"c_custkey % 2 = {r}").select("c_custkey", F.col("c_name").alias("plain"))
    old = security.encrypt_column(half(0), "plain", keys)
    keys.rotate(b"second test key")
    both = old.unionByName(security.encrypt_column(half(1), "plain", keys)).withColumn("version", F.split("plain", ":")[1])
    return security.decrypt_column(both, "plain", keys)


@query(f"SELECT id, {BUCKET_SQL.format('key', 4)} AS partition FROM ({ENVELOPE_SQL})")
def route_key_hash(spark, d):
    return stateless.route(events(spark, d), 4).select("id", "partition")


@query(f"SELECT id, {BUCKET_SQL.format('id', 4)} AS partition FROM ({ENVELOPE_SQL})")
def route_event_id(spark, d):
    return stateless.route(events(spark, d), 4, stateless.PartitionStrategy.ROUND_ROBIN).select("id", "partition")


@query(f"SELECT event_id AS seq, {BUCKET_SQL.format('t', 8)} AS partition FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 't' || user_id ELSE 'app' END AS t FROM events)")
def route_tenant(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    user = F.col("user_id").cast("string")
    after = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"tenant_id":"t'), user, F.lit('"}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"tenant_id":'), user, F.lit("}"))).otherwise("{}")
    return stateless.route(from_events(e).drop("after").join(e.select(F.col("event_id").alias("seq"), after.alias("after")), "seq"), 8, stateless.PartitionStrategy.TENANT_PREFIX).select("seq", "partition")


@query("""WITH a AS (SELECT event_id AS seq, epoch(ts) AS t, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events),
 b AS (SELECT *, max(t - i * 300.0::DOUBLE) OVER (ORDER BY seq) AS d FROM a), c AS (SELECT *, lag(d) OVER (ORDER BY seq) + i * 300.0::DOUBLE - 4 * 300.0::DOUBLE AS e FROM b)
 SELECT seq, round(greatest(t, coalesce(e, t)), 2) AS admitted FROM c""")
def token_bucket_admission(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"))
    return ordered.admission(e, "t", 5, 1 / 300).select("seq", F.round("admitted", 2).alias("admitted"))


@query("SELECT 'app' AS source_database, arg_max(event_id::VARCHAR, event_id) AS \"offset\" FROM events")
def offset_checkpoint_latest(spark, d):
    return latest_offsets(events(spark, d))


@query(f"WITH e AS ({ENVELOPE_SQL}) SELECT id, terminator_seq AS emit_seq, {BUCKET_SQL.format('key', 4)} AS partition FROM ({COMMITTED_SQL}) WHERE terminator = 'Commit'")
def pipeline_transactional(spark, d):
    return pipelines.transactional(repeated_once(spark, d), pipelines.Config(FIELDS)).events.select("id", "emit_seq", "partition")


def repeated_once(spark, d):
    """Events with every seventh a second time, after its transaction."""
    e = events(spark, d)
    return e.unionByName(e.where("seq % 7 = 0").withColumn("seq", F.col("seq") + 1_000_000_000))


@query(f"SELECT id, seq AS emit_seq, {BUCKET_SQL.format('key', 4)} AS partition FROM ({ENVELOPE_SQL})")
def pipeline_nontransactional(spark, d):
    return pipelines.non_transactional(events(spark, d).withColumn("transaction_id", F.lit(None).cast("string")), pipelines.Config()).events.select("id", "emit_seq", "partition")


@query("SELECT count(*) + (SELECT count(*) FROM events WHERE event_id % 7 = 0) AS ingested, (SELECT count(*) FROM events WHERE event_id % 7 = 0) AS duplicates FROM events")
def metrics_summary(spark, d):
    return repeated_once(spark, d).groupBy("id").count().agg(F.sum("count").alias("ingested"), F.sum(F.col("count") - 1).alias("duplicates"))


_KEY = "key, {0} AS partition".format(BUCKET_SQL.format("key", 4))


@query(f"""WITH e AS ({ENVELOPE_SQL}) SELECT id, key, operation, partition FROM (SELECT id, operation, {_KEY}, row_number() OVER (PARTITION BY key ORDER BY "timestamp" DESC, seq) AS n FROM ({COMMITTED_SQL}) WHERE terminator = 'Commit') WHERE n = 1""")
def flagship(spark, d):
    """Committed events, the last write of each key, routed."""
    committed = ordered.tx_committed(events(spark, d))
    last = ordered.last_write_wins(committed, ["key"], [F.col("timestamp"), -F.col("seq")])
    return stateless.route(last, 4).select("id", "key", "operation", "partition")


def _folder(spark) -> str:
    """A new folder for what a query writes: in the shared folder of a cluster, or a temporary one where none is named."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{shared or tempfile.mkdtemp(prefix='rillforge-')}/query-{uuid.uuid4().hex}"


@query(f"SELECT {BUCKET_SQL.format('key', 4)} AS partition, count(*) AS n, count(DISTINCT key) AS keys FROM ({ENVELOPE_SQL}) GROUP BY 1")
def sink_topic_files(spark, d):
    """What a topic's folders hold, by partition."""
    path = _folder(spark)
    sinks.topic_files(stateless.route(events(spark, d), 4), path)
    return spark.read.parquet(path).groupBy(F.col("partition").cast("long").alias("partition")).agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@query("SELECT 'evt-' || event_id AS id, 'eu' AS cluster_id, true AS whole FROM events WHERE event_id % 3 <> 0")
def sink_forwarded(spark, d):
    """Envelopes for the one active peer, without those that came from it."""
    peers = Peers("us")
    for cluster, active in (("us", True), ("eu", True), ("ap", False)):
        peers.register(cluster, f"https://{cluster}.example.com", active)
    e = events(spark, d).withColumn("transaction_id", F.when(F.col("seq") % 3 == 0, F.lit("remote-eu-1")).otherwise(F.col("transaction_id")))
    (path,) = sinks.forward_to_peers(e, peers, _folder(spark))
    out = spark.read.schema("cluster_id string, id string, payload string, payload_bytes long").json(path)
    return out.select("id", "cluster_id", ((F.octet_length("payload") == F.col("payload_bytes")) & F.try_parse_json("payload").isNotNull()).alias("whole"))


@query("SELECT 'evt-' || event_id AS id, sink FROM events, (VALUES ('first'), ('second')) t(sink)")
def sink_fan_out(spark, d):
    """Every sink has the batch, once, though it is written twice."""
    path = _folder(spark)
    write = sinks.fan_out(sinks.batch_files(f"{path}/first"), sinks.batch_files(f"{path}/second", "json"))
    for _ in range(2):
        write(events(spark, d).select("id"), 7)
    return spark.read.parquet(f"{path}/first").select("id", F.lit("first").alias("sink")).unionByName(spark.read.schema("id string").json(f"{path}/second").select("id", F.lit("second").alias("sink")))


@query("SELECT l_orderkey::VARCHAR AS key, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n FROM lineitem) WHERE n = 1")
def load_chunk(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").cast("string").alias("key"), "l_partkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"))
    return ordered.load_chunk(li).select("key", "l_partkey")


def _streamed(spark, df):
    """``df`` as a stream of files."""
    path = _folder(spark)
    df.select(*COLUMNS).write.parquet(path)
    return spark.readStream.schema(SCHEMA).parquet(path)


def _drained(spark, stream, step, *options):
    """What a step of micro-batches writes of ``stream``."""
    path = _folder(spark)
    write = step(f"{path}/state", sinks.batch_files(f"{path}/out"), *options)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("SELECT o_orderkey * 2 AS seq, (o_orderkey * 2 > 4001 AND o_orderkey * 2 < 5001) OR (o_orderkey * 2 > 7001 AND o_orderkey * 2 < 7301) AS in_window FROM orders")
def watermark_window_flag(spark, d):
    """The stream's in_window flag of each event."""
    log = _log(spark, d).withColumns({c: F.lit(None).cast("string") for c in ("id", "before", "transaction_id", "offset")})
    return _drained(spark, _streamed(spark, log), processors.mark_windows).select("seq", "in_window")


@query("SELECT 'evt-' || event_id AS id, event_id * 10 AS seq FROM events UNION ALL SELECT 'evt-' || event_id, event_id * 10 + 1055 FROM events WHERE event_id % 7 = 0 AND event_id < (SELECT count(*) FROM events) - 200")
def stream_dedup_fifo(spark, d):
    """The stream's bounded dedup on the input of ``dedup_fifo_mixed``."""
    return _drained(spark, _streamed(spark, fifo_rows(spark, d)), processors.dedup, 100).select("id", "seq")


def _event_stream(spark, d):
    """The events table's files as a stream; a stream of files takes a folder or a pattern, which here is of one name."""
    found = spark.read.parquet(f"{d}/events.parquet").schema
    return from_events(spark.readStream.schema(found).parquet(f"{d}/{{events.parquet}}"))


def _composed(spark, d):
    """Events with bad payloads and a poisoned transform, through the composed stream."""
    e = _event_stream(spark, d).withColumn("after", F.when(F.col("seq") % 17 == 0, F.lit(None)).otherwise(F.col("after")))
    transform = lambda df: df.withColumn("error_reason", F.when(F.col("seq") % 50 == 1, F.lit("Transform: poison")))
    path = _folder(spark)
    store = StateStore(spark, f"{path}/state")
    assert processors.start(e, None, path, is_leader=lambda: False) is None
    processors.start(e, pipelines.Config(FIELDS, transform=transform), path, store, lambda: Election().tick().tick().is_leader).wait()
    return path, store


_VALID = "SELECT * FROM ({0}) WHERE NOT (seq % 17 = 0 AND operation IN ('Create', 'Update'))".format(ENVELOPE_SQL)


@query(f"WITH e AS ({_VALID}) SELECT id, {BUCKET_SQL.format('key', 4)} AS partition, max(seq) OVER ()::VARCHAR AS saved FROM ({COMMITTED_SQL}) WHERE terminator = 'Commit' AND seq % 50 <> 1")
def stream_transactional(spark, d):
    """What the composed stream writes, with the offset that it saves."""
    path, store = _composed(spark, d)
    return spark.read.parquet(f"{path}/events").select("id", "partition", F.lit(store.get_offset("app")).alias("saved"))


@query(f"""WITH e AS ({_VALID}) SELECT id, 'Transform' AS failed_step, 'Transform: poison' AS error_reason FROM ({COMMITTED_SQL}) WHERE terminator = 'Commit' AND seq % 50 = 1
 UNION ALL SELECT id, 'SchemaValidation', 'Validation failed: Event payload ''after'' is missing' FROM ({ENVELOPE_SQL}) WHERE seq % 17 = 0 AND operation IN ('Create', 'Update')""")
def stream_dead_letters(spark, d):
    path, _ = _composed(spark, d)
    letters = spark.read.parquet(f"{path}/letters_transform").unionByName(spark.read.parquet(f"{path}/letters_validation"))
    return letters.select("failed_event.id", "failed_step", "error_reason")


@query("""SELECT c_custkey, '{"c_name":"' || lower(lpad(to_hex(list_reduce(list_transform(range(1, length(c_name) + 1), lambda i: ascii(c_name[i])::HUGEINT),
 lambda h, b: (h * 33 + b) % 18446744073709551616::HUGEINT, 5381::HUGEINT)::UBIGINT), 16, '0')) || '","c_nationkey":"[REDACTED]"}' AS after, true AS same_key, 'ENC:v1:' AS sealed FROM customer""")
def payload_security(spark, d):
    """Rules on whole events: after and before are masked, the key isn't."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    body = F.to_json(F.struct("c_name", "c_nationkey"))
    e = c.select("c_custkey", F.to_json(F.struct("c_name")).alias("key"), body.alias("after"), F.to_json(F.struct("c_mktsegment")).alias("before"), F.to_json(F.struct("c_name")).alias("was"))
    rules = {"c_name": security.MaskingRule.HASH, "c_nationkey": security.MaskingRule.REDACT, "c_mktsegment": security.MaskingRule.ENCRYPT}
    out = security.apply_rules(e, rules, security.KeyStore(b"test key"))
    return out.select("c_custkey", "after", (F.col("key") == F.col("was")).alias("same_key"), F.regexp_extract("before", '"(ENC:v1:)', 1).alias("sealed"))


@query(f"SELECT i::INT AS chunk_id, CASE WHEN i = 1 THEN 0 ELSE least((i + 1) * 700, {_N}) - i * 700 END AS n_rows, CASE WHEN i = 1 THEN 'Failed' ELSE 'Completed' END AS status, CASE WHEN i = 1 THEN 'ValueError: chunk 1' END AS error FROM range(0, ({_N} + 699) // 700) t(i)")
def snapshot_work(spark, d):
    """A function for each chunk; the one that fails stops no other."""

    def work(chunk_id: int, low: int, high: int) -> int:
        if chunk_id == 1:
            raise ValueError("chunk 1")
        return high - low + 1

    return ordered.run_chunks(ordered.plan_chunks(spark, spark.read.parquet(f"{d}/orders.parquet").count(), 700), work).select("chunk_id", "n_rows", "status", "error")


@query("SELECT 'cas-evt-' || n AS id, n AS seq, 'sensor-' || (n % 10) AS sensor FROM range(1, 41) t(n)")
def sensor_source(spark, d):
    """The data source, whose first two attempts to connect fail."""
    generators.register(spark)
    df = spark.read.format("rillforge_sensors").option("count", 40).option("failures", 2).load()
    return df.select("id", "seq", F.get_json_object("after", "$.sensor_id").alias("sensor"))


@query("SELECT 'pg-evt-' || n AS id, n AS seq FROM range(778, 788) t(n)")
def resume_from_store(spark, d):
    """A source takes up after the offset that the store has of it."""
    store = StateStore(spark, _folder(spark))
    for offset in ("5", "777"):
        store.save_offset("pg_users", offset)
    return generators.resumed(spark, store, "pg_users", "rillforge_users", 10).select("id", "seq")


@query(f"WITH e AS (SELECT * FROM ({ENVELOPE_SQL}) WHERE seq % 28 <> 3), f AS (SELECT * FROM ({COMMITTED_SQL}) WHERE terminator IS NULL) SELECT id FROM f WHERE (SELECT count(DISTINCT transaction_id) FROM f) <= 2")
def tx_prune_all(spark, d):
    """More open transactions than allowed: all are dropped."""
    return ordered.tx_prune(events(spark, d).where("seq % 28 <> 3"), 2).select("id")


@query("SELECT 'evt-' || event_id AS id, false AS passed FROM events")
def smt_too_long(spark, d):
    """The passthrough's limit of bytes: longer envelopes fail."""
    return stateless.split(stateless.passthrough(100)(events(spark, d)))[1].select("id", (F.col("error_reason") != "MemoryAccess: envelope is too long").alias("passed"))


@query("SELECT count(*) AS throughput, true AS has_lag FROM events")
def metrics_observed(spark, d):
    """The metrics that a run of the query reports."""
    seen = Observation("cdc")
    observed(events(spark, d), seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["throughput"], seen.get["max_lag_micros"] > 0)], "throughput long, has_lag boolean")
