import datetime
import random
import urllib.request

import duckdb
import pytest
from pyspark.sql import functions as F

from rillforge import control, queries, state
from rillforge.envelope import COLUMNS, SCHEMA
from rillforge.functions import security
from rillforge.operators import ordered, stateless
from rillforge.plans import pipelines
from rillforge.sources import generators, sinks
from rillforge.streaming import processors

SF = "/root/testdata/sf0.001"
T0 = datetime.datetime(2024, 1, 1)


def event(seq, op="Create", tx=None, key='{"id":1}', after=None, table="users", id=None, at=0):
    return (id or f"e{seq}", "db", table, op, T0 + datetime.timedelta(seconds=at or seq), key, None, after, tx, f"offset-{seq}", seq)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "customer"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    assert got == sorted((tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()), key=repr)


def test_transactions_equal_a_sequential_model(spark):
    rng = random.Random(5)
    rows = [event(i, rng.choice(["Create", "Update", "Delete", "Commit", "Rollback"]), rng.choice([None, "a", "b", "c"])) for i in range(300)]
    held, out = {}, []
    for r in rows:
        op, tx = r[3], r[8]
        if tx is None:
            out.append((r[10], r[10]))
        elif op == "Commit":
            out += [(s, r[10]) for s in held.pop(tx, [])]
        elif op == "Rollback":
            held.pop(tx, None)
        else:
            held.setdefault(tx, []).append(r[10])
    got = ordered.tx_committed(frame(spark, rows)).select("seq", "emit_seq").collect()
    assert sorted(map(tuple, got)) == sorted(out)
    assert sorted(r.seq for r in ordered.tx_in_flight(frame(spark, rows)).collect()) == sorted(s for x in held.values() for s in x)


def test_fifo_dedup_evicts_the_oldest(spark):
    state_ = ordered.FifoDedup(3)
    assert [state_.check(x) for x in ("e1", "e1", "e2", "e3", "e4", "e1")] == [False, True, False, False, False, False]
    rows = [event(i, id=x) for i, x in enumerate(["e1", "e1", "e2", "e3", "e4", "e1"])]
    assert [r.seq for r in ordered.dedup_fifo(frame(spark, rows), 3).orderBy("seq").collect()] == [0, 2, 3, 4, 5]


def test_watermark_patches_and_deletes(spark):
    m = stateless.MARKER_TABLE
    log = frame(spark, [
        event(1, "Update", after='{"v":0}'), event(2, table=m), event(3, "Update", after='{"v":1}'), event(4, "Delete", key='{"id":2}'), event(5, "Create", key='{"id":2}', after="{}"),
        event(6, "Update", key='{"id":3}', after=None), event(7, "Commit", table=m), event(8, "Delete", key='{"id":4}'),
    ])
    chunk = spark.createDataFrame([(f'{{"id":{i}}}', "old", T0) for i in (1, 2, 3, 4)], "key string, after string, timestamp timestamp_ntz")
    got = {r.key: r.after for r in ordered.reconcile(chunk, log).collect()}
    assert got == {'{"id":1}': '{"v":1}', '{"id":3}': None, '{"id":4}': "old"}


def test_validation_messages(spark):
    schema = {"fields": {"a": "integer", "b": "float", "c": "string", "d": "boolean", "e.f": "integer"}}
    good = '{"a":1.0,"b":2,"c":"x","d":true,"e.f":3}'
    cases = [good, None, "[1]", "{", '{"a":1.5}', good.replace("true", "null"), '{"a":1,"b":1,"c":"x","d":true}']
    df = frame(spark, [event(i, after=x) for i, x in enumerate(cases)] + [event(99, "Delete")])
    got = [(r.error_reason or "ok").replace("Validation failed: ", "") for r in stateless.validate(df, schema).orderBy("seq").collect()]
    assert got == ["ok", "Event payload 'after' is missing", "Event payload is not a JSON object", "Event payload is not a JSON object", "Field 'a' expected integer, found 1.5", "Field 'd' expected boolean, found null", "Missing required field 'e.f'", "ok"]
    assert stateless.validate(df, {}).where("error_reason is null").count() == 0


def test_masking_and_keys(spark):
    keys = security.KeyStore(b"k1")
    df = spark.createDataFrame([('{"id":1,"ssn":"1","email":"alice@example.com","n":null}',), ("not json",), (None,)], "j string")
    rules = {"ssn": security.MaskingRule.REDACT, "email": security.MaskingRule.HASH, "id": security.MaskingRule.ENCRYPT}
    masked = security.with_keys(df, keys).select(security.mask(F.col("j"), rules, keys))
    rows = [r[0] for r in masked.collect()]
    assert security.hashlib.sha256(b"k1").hexdigest() not in masked._jdf.queryExecution().toString().lower()
    assert '"email":"bb3a8e7ca00ab25c"' in rows[0] and '"ssn":"[REDACTED]"' in rows[0] and '"id":"ENC:v1:' in rows[0] and rows[1:] == ["not json", None]
    assert keys.rotate(b"k2") == 2 and keys.by_version(1) == b"k1"
    with pytest.raises(ValueError):
        security.mask(F.col("j"), rules)


def test_state_compatibility_and_cli(spark, tmp_path):
    store = state.StateStore(spark, str(tmp_path / "state"))
    assert store.get_offset("x") is None
    store.save_offset("pg_users", "offset-1")
    store.save_offset("pg_users", "offset-777")
    assert store.register_schema("s", {"fields": {"id": "integer"}}) == 1
    with pytest.raises(state.IncompatibleSchema):
        store.register_schema("s", {"fields": {}}, state.SchemaCompatibility.BACKWARD)
    assert store.register_schema("s", {"fields": {"id": "integer", "n": "string"}}, state.SchemaCompatibility.BACKWARD) == 2
    assert control.execute(control.parse_args(["inspect-offset", "pg_users"]), store) == "pg_users: offset-777"
    assert control.parse_args([]) == ("status", None) and control.parse_args(["schema-list"]) == ("schema-list", "postgres_users")
    with pytest.raises(control.UnknownCommand):
        control.execute(control.parse_args(["what"]), store)


def test_control_plane():
    e = control.Election().tick().tick()
    assert e.is_leader and e.term == 1 and not e.step_down().is_leader and control.tick_millis(1) == 200
    assert control.claim_lease(0.12, 0, 0.05) and not control.claim_lease(0.1, 0, 0.05) and control.claim_lease(0, 0, 1, held=True)
    now = [0.0]
    bucket = control.TokenBucket(10, 100, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(15):
        bucket.acquire()
    assert now[0] == pytest.approx(0.05)
    with pytest.raises(ValueError):
        bucket.acquire(11)
    metrics = control.Metrics()
    metrics.add("ingested")
    metrics.record_latency(500_000)
    server = metrics.serve()
    assert b"latency_seconds_sum 0.500000" in urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/").read()
    server.shutdown()


def test_retry():
    tries, slept = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise generators.SourceError("Connection", "no")
        return "ok"

    assert generators.retry_with_backoff(flaky, sleep=slept.append, jitter=lambda: 0.5) == "ok" and slept == [0.05, 0.1]
    with pytest.raises(generators.SourceError):
        generators.retry_with_backoff(lambda: (_ for _ in ()).throw(generators.SourceError("Slot", "x")), 3, sleep=slept.append)


def test_chunks_reject_zero(spark):
    with pytest.raises(ValueError):
        ordered.plan_chunks(spark, 10, 0)
    assert [tuple(r) for r in ordered.plan_chunks(spark, 10, 4).collect()] == [(0, 1, 4), (1, 5, 8), (2, 9, 10)]
    assert ordered.plan_chunks(spark, 0, 4).count() == 0


def test_end_to_end_thousand_events(spark):
    rows = [event(i, "Create", "tx-1", f'{{"id":{i}}}', f'{{"id":{i},"name":"User-{i}"}}') for i in range(1000)] + [event(1000, "Commit", "tx-1")]
    out = pipelines.transactional(frame(spark, rows), pipelines.Config({"fields": {"id": "integer", "name": "string"}})).events
    assert out.count() == 1000 and state.latest_offsets(out).first().offset == "offset-999"


def test_python_source(spark):
    spark.dataSource.register(generators.TransactionalSource)
    df = spark.read.format("rillforge_users").option("count", 8).option("offset", "4").load()
    assert sorted(r.seq for r in df.collect()) == list(range(5, 13)) and df.columns == COLUMNS


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    rows = [event(i, "Commit" if i % 4 == 3 else "Update", f"tx-{i // 8 * 2 + i % 2}", after='{"v":1}') for i in range(32)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:13], rows[13:]):  # transactions are open across the two runs
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = processors.buffer_transactions(spark.readStream.schema(SCHEMA).parquet(source))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    want = sorted(r.seq for r in ordered.tx_committed(frame(spark, rows)).collect())
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == want and want


def test_fifo_query_has_repeats_to_drop(spark):
    rows, kept = queries.fifo_rows(spark, SF), queries.QUERIES["dedup_fifo_mixed"](spark, SF)
    assert kept.count() > rows.select("id").distinct().count() and kept.count() < rows.count()


def test_one_long_transaction(spark):
    rows = spark.range(200_000).selectExpr("concat('e', id) id", "'db' source_database", "if(id = 199999, 'Commit', 'Update') operation", "'t' transaction_id", "id seq")
    assert ordered.tx_committed(rows).count() == 199_999


def test_chunks_run_again_take_up_what_failed(spark):
    def fails(chunk_id, low, high):
        if chunk_id == 1:
            raise ValueError("once")
        return high - low + 1

    first = ordered.run_chunks(ordered.plan_chunks(spark, 10, 4), fails)
    assert sorted((r.chunk_id, r.status) for r in first.collect()) == [(0, "Completed"), (1, "Failed"), (2, "Completed")] and ordered.progress(first).first()[0] == "2/3"
    again = ordered.run_chunks(spark.createDataFrame(first.collect(), first.schema), lambda i, low, high: high - low + 1)
    assert ordered.progress(again).first()[0] == "3/3" and sum(r.n_rows for r in again.collect()) == 10
    with pytest.raises(ValueError):
        ordered.run_chunks(first, fails, 0)


def test_a_composed_stream_goes_on_after_a_stop(spark, tmp_path):
    source, out, store = str(tmp_path / "in"), str(tmp_path / "out"), state.StateStore(spark, str(tmp_path / "state"))
    rows = [event(i, "Commit" if i % 4 == 3 else "Update", f"tx-{i // 8 * 2 + i % 2}", after='{"v":1}' if i != 5 else "[]") for i in range(32)]
    config = pipelines.Config({"fields": {"v": "integer"}})
    for part in (rows[:13], rows[13:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        running = processors.start(spark.readStream.schema(SCHEMA).parquet(source), config, out, store, available_now=False)
        running.stop()
    valid = [r for r in rows if r[10] != 5]
    want = sorted(r.seq for r in ordered.tx_committed(frame(spark, valid)).collect())
    assert sorted(r.seq for r in spark.read.parquet(f"{out}/events").collect()) == want
    assert [r.failed_event.seq for r in spark.read.parquet(f"{out}/letters_validation").collect()] == [5] and store.get_offset("db") is not None


def test_a_reader_that_cannot_connect_fails(spark):
    generators.register(spark)
    with pytest.raises(Exception, match="DirectoryAccess"):
        spark.read.format("rillforge_sensors").option("failures", 9).load().collect()


def test_state_that_cannot_be_read_is_no_empty_state(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        state.StateStore(spark, str(tmp_path / "s")).get_offset("x")


@pytest.mark.parametrize("sources, kinds", [(1, 40), (3, 40), (1, 4), (300, 40)])
def test_fifo_over_many_tasks_equals_a_sequential_model(spark, sources, kinds):
    """Ids far fewer than rows, so that repeats fall inside and beyond the capacity; 4 kinds and a capacity of 3 never forget their start."""
    rng = random.Random(sources + kinds)
    rows = [(f"e{rng.randrange(kinds) if kinds > 4 else i % kinds}", f"db{rng.randrange(sources)}", i) for i in range(6000)]
    capacity = 3 if kinds == 4 else 20
    states, want = {}, []
    for id, source, seq in rows:
        if not states.setdefault(source, ordered.FifoDedup(capacity)).check(id):
            want.append(seq)
    df = spark.createDataFrame(rows, "id string, source_database string, seq long").repartition(5)
    kept, queues, ranges = ordered.fifo(df, capacity, rows=100)
    assert ranges.select("__part").distinct().count() > 3 or capacity == 20
    assert sorted(r.seq for r in kept.collect()) == want
    got = {}
    for r in queues.orderBy("seq").collect():
        got.setdefault(r.source_database, []).append(r.id)
    assert got == {k: list(v.queue) for k, v in states.items()}


def test_fifo_sorts_one_source_in_many_tasks(spark):
    rows = spark.range(100_000).selectExpr("concat('e', id div 2) id", "'db' source_database", "id seq")
    kept, _, ranges = ordered.fifo(rows, 10, rows=10_000)
    sizes = [r["count"] for r in ranges.groupBy("__part").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 20_000 and kept.count() == 50_000


def test_gate_takes_held_mutations_before_later_ones(spark):
    held = frame(spark, [event(9, "Create", "a"), event(10, "Create", "b")])
    passed, waiting, _ = ordered.gate(frame(spark, [event(3, "Commit", "a"), event(4, "Update", "a"), event(5, "Update"), event(6, "Rollback", "b"), event(7, "Create", "b")]), held)
    assert sorted(r.seq for r in passed.collect()) == [5, 9] and sorted(r.seq for r in waiting.collect()) == [4, 7]


def test_the_composed_stream_deduplicates_a_batch_once_in_many_tasks(spark, monkeypatch):
    sizes = []
    ranged = ordered.in_ranges

    def watched(df, order, rows, keep):
        out = ranged(df, order, 100, keep)
        sizes.append(max(r["count"] for r in out.groupBy("__part").count().collect()))
        return out

    monkeypatch.setattr(ordered, "in_ranges", watched)
    steps = {r.failed_step for r in queries.QUERIES["stream_dead_letters"](spark, SF).collect()}
    assert steps == {"Transform", "SchemaValidation"} and len(sizes) == 1 and max(sizes) < 300


def test_steps_of_micro_batches_go_on_after_a_stop(spark, tmp_path):
    """Ids within a capacity and beyond it, and a window, across two runs; a batch that runs twice changes nothing."""
    m = stateless.MARKER_TABLE
    rows = [event(i, "Create", id=x, table=m if i in (4, 9) else "users") for i, x in enumerate(["a", "a", "b", "c", "m", "a", "d", "e", "a", "n", "c"])]
    for name, step, columns, want in (
        ("dedup", lambda p, w: processors.dedup(p, w, 3), ["seq"], [(i,) for i in (0, 2, 3, 4, 5, 6, 7, 9, 10)]),
        ("windows", processors.mark_windows, ["seq", "in_window"], [(i, 4 < i < 9) for i in range(11) if i not in (4, 9)]),
    ):
        source, out = str(tmp_path / name / "in"), str(tmp_path / name / "out")
        write = step(str(tmp_path / name / "state"), lambda df, i, out=out: df.write.mode("overwrite").parquet(f"{out}/batch_id={i}"))
        for part in (rows[:6], rows[6:]):
            frame(spark, part).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(SCHEMA).parquet(source)
            stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / name / "c")).trigger(availableNow=True).start().awaitTermination(120)
        write(frame(spark, rows[6:]), 1)
        assert sorted(tuple(r[c] for c in columns) for r in spark.read.parquet(out).collect()) == want


def test_streams_hold_no_source_in_one_task(spark, monkeypatch):
    """What a stream's steps keep of a batch is spread over tasks, not keyed by source."""
    sizes = []
    ranged = ordered.in_ranges

    def watched(df, order, rows, keep):
        out = ranged(df, order, 100, keep)
        sizes.append(max(r["count"] for r in out.groupBy("__part").count().collect()))
        return out

    monkeypatch.setattr(ordered, "in_ranges", watched)
    kept = {}
    for name in ("stream_dedup_fifo", "watermark_window_flag"):
        kept[name] = queries.QUERIES[name](spark, SF).count()
    assert len(sizes) == 2 and max(sizes) < 300 and min(kept.values()) > 600


def test_window_flags_over_many_tasks_and_batches_equal_a_sequential_model(spark):
    rng = random.Random(8)
    m = stateless.MARKER_TABLE
    rows = [event(i, rng.choice(["Create", "Update", "Commit"]), table=m if rng.random() < 0.01 else None if rng.random() < 0.1 else "users") for i in range(9000)]
    rows = [(r[0], "one" if i % 3 else f"db{i % 7}", *r[2:]) for i, r in enumerate(rows)]
    inside, want = {}, []
    for r in rows:
        if r[2] == m:
            inside[r[1]] = inside.get(r[1], False) ^ (r[3] in ("Create", "Commit"))
        else:
            want.append((r[10], inside.get(r[1], False)))
    held, got = None, []
    for part in (rows[:5000], rows[5000:]):
        flagged, held, ranges = ordered.window_flags(frame(spark, part).repartition(3), held=held, rows=500)
        assert ranges.select("__part").distinct().count() > 5
        got += [(r.seq, r.in_window) for r in flagged.collect()]
    assert sorted(got) == sorted(want) and {r[0] for r in held.collect()} == {k for k, v in inside.items() if v}


def test_the_composed_stream_copies_no_input(spark, monkeypatch):
    """Its source is the table itself, and a standby writes nothing."""
    monkeypatch.setattr(queries, "_streamed", lambda *a: pytest.fail("a copy of the events was written"))
    assert queries.QUERIES["stream_dead_letters"](spark, SF).count() > 0


def test_fifo_sends_python_no_rows_and_later_filters_change_no_verdict(spark):
    rows = spark.range(4000).selectExpr("concat('e', id % 150) id", "'db' source_database", "id seq", "'x' payload")
    kept, queues, _ = ordered.fifo(rows, 100, rows=500)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    all_ = sorted(r.seq for r in kept.collect())
    assert sorted(r.seq for r in kept.where("seq >= 2000 and id <> 'e7'").collect()) == [i for i in all_ if i >= 2000 and i % 150 != 7]
    assert queues.count() == 100


def test_one_sink_keeps_no_batch(spark):
    seen = []
    sinks.fan_out(lambda df, i: seen.append(df.storageLevel.useDisk))(spark.range(3), 0)
    sinks.fan_out(*[lambda df, i: seen.append(df.storageLevel.useDisk)] * 2)(spark.range(3), 0)
    assert seen == [False, True, True]
