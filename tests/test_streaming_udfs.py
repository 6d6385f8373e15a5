"""H1-H4 stream = batch, admission control, dead-letter routing; H2 stream =
batch; U1-U3 SQL surface agrees with the relational functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from wordloom.functions.udfs import register_udfs
from wordloom.operators.embed import embed, seeded_model
from wordloom.operators.encoder_math import ModelConfig
from wordloom.operators.wordpiece import encode, token_table, tokenize, vocab_info
from wordloom.sources.vocab import fixture_vocab
from wordloom.streaming.batcher import assign_batches, batch_stream
from wordloom.streaming.pipeline import read_document_stream, start_tokenize_stream

WAIT = 3 * 3600 * 1_000_000


@pytest.fixture(scope="module")
def fx(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    vocab = fixture_vocab(docs)
    info = vocab_info(vocab)
    cfg = ModelConfig(vocab_size=info.max_id + 1, hidden=16, layers=1, heads=2, max_seq=512, ffn=32)
    return docs, vocab, info, seeded_model(spark, cfg, seed=5)


def test_stream_equals_batch_with_dead_letters(spark, fx, scratch):
    docs, vocab, info, model = fx
    docs.repartition(4, "doc_id").write.parquet(f"{scratch}/in")
    stream = read_document_stream(spark, f"{scratch}/in", max_files=1)
    q = start_tokenize_stream(stream, vocab, info, f"{scratch}/out", f"{scratch}/dead",
                              f"{scratch}/ckpt", model=model, policy="reject")
    q.awaitTermination(600)
    progress = q.recentProgress
    assert len([p for p in progress if p["numInputRows"] > 0]) == 4   # one file per trigger
    out = spark.read.parquet(f"{scratch}/out")
    dead = spark.read.parquet(f"{scratch}/dead")
    batch = encode(tokenize(docs, vocab, carry=["lang"], clip=2048, info=info), info, 512, "reject")
    ok_b = {r["doc_id"]: list(r["ids"]) for r in batch.where("status = 'ok'").collect()}
    ok_s = {r["doc_id"]: list(r["ids"]) for r in out.collect()}
    assert ok_s == ok_b
    dead_ids = {r["doc_id"] for r in dead.collect()}
    assert dead_ids == {r["doc_id"] for r in batch.where("status = 'rejected'").collect()}
    assert {r["reason"] for r in dead.collect()} <= {"over_length"}
    vec_b = {r["doc_id"]: np.array(r["embedding"]) for r in
             embed(batch.where("status = 'ok'").select("doc_id", "ids"), model).collect()}
    for r in out.select("doc_id", "embedding").collect():
        assert np.max(np.abs(np.array(r["embedding"]) - vec_b[r["doc_id"]])) < 1e-5


def _run_batcher(spark, scratch, frames, name, **kw):
    """Feed ``frames`` one per trigger (file times give the order)."""
    import glob
    import os
    for i, p in enumerate(frames):
        p.coalesce(1).write.parquet(f"{scratch}/{name}-part{i}")
    os.makedirs(f"{scratch}/{name}")
    for i in range(len(frames)):
        f = glob.glob(f"{scratch}/{name}-part{i}/*.parquet")[0]
        os.rename(f, f"{scratch}/{name}/{i}.parquet")
        os.utime(f"{scratch}/{name}/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    s = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/{name}")
    q = (batch_stream(s, "user_id", "event_id", "ts", WAIT, **kw).writeStream.format("memory")
         .queryName(name).outputMode("append")
         .option("checkpointLocation", f"{scratch}/{name}-ckpt").trigger(availableNow=True).start())
    q.awaitTermination(600)
    return sorted(tuple(r) for r in spark.table(name).collect())


def _events(spark, rows):
    return spark.createDataFrame(rows, "user_id long, event_id long, s long").select(
        "user_id", "event_id", F.timestamp_seconds("s").alias("ts"))


FLUSH = (999, 999, 4_000_000_000)          # a far later item of another key moves event time on


def test_batcher_stream_equals_batch(spark, scratch):
    ev = spark.read.parquet(f"{SF001}/events.parquet").select("user_id", "event_id", "ts")
    cuts = [r["ts"] for r in ev.orderBy("ts", "event_id").collect()]
    a, b = cuts[len(cuts) // 3], cuts[2 * len(cuts) // 3]
    end = _events(spark, [FLUSH]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    parts = [ev.where(F.col("ts") < F.lit(a)), ev.where((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))),
             ev.where(F.col("ts") >= F.lit(b)), end]
    got = _run_batcher(spark, scratch, parts, "h2_equal", idle="400 days")
    ref = sorted(tuple(r) for r in assign_batches(ev, "user_id", "event_id", "ts", WAIT).collect())
    assert [r for r in got if r[0] != 999] == ref


def test_idle_key_closes_by_timer_and_a_late_item_takes_its_place(spark, scratch):
    hour = 3600
    first = [(1, 1, 10 * hour), (1, 2, 11 * hour), (2, 5, 10 * hour)]
    then = [(3, 7, 20 * hour)]                 # other keys move event time past both waits
    late = [(3, 9, 20 * hour - 5), (3, 8, 20 * hour + 1)]       # 5 s late: within the delay, before event 7
    lost = [(1, 4, 10 * hour)]                                  # ten hours late: dropped
    got = _run_batcher(spark, scratch, [_events(spark, x) for x in (first, then, late, lost, [FLUSH])], "h2_late")
    assert [r for r in got if r[0] != 999] == [(1, 1, 0, 0), (1, 2, 0, 1), (2, 5, 0, 0),
                                               (3, 7, 0, 1), (3, 8, 0, 2), (3, 9, 0, 0)]


def test_batches_do_not_depend_on_the_partitioning(spark):
    """One hot key with most items, runs that span many partitions, equal times."""
    rows = [(1, i, (i // 3) * 1800) for i in range(600)] + [(2, 1000 + i, i * 7200) for i in range(40)] + [(None, 5000, 7)]
    df = spark.createDataFrame(rows, "k long, id long, s long").withColumn(
        "ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want, state = {}, {}
    for k, i, s in sorted(rows, key=lambda r: (r[0] or -1, r[2], r[1])):
        no, t0, n = state.get(k, (-1, None, 8))
        no, t0, n = (no, t0, n + 1) if t0 is not None and n < 8 and s - t0 < 3 * 3600 else (no + 1, s, 1)
        state[k] = (no, t0, n)
        want[i] = (no, n - 1)
    try:
        for parts in (1, 5, 97):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = {r["item_id"]: (r["batch_no"], r["pos_in_batch"])
                   for r in assign_batches(df, "k", "id", "ts", WAIT).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_boundary_at_exact_wait(spark):
    base = 1_700_000_000
    rows = [(1, 1, base), (1, 2, base + 9), (1, 3, base + 10), (1, 4, base + 11)]
    rows += [(2, 10 + i, base + i) for i in range(9)]   # 9 items inside the wait
    df = spark.createDataFrame(rows, "k long, id long, s long").withColumn(
        "ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = {r["item_id"]: (r["batch_no"], r["pos_in_batch"])
           for r in assign_batches(df, "k", "id", "ts", 10 * 1_000_000).collect()}
    assert got[1] == (0, 0) and got[2] == (0, 1) and got[3] == (1, 0) and got[4] == (1, 1)
    assert got[17] == (0, 7) and got[18] == (1, 0)


def test_sql_udfs(spark, fx):
    docs, vocab, info, model = fx
    register_udfs(spark, vocab, model)
    docs.createOrReplaceTempView("docs001")
    enc = encode(tokenize(docs, vocab, info=info), info, 512)
    rel = {r["doc_id"]: r["n_tokens"] for r in enc.collect()}
    sql = {r["doc_id"]: r["n"] for r in spark.sql("SELECT doc_id, token_count(text) AS n FROM docs001").collect()}
    assert sql == rel
    n_rows = spark.sql("SELECT count(*) FROM docs001, LATERAL tokenize(text)").first()[0]
    assert n_rows == token_table(enc).count()
    small = spark.sql("SELECT doc_id, embed_text(text) AS e FROM docs001 WHERE doc_id < 20").collect()
    ref = {r["doc_id"]: np.array(r["embedding"]) for r in
           embed(enc.where("doc_id < 20").select("doc_id", "ids"), model).collect()}
    for r in small:
        assert np.max(np.abs(np.array(r["e"]) - ref[r["doc_id"]])) < 1e-5


def test_admission_by_bytes(spark, scratch):
    """H3: a byte budget smaller than one file admits one file per trigger;
    every row still arrives."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    docs.repartition(4).write.parquet(f"{scratch}/in")
    s = read_document_stream(spark, f"{scratch}/in", max_files=None, max_bytes=1)
    q = (s.writeStream.format("memory").queryName("h3_bytes")
         .option("checkpointLocation", f"{scratch}/ck").trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == 4
    assert spark.table("h3_bytes").count() == docs.count()


def test_micro_batches_leave_no_intermediate_tables(spark, fx, scratch):
    import glob

    from wordloom.session import shared_dir

    docs, vocab, info, _model = fx
    docs.repartition(3, "doc_id").write.parquet(f"{scratch}/in")
    folder = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/*"))
    q = start_tokenize_stream(read_document_stream(spark, f"{scratch}/in", max_files=1), vocab, info,
                              f"{scratch}/out", f"{scratch}/dead", f"{scratch}/ckpt", policy="reject")
    q.awaitTermination(600)
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == 3
    assert set(glob.glob(f"{folder}/*")) == before


def test_embed_text_of_null_is_null(spark, fx):
    docs, vocab, info, model = fx
    register_udfs(spark, vocab, model)
    got = spark.sql("SELECT embed_text(t) AS v, token_count(t) AS n FROM VALUES ('a'), (CAST(NULL AS STRING)) AS x(t)").collect()
    assert got[0]["v"] is not None and got[1]["v"] is None and got[1]["n"] == 0


def test_a_stream_goes_on_from_a_batch_run(spark, scratch):
    """Open batches take items of the stream, full and over ones do not, a key
    without further items closes by its timer, and new keys start at 0."""
    from wordloom.streaming.batcher import handover

    hour = 3600
    history = [(1, i, 10 * hour + i) for i in range(10)] + [(2, 20, 9 * hour)] + [(4, 40 + i, 10 * hour) for i in range(8)]
    rest = [(1, 12, 11 * hour), (1, 13, 14 * hour), (3, 30, 12 * hour), (4, 50, 10 * hour + 30), (1, 14, 14 * hour + 5)]
    whole = _events(spark, history + rest)
    want = sorted(tuple(r) for r in assign_batches(whole.withColumn("ts", F.col("ts").cast("timestamp_ntz")),
                                                   "user_id", "event_id", "ts", WAIT).collect())
    old = _events(spark, history + [(None, 70, 5)]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    over, state = handover(old, "user_id", "event_id", "ts", WAIT)
    assert sorted((r["k"], r["batch"], r["item"]) for r in state.collect()) == \
        [(1, 1, 8), (1, 1, 9), (2, 0, 20)] + [(4, 0, 40 + i) for i in range(8)]
    got = _run_batcher(spark, scratch, [_events(spark, rest), _events(spark, [FLUSH])], "h2_handover", initial=state,
                       idle="100000 days")
    done = sorted(tuple(r) for r in over.collect() if r["key"] is not None)
    assert sorted(done + [r for r in got if r[0] != 999]) == want


@pytest.mark.parametrize("name", ["h1_stream_tokenize", "h4_dead_letters"])
def test_documents_in_a_folder_of_files_are_streamed(spark, scratch, name):
    from wordloom.plans import registry
    docs = spark.createDataFrame([(i, f"word{i} and some more", "en", "web", 20) for i in range(20)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(2).write.parquet(f"{scratch}/documents.parquet")
    got = registry.queries()[name](spark, scratch)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(20))
