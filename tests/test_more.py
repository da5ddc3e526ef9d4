import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import columns as C
from nearfield.functions.dual import Calibrator, dual_hash, raw_similarity
from nearfield.operators import dual, signing, verdict
from nearfield.sources import feed
from nearfield.streaming import sync


def test_calibrator(spark):
    c = Calibrator((0.2, 0.5, 1.0), (0.0, 0.8, 0.9))
    assert Calibrator.from_json(c.to_json()) == c
    got = spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.35, 0.5, 0.75, 2.0)], "x double").select(c(F.col("x")).alias("y")).collect()
    assert np.allclose([r.y for r in got], np.interp([0.0, 0.2, 0.35, 0.5, 0.75, 2.0], c.x, c.y))
    with pytest.raises(ValueError):
        Calibrator((0.5, 0.5), (0.0, 1.0))


def test_dual_hash(spark):
    rng = np.random.default_rng(3)
    v = [rng.normal(size=384).tolist() for _ in range(3)]
    rows = [(1, v[0]), (2, [0.95 * x for x in v[0]]), (3, v[1]), (4, None), (5, [0.0] * 384)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.h for r in d.select("vec_id", dual_hash(F.col("embedding")).alias("h")).collect()}
    assert got[1] == got[2] != got[3] and got[4] is None and got[5].hash_a == "0" * 128
    assert got[1].hash_a[:64] == signing.sign(d.filter("vec_id = 1")).first().signature
    assert bin(int(got[1].hash_b, 16)).count("1") == 282


def test_raw_similarity_equals_plain_count(spark):
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2, size=(4, 512)).astype(bool)
    a1, b1, a2, b2 = (np.packbits(x).tobytes().hex() for x in bits)
    same, sure = bits[0] == bits[2], bits[1] & bits[3]
    row = spark.createDataFrame([(a1, b1, a2, b2), (a1, "0" * 128, a2, b2)], "a1 string, b1 string, a2 string, b2 string")
    got = [r.s for r in row.select(raw_similarity(*[C.words64(F.col(c), 8) for c in ("a1", "b1", "a2", "b2")]).alias("s")).collect()]
    assert np.allclose(got, [0.65 * same[sure].mean() + 0.35 * same.mean(), same.mean()])


def test_trained_rotation(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 8)) * np.arange(8, 0, -1) + 3
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>")
    r = dual.train_rotation(d, rounds=5)
    assert np.allclose(r.mean, x.mean(axis=0)) and r.axes.shape == (256, 8)
    assert np.allclose(r.axes[:8] @ r.axes[:8].T, np.eye(8), atol=1e-8) and not r.axes[8:].any()
    assert dual.dual_sign(d, rotation=r).filter("hash_a is not null").count() == 200


def test_feed_defaults_and_errors(spark):
    page = {"page": 1, "total_pages": 1, "total_count": 2, "threat_feeds": [{"uuid": "a", "title": "x", "updated_at": "2024-01-02"}, {"uuid": "b", "title": "y", "severity": "high", "updated_at": "2024-01-01", "detection_signatures": [{"version": "v1", "signature": "0" * 64}, {"version": "v0", "signature": "1" * 64}]}]}
    e = feed.entries(spark.createDataFrame([(json.dumps(page),)], "body string"))
    assert [(r.uuid, r.severity, r.security_boundary, len(r.detection_signatures)) for r in e.collect()] == [("a", "low", "", 0), ("b", "high", "", 2)]
    assert [(r.uuid, len(r.bands)) for r in feed.signatures_of(e).collect()] == [("b", 16)]
    assert feed.signatures_of(e, since=F.lit("2024-01-01")).count() == 1 and feed.signatures_of(e, since=F.lit("2024-01-02")).count() == 0
    assert feed.cursor(e).first().since == "2024-01-02"
    for bad in ('{"page": 1, "threat_feeds": [{"title": "x"}]}', "no page"):
        with pytest.raises(Exception, match="uuid|MALFORMED|malformed"):
            feed.entries(spark.createDataFrame([(bad,)], "body string")).collect()


@pytest.mark.parametrize("body", [["a ", "b", "a", " "], [{"prompt": "a"}, {"text": " b"}, {"x": 1}], {"prompts": ["a", {"content": "b"}]}, {"results": [{"body": "a"}, {"title": "b"}]}])
def test_prompts(spark, tmp_path, body):
    (tmp_path / "p.json").write_text(json.dumps(body))
    assert sorted(r.text for r in feed.read_prompts(spark, str(tmp_path / "p.json")).collect()) == ["a", "b"]


def test_chunk_scores(spark):
    d = spark.createDataFrame([(1, "bad " * 600), (2, ""), (3, "fine")], "id long, text string")
    chunks = verdict.score_chunks(d, F.split(F.trim("text"), " "), lambda w: F.when(F.array_contains(w, "bad"), 0.5).otherwise(0.1), "id")
    got = {r.id: (r.n_chunks, r.suspicious, r.max_score) for r in verdict.reduce_chunks(chunks, "id").collect()}
    assert got == {1: (2, True, 0.5), 2: (1, False, 0.1), 3: (1, False, 0.1)}


def test_stream_goes_on_and_keeps_newer_rows(spark, tmp_path):
    schema = "user_id long, ts long, event_id long"
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: sorted(map(tuple, sync.sync_stream(spark.readStream.schema(schema).parquet(source), "user_id", "ts", "event_id", folder).collect()))
    spark.createDataFrame([(1, 5, 1), (1, 5, 2), (2, 9, 3)], schema).write.parquet(source)
    assert run() == [(1, 5, 2), (2, 9, 3)]
    spark.createDataFrame([(1, 6, 4), (2, 1, 5), (3, 1, 6)], schema).write.mode("append").parquet(source)
    assert run() == [(1, 6, 4), (2, 9, 3), (3, 1, 6)]
    assert run() == [(1, 6, 4), (2, 9, 3), (3, 1, 6)]


def test_dual_index_has_64_bands(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2, size=512).astype(bool)
    b = a.copy()
    b[::16] ^= True  # a bit in each piece of four digits, none in every second piece of two
    rows = [(i, np.packbits(x).tobytes().hex(), "f" * 128) for i, x in enumerate((a, b))]
    index = dual.dual_index(spark.createDataFrame(rows, "vec_id long, hash_a string, hash_b string"))
    assert index.filter("vec_id = 0").count() == 64
    assert [(r.x, r.y) for r in dual.dual_pairs(index, 0.6).collect()] == [(0, 1)]
