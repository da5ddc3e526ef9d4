import json
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import columns as C
from nearfield.functions import providers as P
from nearfield.functions.hyperplanes import splitmix64
from nearfield.operators import cache, numbering, search, signing, texts
from nearfield.sources import feed
from nearfield.streaming import sync

#: Published results of the signature format.
SPLITMIX = {0: "E220A8397B1DCDAF", 1: "910A2DEC89025CC1", 42: "BDD732262FEB6E95", 12345: "22118258A9D111A0", 11400714819323198485: "6E789E6AA1B965F4", 18446744073709551615: "E4D971771B652C20", 9223372036854775807: "2A67D7552E039EA7"}
SIGNATURES = [
    ([0.5, 0.5, 0.5, 0.5], ["8d000000ac854dae91814006c580080a101141b001f30360003854003aba581a", "0389409928041463408a857b80a0e402101822101184a4d096e03020c9344008", "b846c11944c0a43a51230104cba00a20081a4181a11822026000051718203bd2"]),
    ([0.5, 0.0, 0.5, 0.0, 0.5, 0.0, 0.5, 0.0], ["3182004aac844486b10a60048dac48060000411089b602c850b954348212de02", "138920d728001472008784510108c603b009233c9110343d0ae1126118dc0008", "910608034122cd72306401980a005710496a11800110a6a25500c19010400192"]),
    ([0.5, -0.5, 0.5, -0.5], ["10225221e8134833b10a070009d4e802920800402a24508a40a9543c02161600", "03dde041b840869202c28440800cca01a20d0f789122843d28c900e14c442088", "8436680f03e1c17131750199e210270248282980001886305898490034902092"]),
]
HAMMING = [("0000", "ffff", 16), ("0000", "0000", 0), ("0f0f", "f0f0", 16), ("a", "b", 1), ("abc", "def", 7), ("ff", "7f", 1), ("0123456789abcdef", "fedcba9876543210", 64)]
COSINES = [(0, 1.0), (128, 6.123233995736766e-17), (256, -1.0), (64, 0.7071067811865476), (192, -0.7071067811865475), (32, 0.9238795325112867), (1, 0.9999247018391445)]
DIGESTS = [
    ([0.10000000149011612, 0.20000000298023224, 0.30000001192092896], "9a04781069052282acb2e95529c7f5bcd85149ab2ec559c550dce80b81ceb04e"),
    ([0.12345600128173828, 1.0], "730da253c365cc40fb4b319971547d2f33b13de3469e917da1cdbd624f8b1a2a"),
    ([1.0, 2.0, 3.0], "d4ab5ad55f1dc0ffe69d38b31485c73e876a35d927e8659d701a83e1777e1941"),
    ([0.0, -0.0, 0.5], "e585d632f3d9d04b8bc7ee1ed6ed8570d57475b14b6387d0b29416eee944af0d"),
]
SPELLINGS = {"0din-v0:deadbeef12345678": "v0", "0din-v1:cafebabe87654321": "v1", "invalid:foo": None, "0din-v99:foo": None, "0din-v0": None, "0din-v0:foo:bar": None, "0din-v1:ABCDEF": None}


def test_golden_values(spark, tmp_path):
    assert {x: f"{int(splitmix64(x)):016X}" for x in SPLITMIX} == SPLITMIX
    (tmp_path / "v.json").write_text(json.dumps({"description": "x", "vectors": [{"input": v, "expected": s} for v, s in SIGNATURES]}))
    rows = feed.read_vectors(spark, str(tmp_path / "v.json"), "input array<double>, expected array<string>")
    for r in rows.select("expected", texts.lsh_families(F.col("input")).alias("f")).collect():
        assert [x.signature for x in r.f] == r.expected and [x.bits for x in r.f] == [256] * 3
        assert r.f[0].bands == [r.expected[0][4 * i : 4 * i + 4] for i in range(16)]
    d = spark.createDataFrame(HAMMING, "a string, b string, d int")
    assert all(r.d == r.x for r in d.withColumn("x", C.hamming_hex(F.col("a"), F.col("b"))).collect())
    c = spark.createDataFrame(COSINES, "d int, c double").withColumn("x", C.cosine_from_hamming(F.col("d")))
    assert all(math.isclose(r.c, r.x, abs_tol=1e-10) for r in c.collect())
    e = spark.createDataFrame(DIGESTS, "v array<double>, s string").withColumn("x", C.embedding_sha256(F.col("v")))
    assert all(r.s == r.x for r in e.collect())
    p = spark.createDataFrame(list(SPELLINGS.items()), "t string, v string").withColumn("x", C.parse_signature(F.col("t"))["version"])
    assert all(r.v == r.x for r in p.collect())


def test_providers_and_versions(spark):
    assert texts.resolve_version("latest", 1536) == "v0" and texts.resolve_version("v1", 1024) == "v1"
    for bad in (("latest", 64), ("v0", 1024)):
        with pytest.raises(ValueError, match="dimensions"):
            texts.resolve_version(*bad)
    with pytest.raises(ValueError, match="hasher"):
        texts.get_hasher("x")
    post = lambda url, data, headers: json.dumps({"data": [[float(len(t)), 1.0] for t in json.loads(data)["input"]]}).encode()
    remote = P.HttpModel("http://x", lambda t: {"input": t}, lambda a: a["data"], 2, post=post)
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.e for r in rows.select("doc_id", P.embedding(F.col("text"), remote).alias("e")).collect()}
    assert np.allclose(got[1], np.array([3, 1]) / np.sqrt(10)) and got[2] is None
    vectors, mask = np.arange(12.0).reshape(4, 3), np.array([1, 0, 1, 0])
    assert P.pooled(vectors, mask).tolist() == [3, 4, 5] and P.pooled(vectors, 0 * mask).tolist() == [0, 0, 0]
    none = texts.sign_text(rows, P.CodePoints(1024)).filter("doc_id = 2").first()
    assert none.signature is None and none.lsh is None and none.prompt_preview is None


def test_classify_wraps_and_checks(spark):
    rows = spark.createDataFrame([(1, list(range(511))), (2, []), (3, None)], "doc_id long, ids array<int>")
    seen = P.scorer(lambda: lambda chunks: [[float(c[0]), float(c[-1])] for c in chunks])
    got = {r.doc_id: r for r in texts.classify(rows, F.col("ids"), seen, 101, 102).collect()}
    assert [c.token_count for c in got[1].chunks] == [512, 53] and got[1].total_tokens == 511
    assert [c.token_count for c in got[2].chunks] == [c.token_count for c in got[3].chunks] == [2]
    assert all(c.score > 0.7 for r in got.values() for c in r.chunks) and got[2].is_suspicious
    with pytest.raises(Exception, match="two logits"):
        texts.classify(rows, F.col("ids"), lambda w: F.array(F.lit(1.0)), 1, 2).collect()


@pytest.mark.parametrize("n", [2, 3, 99, 250])
def test_percentiles_are_exclusive(spark, n):
    rng = np.random.default_rng(n)
    values = rng.normal(size=n).round(1).tolist()
    r = numbering.exclusive_percentiles(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3), "v").first()
    q = statistics.quantiles(values, n=100)
    assert r.n == n and np.allclose([r.p50, r.p95, r.p99, r.max, r["mean"]], [q[49], q[94], q[98], max(values), np.mean(values)])


def test_cache_versions_and_faults(spark, tmp_path):
    folder = str(tmp_path / "c")
    signed = signing.sign(spark.createDataFrame([(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(20)], "vec_id long, embedding array<double>"))
    assert cache.load(spark, folder) is None
    cache.save(signed, folder)
    first = cache.load(spark, folder)
    assert first.meta["entry_count"] == 20 and cache.load(spark, folder, "v0") is None
    cache.save(first.entries.filter("vec_id < 5"), folder)  # read from the folder itself
    assert cache.load(spark, folder).index.count() == 5 * 16 and cache.generations(spark, folder) == [0, 1]
    again = cache.append(cache.load(spark, folder), signed.filter("vec_id >= 5"))
    again = cache.replace(again, signed.filter("vec_id = 3").withColumn("signature", F.lit("f" * 64)), signed.filter("vec_id in (4, 999)"))
    assert again.meta["entry_count"] == 19 and again.entries.filter("vec_id = 3").first().signature == "f" * 64
    assert {r["count"] for r in again.index.groupBy("vec_id").count().collect()} == {16}
    (tmp_path / "c" / "g2").mkdir()
    assert cache.generations(spark, folder) == [0, 1]  # a write that broke off
    (tmp_path / "c" / "g1" / "meta").unlink()
    (tmp_path / "c" / "g1" / ".meta.crc").unlink(missing_ok=True)
    (tmp_path / "c" / "g1" / "meta").write_text('{"schema_version": 99, "signature_version": "v1"}')
    assert cache.load(spark, folder) is None
    (tmp_path / "c" / "g1" / "meta").write_text("no json")
    with pytest.raises(ValueError, match="corrupt"):
        cache.load(spark, folder)


def test_paged_feed_and_sync(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()

    def write(entries):
        for k in range(2):
            (pages / f"{k + 1}.json").write_text(json.dumps({"page": k + 1, "total_pages": 2, "total_count": len(entries), "threat_feeds": entries[k::2]}))

    entry = lambda u, day, sig: {"uuid": u, "title": u, "updated_at": day, "detection_signatures": [{"version": "v1", "signature": sig * 64}]}
    write([entry("a", "2024-01-01", "1"), entry("b", "2024-01-02", "2"), {"uuid": "n", "title": "none"}])
    read = lambda: feed.read_feed(spark, folder=str(pages))
    assert sorted(r.uuid for r in read().collect()) == ["a", "b", "n"]
    assert feed.entry_of(read(), "b").first().title == "b"
    with pytest.raises(KeyError):
        feed.entry_of(read(), "x")
    folder = str(tmp_path / "corpus")
    assert tuple(cache.sync(read(), folder).first()) == (2, 0, 2)
    write([entry("a", "2024-01-03", "3"), entry("b", "2024-01-02", "2"), entry("c", "2024-01-04", "4")])
    assert tuple(cache.sync(read(), folder).first()) == (1, 2, 3)
    assert {r.uuid: r.signature[0] for r in cache.load(spark, folder).entries.collect()} == {"a": "3", "b": "2", "c": "4"}
    write([entry("z", "2020-01-01", "5")])
    assert tuple(cache.sync(read(), folder, full=True).first()) == (1, 0, 1)


def test_prompt_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"results": [{"prompt": " ", "text": " b "}, {"title": "a"}, 7, {"x": 1}, "c"], "other": 1}))
    (tmp_path / "b.json").write_text(json.dumps(["a", "d"]))
    got = feed.read_prompts(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r.place, r.text) for r in got] == [(0, "b"), (1, "a"), (2, "c"), (3, "d")]
    assert feed.read_prompts(spark, str(tmp_path), limit=2).count() == 2
    (tmp_path / "c.json").write_text('{"unknown": []}')
    with pytest.raises(Exception, match="list of prompts"):
        feed.read_prompts(spark, str(tmp_path)).collect()


def test_blocked_state_over_batches(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "vec_id long, signature string, suspicious boolean"
    flip = lambda n: f"{(1 << n) - 1:064x}"  # noqa: E731  n low bits set
    run = lambda: {r.vec_id: r.why for r in sync.block_stream(spark.readStream.schema(schema).parquet(source), 0.95, folder=folder).collect()}
    # within 25 bits of a blocked one: 2 of 1, 3 of 2 but not of 1; 4 comes before the row that would block it
    spark.createDataFrame([(1, flip(0), True), (2, flip(20), False), (3, flip(40), False), (4, flip(120), False), (9, None, False)], schema).write.parquet(source)
    assert run() == {1: "classifier", 2: "state", 3: "state"}
    spark.createDataFrame([(10, flip(60), False), (11, flip(120), True), (12, flip(140), None), (13, None, True)], schema).write.mode("append").parquet(source)
    assert run() == {1: "classifier", 2: "state", 3: "state", 10: "state", 11: "classifier", 12: "state", 13: "classifier"}
    assert len(sync.versions(spark, folder)) == 2


def test_exact_cosine_equals_plain(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 5))
    x[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [1.0])]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = corpus.filter("vec_id in (0, 7, 99)").withColumnRenamed("vec_id", "query_id")
    u = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    c = u @ u.T
    found = search.exact_cosine(asked, corpus, threshold=0.2).collect()
    assert {(r.query_id, r.vec_id) for r in found} == {(q, int(i)) for q in (0, 7) for i in np.flatnonzero(c[q] >= 0.2)}
    best = search.exact_cosine(asked, corpus, k=4).filter("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in best] == np.argsort(-c[0], kind="stable")[:4].tolist()
    with pytest.raises(ValueError, match="queries"):
        search.exact_cosine(spark.range(search.MAX_QUERIES + 1).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("embedding")), corpus, k=1)
