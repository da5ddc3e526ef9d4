import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import registry, registry_texts
from nearfield.functions.dual import Calibrator
from nearfield.operators import blocks, dual, search, signing

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def hashes(n, seed):
    """Dual hashes near two centres, copies among them, and one that is sure of nothing."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2, size=(2, 512)).astype(bool)
    a = centres[rng.integers(0, 2, size=n)] ^ (rng.random((n, 512)) < rng.choice([0.002, 0.02, 0.2, 0.45], size=(n, 1)))
    b = rng.random((n, 512)) < 0.55
    a[1], b[1], b[2] = a[0], b[0], False
    return a, b


def plain_pairs(keys, a, b, n, threshold, calibrate, gone=lambda key, band: False):
    out = {}
    for i, p in enumerate(keys):
        for j, q in enumerate(keys):
            pieces = [k for k in range(n) if not (gone(p, k) or gone(q, k))]
            cut = lambda x, k: x[k * (512 // n) : (k + 1) * (512 // n)]
            if p < q and any((cut(a[i], k) == cut(a[j], k)).all() for k in pieces):
                same, sure = a[i] == a[j], b[i] & b[j]
                raw = 0.65 * int(same[sure].sum()) / int(sure.sum()) + (1 - 0.65) * (int(same.sum()) / 512.0) if sure.any() else same.sum() / 512.0
                s = float(calibrate.of(np.array([raw]))[0])
                if s >= threshold:
                    out[p, q] = max(s, out.get((p, q), 0))
    return {(p, q, s) for (p, q), s in out.items()}


def index_of(spark, keys, a, b, n, kind="long"):
    hex_of = lambda x: np.packbits(x).tobytes().hex()
    return dual.dual_index(spark.createDataFrame([(k, hex_of(x), hex_of(y)) for k, x, y in zip(keys, a, b, strict=True)], f"vec_id {kind}, hash_a string, hash_b string"), n)


@pytest.mark.parametrize("n", [4, 8, 16, 32, 64, 128])
def test_dual_pairs_equal_plain_pairs_in_several_groups(spark, monkeypatch, n):
    monkeypatch.setattr(dual, "groups_of", lambda n: 5)
    a, b = hashes(60, n)
    got = dual.dual_pairs(index_of(spark, range(60), a, b, n), 0.6)
    assert {tuple(r) for r in got.collect()} == plain_pairs(range(60), a, b, n, 0.6, Calibrator()) and got.count() > 10


def test_dual_pairs_of_some_bands_of_text_keys_with_several_hashes(spark, monkeypatch):
    monkeypatch.setattr(dual, "groups_of", lambda n: 3)
    monkeypatch.setattr(dual, "TILE", (7, 11))
    a, b = hashes(60, 9)
    keys, calibrate = [f"k{i % 45:02}" for i in range(60)], Calibrator((0.2, 0.5, 0.9), (0.1, 0.7, 0.8))
    gone = lambda key, band: band > 3 + int(key[1:]) % 9
    index = index_of(spark, keys, a, b, 64, "string").filter(F.col("band") <= 3 + F.substring("vec_id", 2, 2).cast("int") % 9)
    got = dual.dual_pairs(index.unionAll(index), 0.65, calibrate).collect()
    assert len(got) == len({(r.x, r.y) for r in got}) > 20
    assert {tuple(r) for r in got} == plain_pairs(keys, a, b, 64, 0.65, calibrate, gone)


@pytest.mark.parametrize("joined", [0, 16, 10**9])
def test_rare_pieces_are_joined_by_band(spark, monkeypatch, joined):
    monkeypatch.setattr(dual, "JOINED", joined)
    a, b = hashes(60, 7)
    got = dual.dual_pairs(index_of(spark, range(60), a, b, 32), 0.6)
    assert ("Join" in plan_of(got)) == (joined == 0)
    assert {tuple(r) for r in got.collect()} == plain_pairs(range(60), a, b, 32, 0.6, Calibrator())


def test_copies_share_only_the_bands_that_each_has(spark, monkeypatch):
    monkeypatch.setattr(dual, "JOINED", 0)
    a, b = hashes(3, 2)
    a[2] = ~a[0]
    a[2, :16], b[:] = a[0, :16], True
    index = index_of(spark, range(3), a, b, 32)
    assert {tuple(r)[:2] for r in dual.dual_pairs(index, 0.0).collect()} == {(0, 1), (0, 2), (1, 2)}
    assert {tuple(r)[:2] for r in dual.dual_pairs(index.filter("vec_id <> 1 or band > 0"), 0.0).collect()} == {(0, 1), (0, 2)}


def test_dual_pairs_shuffles_hashes_and_no_pairs(spark):
    plan = plan_of(registry.dual_pairs(spark, SF))
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Repartition") == 1


def test_no_pairs(spark):
    a, b = hashes(3, 1)
    assert dual.dual_pairs(index_of(spark, [1], a[:1], b[:1], 64), 0.0).collect() == []
    assert dual.dual_pairs(index_of(spark, range(3), a, b, 64).filter("band < 0"), 0.0).collect() == []


def test_groups_and_cuts():
    assert [blocks.groups_of(n) for n in (0, 1, 1023, 1024, 50_000, 200_000, 10**6)] == [1, 1, 1, 2, 16, 25, 123]
    assert blocks.cuts(np.array([0, 0, 0, 1, 2, 2, 3]), 2) == [(0, 4), (4, 6), (6, 7)]
    assert blocks.cuts(np.arange(5), 2) == [(0, 2), (2, 4), (4, 5)]


@pytest.mark.parametrize("n,threshold", [(64, 0.3), (60, 0.6), (16, 0.5), (4, 0.0)])
def test_lookup_quality_equals_joined_lookup(spark, monkeypatch, n, threshold):
    """Near copies, a null, a zero vector, other lengths, and a key that is there twice."""
    monkeypatch.setattr(search, "ROWS", 4)
    monkeypatch.setattr(search, "groups_of", lambda n: 3)
    monkeypatch.setattr(search, "TILE", (3, 7))
    rng = np.random.default_rng(n)
    base = rng.normal(size=(4, 16))
    rows = [(i, (base[i % 4] + rng.normal(size=16) * (0.1 + i % 5 / 4)).tolist()) for i in range(90)]
    rows += [(90, None), (91, [0.0] * 16), (92, [1.0, -1.0, 2.0]), (95, [1.5, -1.0, 2.0]), (50, base[0].tolist()), (10, base[1].tolist())]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = lambda d: d.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    index = signing.band_table(signing.sign(e, 2), n)
    found = search.find_similar(asked(index), index, threshold, max_results=2**31 - 1)
    pair = lambda d: d.select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"))
    want = search.quality(pair(search.exact_cosine(asked(e), e, threshold=threshold)), pair(found)).first()
    signed = e.withColumn("signatures", F.array(*[signing.simhash(F.col("embedding"), f) for f in range(2)]))
    got = search.lookup_quality(asked(signed), signed, threshold, n).first()
    assert got == want and got.tp > 50 and got.fn > 0


def test_lookup_quality_of_nothing(spark):
    signed = spark.createDataFrame([(1, None, [None])], "vec_id long, embedding array<double>, signatures array<string>")
    asked = signed.withColumnRenamed("vec_id", "query_id")
    assert tuple(search.lookup_quality(asked, signed).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_lookup_accuracy_moves_counts_of_cells_and_no_pairs(spark):
    plan = plan_of(registry_texts.lookup_accuracy(spark, SF))
    assert "Join" not in plan and "Window" not in plan and plan.count("Repartition") == 1


def test_lookup_quality_of_more_queries_than_one_matrix_holds(spark):
    """exact_cosine sends its queries to all executors, and refuses more than it can."""
    n = search.MAX_QUERIES + 1
    e = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.col("id") % 2 * 2.0 - 1.0, F.lit(0.0)).alias("embedding"))
    signed = e.withColumn("signatures", F.array(F.when(F.col("vec_id") % 2 == 0, "0" * 64).otherwise("f" * 64)))
    few = signed.filter("vec_id < 7")
    assert tuple(search.lookup_quality(signed.withColumnRenamed("vec_id", "query_id"), few, 0.5).first())[:3] == (4 * 5001 + 3 * 5000, 0, 0)
