import math

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from nearfield import registry, registry_texts
from nearfield.functions import columns as C
from nearfield.functions.hyperplanes import splitmix64
from nearfield.operators import signing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES | registry_texts.QUERIES))
def test_query_equals_sql(spark, duck, name):
    queries, sql = registry.QUERIES | registry_texts.QUERIES, registry.SQL | registry_texts.SQL
    same_rows(queries[name](spark, SF), duck.sql(sql[name]))


def test_splitmix64_published_values():
    assert int(splitmix64(0)) == 0xE220A8397B1DCDAF


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_hamming_of_unequal_lengths_and_other_characters(spark):
    for a, b, d in (("ff", "00", 8), ("f", "ff", 4), ("", "", 0), ("zz1", "1", 0), ("AB", "ab", 0)):
        assert one(spark, C.hamming_hex(F.lit(a), F.lit(b))) == d


def test_threshold_is_a_distance():
    assert [C.largest_distance(t) for t in (0.95, 0.9, 0.85, 0.7, 0.5, 0.3)] == [25, 36, 45, 64, 85, 103]
    assert math.isclose(math.cos(math.pi * 45 / 256), 0.8513, abs_tol=1e-3)


def test_embedding_digest(spark):
    import hashlib

    v = F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 1.0, -0.5, 0.00001)])
    assert one(spark, C.embedding_sha256(v)) == hashlib.sha256(b"[0.1, 0.2, 0.3, 1.0, -0.5, 0.00001]").hexdigest()


def test_parse_and_preview(spark):
    assert one(spark, C.parse_signature(F.lit("0din-v1:00ff")))["signature"] == "00ff"
    assert one(spark, C.parse_signature(F.lit("0din-v2:00ff"))) is None
    assert len(one(spark, C.preview(F.lit("x" * 51)))) == 50


@pytest.mark.parametrize("n,expected", [(0, [0]), (510, [510]), (511, [510, 51]), (971, [510, 510, 51])])
def test_windows(spark, n, expected):
    tokens = F.when(F.lit(n) > 0, F.sequence(F.lit(1), F.lit(max(n, 1)))).otherwise(F.array().cast("array<int>"))
    assert [len(w) for w in one(spark, C.windows(tokens))] == expected


def test_signature_of_null_and_zero_vectors(spark):
    e = spark.createDataFrame([(1, None), (2, [0.0] * 8)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.signature for r in signing.sign(e).collect()}
    assert got == {1: None, 2: "0" * 64}
