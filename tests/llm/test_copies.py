"""op5, op10 and the near-copy stage against plain code."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from nearfield.llm import simhash, suffix


def plain_repeats(data):
    """(removed, SHA-256 of the rest) of each text by counting every string of 200 bytes."""
    seen = Counter(b[p : p + 200] for b in data for p in range(len(b) - 199))
    for b in data:
        mark = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                mark[p : p + 200] = b"\1" * 200
        yield sum(mark), hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest()


@pytest.mark.parametrize("n, limit", [(5000, suffix.GROUP_LIMIT), (600, 7)])
def test_many_surroundings_of_one_passage(spark, monkeypatch, n, limit):
    rng = random.Random(1)
    noise = lambda: "".join(rng.choices("abc ", k=rng.randrange(60, 250)))
    long, short = ("".join(rng.choices("abcdefgh ", k=k)) for k in (230, 150))
    texts = [noise() + long + noise() for _ in range(n)] + [noise() + short + noise() for _ in range(n // 4)] + ["q" * 450, "q" * 199, "", "\0" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffix.repeated_starts, "__defaults__", (suffix.LENGTH, limit))
    got = {r.doc_id: (r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix.remove_repeats(docs).collect()}
    assert got == dict(enumerate(plain_repeats([t.encode() for t in texts])))


def test_family_levels_equal_counts():
    rng = random.Random(2)
    pieces = [(k, bytes(rng.choices(b"ab", k=rng.randrange(8, 30)))) for k in range(60)]
    family = suffix.Family(8)
    for at in range(0, 60, 5):
        family.add(pieces[at : at + 5])
    seen = Counter(b[p : p + 8] for _, b in pieces for p in range(len(b) - 7))
    got = {(k, o + j) for k, o, n in zip(*(x.tolist() for x in family.hits()), strict=True) for j in range(n)}
    assert got == {(k, p) for k, b in pieces for p in range(len(b) - 7) if seen[b[p : p + 8]] > 1}
    sizes = [len(x) for x, _, _ in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def plain_fingerprint(text):
    lower = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    w = [x for x in lower.translate(bytes(32 if c in b" \t\n\x0b\f\r" else c for c in range(256))).split(b" ") if x]
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if root[i] != root[j] and linked(i, j):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return root


def test_op10_equals_plain_code(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    root = components(len(ids), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_bit_sliced(spark, sf).collect()}
    assert got == {i: (f"{f:016x}", ids[r]) for i, f, r in zip(ids, fps, root, strict=True)}


def test_fingerprints_of_awkward_texts(spark):
    texts = [None, "", " \n", "A", "Ünder ÄB a b c", "x\x85y z", "a\x0bb\x0cc d e f", "W " * 70_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fp[0] % 2**64 for r in simhash.near_duplicates(rows).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("nodes, k", [(10, 1), (1 << 29, 2), (1 << 36, 3)])
def test_every_close_pair_shares_a_mask(nodes, k):
    tables = simhash.masks(4, nodes)
    rng = random.Random(3)
    assert len(tables) == {1: 5, 2: 15, 3: 35}[k]
    for _ in range(200):
        difference = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & difference for m in tables)


def test_hot_buckets_that_nothing_splits(spark):
    # fingerprints in a small ball: split at each level, then dealt in parts
    rng = random.Random(4)
    fps = sorted({sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(120)})
    marked = spark.createDataFrame([(i, [f - (1 << 64) if f >> 63 else f]) for i, f in enumerate(fps)], "doc_id long, fp array<bigint>")
    got = {r.doc_id: r.component_id for r in simhash.cluster(marked, simhash.Spec(), 3).collect()}
    assert got == dict(enumerate(components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)))


def shingle_sets(texts):
    for t in texts:
        w = (t or "").lower().split()
        yield frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_recall_of_near_copies_on_documents(spark):
    """All pairs of sf0.01 whose sets of five-word shingles are 0.8 similar, against the classes."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())
    sets = list(shingle_sets(t for _, t in rows))
    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    both = Counter((i, j) for held in by.values() for x, j in enumerate(held) for i in held[:x])
    links = {p for p, n in both.items() if 5 * n >= 4 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    different = [(i, j) for i, j in links if sets[i] != sets[j]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.root for r in simhash.near_duplicates(docs, simhash.NEAR_COPIES).collect()}
    met = [found[rows[i][0]] == found[rows[j][0]] for i, j in different]
    assert len(met) > 10 and np.mean(met) >= 0.99
    blank = {i for i, s in enumerate(sets) if not s}
    root = components(len(rows), lambda i, j: (j, i) in links or {i, j} <= blank)
    assert len(set(found.values())) - len(set(root)) <= 0.01 * len(different)
    assert all(root[i] == root[j] for i in range(len(rows)) for j in range(i) if found[rows[i][0]] == found[rows[j][0]])


def test_large_candidate_groups_and_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COMPARED", 3)
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(i, " ".join(words[: 190 + i])) for i in range(10)], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(docs, simhash.NEAR_COPIES, bucket_limit=2).collect()} == {0}


def test_components_of_a_hub_and_a_chain(spark):
    from nearfield.llm.components import connected_components

    links = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5, 5), (7, 0)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(300), 0), **dict.fromkeys(range(1000, 1201), 1000)}
