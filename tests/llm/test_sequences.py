"""Packing, mixing, sharding and top-k against plain Python on whole small tables and on awkward rows."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from proofloom.llm import mixing, packing, queries, sharding, topk
from proofloom.llm.common import table

AWKWARD = [(1, None, None, "x"), (2, "", "b", "x"), (3, "one two", "b", "y"), (3, "one two", "b", "y"), (None, "three", None, None), (5, "a b " * 6000, "a", "z"), (6, "a b  \t ć É <|endoftext|>x", "c", "z")]
KINDS = "doc_id long, text string, source string, _block string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, KINDS)


def order(rows):
    return sorted(map(str, rows))


def whole(text, tokenizer):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def packed(rows, docs):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for doc, text in docs:
        ids = np.array(whole(text, tokenizer), "<u4")
        want += [(doc, k, s, len(p := ids[s : s + 4096]), zlib.crc32(p.tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r[:5]) for r in rows), key=key) == sorted(want, key=key)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for xs in held.values():
        at = 0
        for offset, length in sorted(xs):
            assert offset == at
            at += length
        assert at <= 4096
    return len(held), -(-sum(w[3] for w in want) // 4096)


def test_packing_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    used, least = packed(queries.op3_best_fit_packing(spark, sf_dir).collect(), docs)
    assert used <= least + 1


def test_packing_awkward_rows(awkward):
    rows = packing.pack_documents(awkward, queries.tokenizer_path()).collect()
    packed(rows, [(r[0], r[1]) for r in AWKWARD])


def test_packing_empty_table(awkward):
    assert packing.pack_documents(awkward.limit(0), queries.tokenizer_path()).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(4096, (rng.lognormal(6, 1.2 + 0.1 * seed, 3000) + 1).astype(int))
    if seed == 5:
        lengths[:1000] = 1500  # one length of a third of all pieces
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan = packing.plan(counts)
    seen = defaultdict(set)
    for x in plan:
        assert sum(i[0] for i in x.items) + x.room == 4096
        for length, rank, _ in x.items:
            assert not seen[length] & (own := set(range(rank, rank + x.count)))
            seen[length] |= own
    assert {k: len(v) for k, v in seen.items()} == counts
    least = -(-int(lengths.sum()) // 4096)
    assert sum(x.count for x in plan) <= least * (1.15 if seed == 5 else 1.02) + 1


def test_mixing_whole_table(spark, sf_dir):
    rows = queries.op4_mixing(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in table(spark, sf_dir, "documents").collect()}
    size = {k: len((r.text or "").encode().split()) for k, r in docs.items()}
    assert {r.doc_id: r.size for r in rows} == size
    sums, took, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        s = docs[r.doc_id].source
        sums[s] += r.size
        took[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert all(r.source_size == sums[docs[r.doc_id].source] for r in rows)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sums.values()))
    names = sorted(sums)
    free = [s for s in names if target[s] < 2 * sums[s]]
    per = {target[s] / (3, 1, 2)[names.index(s) % 3] for s in free}
    assert max(per) - min(per) < 1e-6 * max(per)
    assert all(2 * sums[s] <= max(per) * (3, 1, 2)[names.index(s) % 3] + 1e-6 for s in names if s not in free)
    assert all(abs(took[s] - target[s]) <= 1 for s in names)
    assert order(rows) == order(queries.op4_mixing(spark, sf_dir).collect())


def test_mixing_draws_are_disjoint_and_balanced(spark, sf_dir):
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"), shards=4, blocks=32)
    rows = mixing.draws(plan).collect()
    assert len({(r.doc_id, r.turn) for r in rows}) == len(rows)
    assert sum(r.words for r in rows) == sum(r.taken for r in mixing.taken(plan).collect())
    assert {r.shard for r in rows} == {0, 1, 2, 3}


def test_splitting_tree_adds_up():
    quotas = np.array([7, 0, 120, 33])
    out = mixing.split_tree(quotas, 5, np.random.default_rng(1))
    assert (out.sum(0) == quotas).all() and (out >= 0).all()
    assert out.sum(1).max() - out.sum(1).min() <= 2


def test_mixing_awkward_rows(awkward):
    rows = mixing.taken(mixing.plan_mix(awkward)).collect()
    assert len(rows) == len(AWKWARD)
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode().split()) for _, t, _, _ in AWKWARD)
    assert mixing.taken(mixing.plan_mix(awkward.limit(0))).collect() == []


def check_shards(rows, docs, shards=40):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    rows = queries.op5_sharding(spark, sf).collect()
    check_shards(rows, docs)
    load, at, groups = defaultdict(int), {r.doc_id: r.shard for r in rows}, defaultdict(list)
    for r in rows:
        load[r.shard] += r.size
    mean = sum(load.values()) / 40
    assert max(load.values()) <= 1.05 * mean and min(load.values()) >= 0.95 * mean
    for d, t in docs:
        groups[t].append(at[d])
    links = [len(set(g)) == 1 for g in groups.values() if len(g) > 1]
    assert sum(links) >= 0.9 * len(links)


def test_sharding_hot_group_and_awkward_rows(spark, awkward):
    check_shards(sharding.shard(awkward).collect(), [(r[0], r[1]) for r in AWKWARD])
    assert sharding.shard(awkward.limit(0)).collect() == []
    docs = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(900)]
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string"), shards=5).collect()
    check_shards(rows, docs, 5)
    load = defaultdict(int)
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) <= 1.1 * min(load.values())


def brute(rows, k, asked):
    rows = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in rows:
        if q in asked:
            hits = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(hits, 1)]
    return sorted(out)


def test_top_k_over_many_shards(spark, sf_dir):
    frame = table(spark, sf_dir, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    vectors = topk.quantised(frame)
    for size in (8192, 60):
        got = topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 10, shard_rows=size, query_rows=7).collect()
        assert sorted(map(tuple, got)) == brute(rows, 10, {i for i, _ in rows if i % 20 == 0})


def test_top_k_ties_and_awkward_rows(spark):
    rows = [(i, [0.5, 0.25]) for i in range(40)] + [(100, [float("nan"), 1.0]), (101, None), (102, [1.0, None]), (103, [float("inf"), 0.0]), (104, [-1.0, 0.1]), (200, [0.5, 0.25, 0.125])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, shard string")
    vectors = topk.quantised(frame)
    for size in (8192, 8):
        got = topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10, shard_rows=size).collect()
        assert sorted(map(tuple, got)) == brute(rows, 10, {0, 200})
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).collect() == []


def test_top_k_over_a_thousand_shards_and_repeated_ids(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.integers(0, 1500, 2048), rng.normal(size=(2048, 4)).astype(np.float32), strict=True)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    asked = vectors.filter("vec_id % 50 = 0")
    got = topk.top_k(vectors, asked, 5, shard_rows=2).collect()
    least = {}
    for q, v in brute_rows(rows):
        if q % 50 == 0:
            least[q] = min(least.get(q, v), v)
    want = []
    for q, v in least.items():
        hits = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in brute_rows(rows) if i != q)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(hits, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def brute_rows(rows):
    return [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows]


def test_kd_tree_leaves_out_most_of_clustered_vectors():
    rng = np.random.default_rng(3)
    points = np.floor(1024 * (rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)] + 0.01 * rng.normal(size=(4000, 8))))
    tree = topk.KDTree(np.arange(4000), points, leaf=32)
    for q in range(0, 4000, 500):
        want = sorted(((-float(s), i) for i, s in enumerate(points @ points[q]) if i != q))[:10]
        assert [(-s, -i) for s, i in tree.search(points[q], q, 10, (float("-inf"), float("-inf")))] == want
