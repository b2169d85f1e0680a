import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import codeweft.llm.packing as P


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 20), st.integers(1, 6400), st.integers(1, 30_000)), max_size=120))
def test_every_byte_once(sizes):
    capacity = 6400
    item, part, size, tier, chunk, group = P.pack(np.arange(len(sizes)), np.array(sizes, np.int64), capacity)
    sums = np.bincount(item, size, minlength=len(sizes)) if len(sizes) else []
    assert list(sums) == sizes
    fill = np.bincount(chunk, size) if len(sizes) else np.array([])
    assert (fill <= capacity).all() and (fill > 0).all()
    for i, s in enumerate(sizes):
        parts = sorted(part[item == i])
        assert parts == list(range(max(1, -(-s // capacity))))
    # no more than twice what the bytes need, and one
    assert len(fill) <= 2 * max(1, -(-sum(sizes) // capacity)) + 1
    # a chunk is in one group, and a group has GROUP chunks, a few more where windows were opened late
    assert len(set(zip(chunk.tolist(), group.tolist()))) == len(fill)


def test_tiers():
    assert P.tiers_of(np.array([6400, 1601, 1600, 401, 400, 101, 100, 26, 25, 1]), 6400).tolist() == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    item, part, size, tier, _, _ = P.pack(np.array([5, 6]), np.array([13_000, 90]), 6400)
    assert sorted(zip(item.tolist(), part.tolist(), size.tolist(), tier.tolist())) == [(0, 0, 6400, 0), (0, 1, 6400, 0), (0, 2, 200, 2), (1, 0, 90, 3)]


def test_shorter_tiers_fill_the_gaps():
    item, _, _, _, chunk, _ = P.pack(np.arange(102), np.array([70, 60] + [1] * 70 + [1] * 30), 100)
    assert chunk.max() + 1 == 3
    item, _, size, _, chunk, _ = P.pack(np.arange(1400), np.array([6000] * 400 + [20] * 1000), 6400)
    assert chunk.max() + 1 == 400


def test_groups_are_alike():
    r = np.random.default_rng(5)
    sizes = np.exp(r.uniform(0, 16, 40_000)).astype(np.int64) + 1
    item, _, size, _, chunk, group = P.pack(np.arange(len(sizes)), sizes)
    files, n_bytes = np.bincount(group), np.bincount(group, size)
    assert files.max() < 1.2 * files.min() and n_bytes.max() < 1.2 * n_bytes.min()
    assert sizes.sum() >= 0.99 * P.CAPACITY * (chunk.max() + 1)


def test_frames(spark, monkeypatch):
    t = [dt.datetime(2024, 1, d) for d in (1, 2)]
    rows = [(1, 500, t[0]), (1, 300, t[1]), (2, None, t[0]), (3, 0, t[0]), (4, 10_000_000, t[0]), (None, 5, t[0]), (5, 7, None), (6, -3, t[0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "file_id bigint, size_bytes bigint, scanned_at timestamp_ntz, chunk_no string")
    got = P.pack_files(df).collect()
    total = {}
    for r in got:
        total[r["file_id"]] = total.get(r["file_id"], 0) + r["n_bytes"]
    assert total == {1: 300, 2: 1, 3: 1, 4: 10_000_000, 5: 7, 6: 1}
    assert sorted({r["chunk_no"] for r in got}) == [1, 2, 3]
    assert P.pack_files(df.limit(0)).count() == 0
    # several shards, whose poorly filled chunks are packed again
    monkeypatch.setattr(P, "SHARD_ROWS", 50)
    many = spark.range(1000).selectExpr("id as file_id", "id * 1000 as size_bytes", "cast(null as timestamp_ntz) as scanned_at")
    packed = P.cut(P.pack_files(many))
    report, rows = P.fill_report(packed).first(), packed.collect()
    assert {r["chunk_no"] for r in rows} == set(range(1, report["n_chunks"] + 1)) and report["n_parts"] == 1000 and report["n_bytes"] == 499_500_000 + 1
    assert report["n_chunks"] <= report["fewest_chunks"] * 1.1
    assert {r["step_group"] for r in rows} == set(range(1, max(r["step_group"] for r in rows) + 1))
    assert sum(r["n_parts"] for r in P.tier_report(packed).collect()) == 1000 and sum(r["n_chunks"] for r in P.group_report(packed).collect()) == report["n_chunks"]
