import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathlume.llm.packing import container_use, cost, pack, pack_sizes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200), st.integers(100, 300))
def test_containers_are_never_overfull_and_items_never_overlap(sizes, capacity):
    sizes = np.array(sizes, dtype=np.int64)
    at, offset = pack_sizes(sizes, capacity)
    for c in set(at):
        own = sorted(zip(offset[at == c], sizes[at == c]))
        assert own[0][0] == 0 and all(a + s == b for (a, s), (b, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= capacity


def test_little_space_stays_unused_and_cost_is_balanced():
    sizes = np.random.default_rng(1).lognormal(4.5, 1.0, 20_000).astype(int).clip(1, 4096)
    at, _ = pack_sizes(sizes, 4096)
    assert sizes.sum() / ((at.max() + 1) * 4096) > 0.98
    costs = pd.Series(cost(sizes)).groupby(at).sum()
    assert costs.quantile(0.95) / costs.quantile(0.05) < 1.6


def rows(spark, *sizes):
    return spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, n long, cost string")


@pytest.mark.parametrize("shard_items", [3, 1000])
def test_every_item_is_whole_in_its_pieces(spark, shard_items):
    sizes = [5, 0, None, 100, 101, 250, 1, 99, 100, 3] * 5
    got = pack(rows(spark, *sizes), "doc_id", "n", 100, shard_items)
    out = got.toPandas()
    assert out.groupby("doc_id")["piece_size"].sum().to_dict() == {i: s or 0 for i, s in enumerate(sizes)}
    assert out[out["n_pieces"] > 1]["doc_id"].nunique() == 10  # only items above the capacity are cut
    assert out[out["piece_size"] == 0]["container_id"].isna().all() and out[out["piece_size"] > 0]["container_id"].notna().all()
    assert out.groupby("container_id")["piece_size"].sum().max() <= 100
    use = container_use(got, 100).toPandas()
    assert (use["used"] + use["unused"] == 100).all() and use["used"].sum() == sum(s or 0 for s in sizes)


def test_edges(spark):
    assert pack(rows(spark).limit(0), "doc_id", "n").count() == 0
    assert pack(spark.createDataFrame([(1, 7), (1, 7)], "doc_id long, n long"), "doc_id", "n", 10).count() == 2
    with pytest.raises(Exception, match="negative"):
        pack(rows(spark, -1), "doc_id", "n").collect()
    with pytest.raises(ValueError):
        pack(rows(spark, 1), "doc_id", "n", capacity=0)
    with pytest.raises(ValueError):
        pack(rows(spark, 1).withColumnRenamed("doc_id", "shard"), "shard", "n")


def plainly(sizes, capacity):
    need = max(1, -(-int(sizes.sum()) // capacity))
    room, load, out = [capacity] * need, [0.0] * need, [None] * len(sizes)
    for i in np.argsort(-sizes, kind="stable"):
        fits = [(load[c], c) for c in range(len(room)) if room[c] >= sizes[i]]
        if not fits:
            room.append(capacity)
            load.append(0.0)
        where = min(fits)[1] if fits else len(room) - 1
        out[i] = (where, capacity - room[where])
        room[where] -= sizes[i]
        load[where] += cost(int(sizes[i]))
    return out


def test_the_tree_finds_what_a_look_at_all_containers_finds():
    for seed in range(25):
        rng = np.random.default_rng(seed)
        capacity = int(rng.integers(1, 60))
        sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 120)))
        assert list(zip(*(x.tolist() for x in pack_sizes(sizes, capacity)))) == plainly(sizes, capacity)


def test_long_items_and_many_pieces_are_no_work_for_the_packer(spark):
    began = time.time()
    at, _ = pack_sizes(np.random.default_rng(1).integers(1, 4097, 60_000), 4096)
    assert time.time() - began < 60 and len(at) == 60_000
    items = spark.range(20).selectExpr("id % 10 as id", "40961000L + id % 2 as size", "'x' as other")  # repeated rows, 10,000 pieces each
    packed = pack(items, "id", "size")
    assert packed.count() == sum(-(-(40961000 + i % 2) // 4096) for i in range(20)) and packed.filter("piece_size < 4096").count() == 20
    use = packed.groupBy("container_id").agg({"piece_size": "sum"}).withColumnRenamed("sum(piece_size)", "used")
    assert use.filter("used > 4096").count() == 0 and use.agg({"used": "sum"}).first()[0] == sum(40961000 + i % 2 for i in range(20))
