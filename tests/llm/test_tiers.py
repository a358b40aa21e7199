"""The context sizes of packing have an effect."""

import random

import numpy as np
import pytest

from palimpsest.llm import packing as P


def lengths(seed, n=400):
    r = random.Random(seed)
    return [r.choice([5, 20, 60, 110, 200, 300, 440, 500, 880, 950, 1500, 1790]) for _ in range(n)]


def test_routing_changes_the_result():
    """Best fit by falling length is what a single context of sorted items would give; with contexts the windows are others."""
    for seed in range(20):
        x = lengths(seed)
        tiers, flat = P.pack(x, 1800), P.pack(x, 1800, (1800,))
        assert tiers != flat
        assert len(tiers) <= len(flat) * 1.02 + 1
        assert sum(sum(p[2] for p in w) for w in tiers) == sum(x)


def test_every_window_fits_its_context_without_joining():
    sizes = P.contexts(1800)
    assert sizes == (1800, 900, 450, 225)
    windows = P.pack(lengths(3), 1800, sizes, join=False)
    used = {sizes[P.tier_of(sum(p[2] for p in w), sizes)] for w in windows}
    assert len(used) > 1
    joined = P.pack(lengths(3), 1800, sizes)
    assert len(joined) < len(windows) and all(sum(p[2] for p in w) <= 1800 for w in joined)


def test_long_windows_are_filled_from_shorter_tiers():
    windows = P.pack([1500, 100, 200, 300, 1500], 1800)
    # the tier of 300 comes before that of 100 and 200
    assert windows == [[(0, 0, 1500), (3, 0, 300)], [(1, 0, 100), (2, 0, 200), (4, 0, 1500)]]


def test_windows_list_their_items_in_order():
    for seed in range(5):
        windows = P.pack(lengths(seed), 1800)
        assert all(w == sorted(w) for w in windows) and windows == sorted(windows)
    # equal items of one tier stay neighbours
    assert P.pack([200] * 8, 1800, (1800, 450)) == [[(i, 0, 200) for i in range(8)]]
    assert P.pack([100, 200, 100, 200, 100], 1800, (1800, 300), join=False) == [[(0, 0, 100), (1, 0, 200)], [(2, 0, 100), (3, 0, 200)], [(4, 0, 100)]]


@pytest.mark.parametrize("seed", range(5))
def test_close_to_the_bound(seed):
    x = lengths(seed, 3000)
    assert len(P.pack(x, 1800)) <= 1.03 * -(-sum(x) // 1800) + 1


def test_step_groups_are_unique_and_even(spark):
    rows = [(v, 1000 * v + i, i, n) for v in range(30) for i, n in enumerate(lengths(v, 120))]
    df = spark.createDataFrame(rows, "v bigint, id bigint, place bigint, n int")
    out = P.pack_sequences(df, "v", "id", "place", "n", 1800).toPandas()
    sizes = out.groupby("step_group").size()
    assert sizes.max() <= P.GROUP
    assert (out.groupby("step_group").context.nunique() == 1).all()
    assert out.groupby("step_group").seq.nunique().max() > 1  # groups reach over sequences
    full = out[out.context == 1800].groupby("step_group").filled.agg(["sum", "size"])
    even = full[full["size"] == P.GROUP]["sum"]
    assert even.max() - even.min() <= 1800
    short = P.pack_sequences(df, "v", "id", "place", "n", 1800, (1800, 600), join=False).toPandas()
    assert set(short.context) == {1800, 600} and (short.unused == short.context - short.filled).all()


def test_no_list_is_unbounded(spark, monkeypatch):
    rows = [(1, i, None, 100) for i in range(30_000)] + [(2, 50_000 + i, 7, 100) for i in range(30_000)]
    df = spark.createDataFrame(rows, "v bigint, id bigint, place bigint, n int")
    out = P.pack_sequences(df, "v", "id", "place", "n", 1800).toPandas()
    assert sorted(i for x in out.item_ids for i in x) == sorted(r[1] for r in rows)
    assert out[out.seq == 1].stretch.nunique() == 4 and out[out.seq == 2].portion.max() >= 2
    assert np.isclose(out.filled.sum(), 6_000_000)
