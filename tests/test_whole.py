"""Queries without SQL against plain Python over whole tables."""

import os
from collections import Counter, defaultdict

import pytest

from haggleframe.plans import registry  # noqa: I001
import haggleframe.plans  # noqa: F401
from haggleframe.sources.market import listings

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def settle(rows):
    """Links of all active listings by rounds, in plain Python."""
    sold = defaultdict(list)
    for r in rows:
        if r.lifecycle == "SOLD":
            sold[r.game_id].append(r)
    pairs = defaultdict(list)
    for o in rows:
        for k in sold[o.game_id] if o.lifecycle == "ACTIVE" else []:
            diff = abs(o.price_cents - k.price_cents)
            if diff <= 10000:
                near = 32 if diff <= 500 else 26 if diff <= 2500 else 10
                pairs[o.listing_id].append((-(60 + near + 30 * (o.seller_id == k.seller_id) + 8 * (o.shipping_cents == k.shipping_cents)), k.listing_id))
    done, taken = {}, set()
    while True:
        sure = {}
        for o, found in pairs.items():
            free = sorted(p for p in found if p[1] not in taken) if o not in done else []
            if free and -free[0][0] >= 90 and free[1:2] and free[1][0] - free[0][0] >= 12 or len(free) == 1 and -free[0][0] >= 90:
                sure[o] = (free[0][1], -free[0][0])
        claims = Counter(k for k, _ in sure.values())
        new = {o: v for o, v in sure.items() if claims[v[0]] == 1}
        if not new:
            return {(o, *v) for o, v in done.items()}
        done |= new
        taken |= {k for k, _ in new.values()}


def test_all_active_listings_are_linked(spark):
    rows = listings(spark, SF).collect()
    want = settle(rows)
    assert {tuple(r) for r in registry.QUERIES["link_until_settled"](spark, SF).select("listing_id", "candidate_id", "score").collect()} == want
    seller = {r.listing_id: r.seller_id for r in rows}
    assert any(seller[o] % 5 for o, *_ in want)


def test_similar_games_compare_sets_of_attributes(spark):
    """Equal to all pairs in plain Python, ties too; and no plan pairs games by an attribute."""
    import random

    from haggleframe.plans.scout import most_alike

    r = random.Random(1)
    rows = [(i, r.choice([5.0, 6.0, None]), r.choice([["a"], ["a", "b"], ["b", "c", "a"], ["d"], [], None, [None], ["c", None]])) for i in range(120)]
    want = set()
    for q in rows[::10]:
        near = [(-len(x), x_[1] is None, -(x_[1] or 0), x_[0]) for x_ in rows if x_[0] != q[0] and (x := ({*(q[2] or [])} & {*(x_[2] or [])}) - {None})]
        want |= {(q[0], n[3], -n[0], i + 1) for i, n in enumerate(sorted(near)[:5])}
    df = spark.createDataFrame(rows, "game_id long, rating double, attrs array<string>")
    assert {tuple(x) for x in most_alike(df, "game_id % 10 = 0", 5).collect()} == want


def test_seen_in_spans_equals_brute_force(spark):
    import random

    from haggleframe.operators import scans

    r = random.Random(2)
    events = [(r.choice([None, *range(9)]), r.choice([None, *range(-50, 400)])) for _ in range(400)] + [(1, 60)] * 5
    spans = [(i, r.choice([None, *range(-60, 420)])) for i in range(80)] + [(None, 60), (100, 5000)]
    want = set()
    for i, s in spans:
        seen = [w for w, t in events if None not in (s, t) and s <= t <= s + 30]
        want |= {(i, len(seen), len({*seen} - {None}))} if seen else set()
    e, s = spark.createDataFrame(events, "w long, at long"), spark.createDataFrame(spans, "run long, start long")
    out = scans.seen_in_spans(e, s, "w", "at", "run", "start", 30, 25)
    assert {tuple(x) for x in out.collect()} == want
