"""Best fit against a search through all open bins, and packings that depend on the rows alone."""

import numpy as np

from candleforge.llm import packing


def brute(lengths, capacities, opening):
    """Longest first; the fullest bin that has room, of equal ones the last that changed; else the bin that costs least for what can still fill it."""
    bins, where, clock = [], {}, 0  # [room, last change, used]
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    for k, i in enumerate(order):
        n, left = lengths[i], [lengths[j] for j in order[k + 1 :]]
        fits = [b for b in range(len(bins)) if bins[b][0] >= n]
        if fits:
            b = min(fits, key=lambda b: (bins[b][0], -bins[b][1]))
        else:
            price = {c: capacities[c] / (n + min(c - n, sum(x for x in left if x <= c - n))) for c in opening if c >= n}
            c = min(price, key=lambda c: (price[c], -c)) if price else min(c for c in capacities if c >= n)
            bins.append([c, 0, 0])
            b = len(bins) - 1
        clock += 1
        bins[b] = [bins[b][0] - n, clock, bins[b][2] + n]
        where[i] = b
    return [where[i] for i in range(len(lengths))], [x[2] for x in bins]


def test_best_fit_equals_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(60):
        capacities = [{16: 20.0, 32: 36.0, 64: 80.0}, {10: 10.0}, {8: 9.0, 40: 40.0}][trial % 3]
        lengths = rng.integers(1, max(capacities) + 1, rng.integers(1, 80))
        for opening in (sorted(capacities), [max(capacities)]):
            where, used = packing.best_fit(lengths, capacities, opening)
            want, total = brute(lengths.tolist(), capacities, opening)
            assert where.tolist() == want and used.tolist() == total


def bins(rows):
    found = {}
    for r in rows:
        found.setdefault(r.bin_id, []).append((str(r.doc_id), r.piece, r.piece_length, r.capacity))
    return sorted(sorted(x) for x in found.values())


def test_packing_depends_on_the_rows_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i) if i % 50 else None, int(n), 1, 2) for i, n in enumerate(rng.integers(0, 9000, 4000))]
    rows += [(7, 300, 1, 2)] * 1500 + [(8, 3_000_000, 1, 2), (9, None, 1, 2)]
    given = spark.createDataFrame(rows, "doc_id long, len long, bin_id int, piece int")
    got = [packing.pack_documents(x, packing.F.col("len"), shard_rows=1000).collect() for x in (given.repartition(3), given.orderBy("len").coalesce(1))]
    assert bins(got[0]) == bins(got[1])
    assert sum(r.piece_length for r in got[0]) == sum(max(1, r[1] or 1) for r in rows)
    assert max(len(x) for x in bins(got[0])) <= 4096 and len({r.bin_id for r in got[0]}) == len(bins(got[0]))
