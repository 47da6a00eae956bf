"""The filter ahead of the verification of near copies."""

from __future__ import annotations

import numpy as np

from barloom.llm import near_copies, simhash


def test_bit_maps_lose_no_near_pair():
    rng = np.random.default_rng(3)
    far = 0
    for n in [*range(1, 40), *range(120, 135), 250, 260, 1000, 1030]:
        for share in (1.0, 0.95, 0.9, 0.5, 0.0):
            for m in (n, int(n * 0.9) or 1, int(n * 1.2) + 1):
                common = int(share * min(n, m))
                x, y = rng.integers(-(1 << 62), 1 << 62, n), rng.integers(-(1 << 62), 1 << 62, m)
                y[:common] = x[:common]
                may = near_copies.may_be_near(n, near_copies.bit_map(x), m, near_copies.bit_map(y))
                assert may or common * 9 < (n + m) * 4
                far += not may
    assert far > 100


def test_families_are_compared_whole(spark, monkeypatch):
    """A large family whose members are near some of the others only, against all pairs."""
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        for at in rng.integers(20, 120, rng.integers(0, 7)):
            words[at] = f"x{k}y{at}" if rng.random() < 0.5 else f"z{at}"
        rows.append((k, " ".join(words)))
    rows += [(200 + k, " ".join(base[:20]) + " " + " ".join(f"o{k}p{i}" for i in range(100))) for k in range(20)]
    sets = {d: set(near_copies.shingles(t.encode()).tolist()) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d in sets:
        for e in sets:
            both = len(sets[d] & sets[e])
            if d < e and 5 * both >= 4 * (len(sets[d]) + len(sets[e]) - both):
                parent[root(e)] = root(d)
    got = {r.doc_id: r.root for r in near_copies.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    same = lambda of: {frozenset(d for d in sets if of(d) == of(e)) for e in sets}
    assert same(got.get) == same(root) and len(same(root)) > 25


def test_fingerprints_link_texts_of_the_stage(spark):
    """Texts within two bits are one group of the stage even if their 5-word shingles differ."""
    base = " ".join(f"w{i}" for i in range(41))
    rows = [(k, (base + " ") * 150 + " ".join(f"t{k}x{i}" for i in range(30))) for k in range(3)] + [(7, "something else that nobody has a copy of")]
    prints = [simhash.fingerprint(t.encode()) for _, t in rows]
    assert all((p ^ prints[0]).bit_count() <= 2 for p in prints[:3])
    sets = [set(near_copies.shingles(t.encode()).tolist()) for _, t in rows]
    assert 5 * len(sets[0] & sets[1]) < 4 * len(sets[0] | sets[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({r.root for r in near_copies.components(df).collect()}) == 4
    assert sorted(r.doc_id for r in simhash.deduplicated(df).collect()) == [0, 7]


def test_families_make_rows_in_proportion_to_members(spark, monkeypatch):
    """A family whose pairs are too close for the bit maps and mostly apart by the sets: no step makes its pairs."""
    made, whole = [], near_copies.checkpointed

    def counting(df):
        out = whole(df)
        if {"a", "b"} <= set(out.columns):
            made.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "checkpointed", counting)
    rng = np.random.default_rng(8)
    rows = []
    for k in range(240):
        words = [f"w{i}" for i in range(150)]
        for at in (30, 90):
            words[at + int(rng.integers(0, 40))] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    sets = [set(near_copies.shingles(t.encode()).tolist()) for _, t in rows]
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for k in range(i):
            if root[k] != root[i] and 5 * len(x & sets[k]) >= 4 * len(x | sets[k]):
                root = [root[k] if r == root[i] else r for r in root]
    got = [r.root for r in near_copies.components(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert len(set(got)) == len(set(root)) == len(set(zip(got, root, strict=True)))
    assert made and max(made) < 4 * len(rows)


def test_bit_maps_of_many_members_say_what_those_of_two_say():
    rng = np.random.default_rng(1)
    pool = rng.integers(-(1 << 62), 1 << 62, 600)
    sets = [np.unique(np.concatenate([pool[: k * 3 // 2], rng.integers(-(1 << 62), 1 << 62, int(k * rng.random()))])) for k in range(1, 120)]
    sizes, data = np.array([len(s) for s in sets]), [near_copies.bit_map(s) for s in sets]
    many, others = near_copies.may_be_near_to(sizes, data), np.arange(len(sets))
    two = [[near_copies.may_be_near(int(n), x, int(m), y) for m, y in zip(sizes, data, strict=True)] for n, x in zip(sizes, data, strict=True)]
    assert [many(v, others).tolist() for v in others] == two
    assert 0 < sum(map(sum, two)) < len(sets) ** 2
