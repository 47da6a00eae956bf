"""Connected components in one task and in rounds."""

from __future__ import annotations

import numpy as np

from barloom.llm import components


def graph(seed, nodes, edges):
    """Edges between random nodes, some repeated, reversed or loops, beside a long path and a star whose centre is its largest node."""
    rng = np.random.default_rng(seed)
    names = rng.integers(-(1 << 62), 1 << 62, nodes)
    rows = [(int(names[x]), int(names[y])) for x, y in rng.integers(0, nodes, (edges, 2))]
    rows += [(b, a) for a, b in rows[:20]] + rows[:5] + [(7, 7)]
    path = rng.permutation(80).tolist()
    return rows + [(1000 + a, 1000 + b) for a, b in zip(path, path[1:], strict=False)] + [(5000, 4000 + k) for k in range(60)]


def smallest(rows):
    root = {x: x for row in rows for x in row if row[0] != row[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in rows:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def test_edges_of_one_task_have_the_smallest_node_as_root():
    for seed in range(20):
        rows = graph(seed, 200, 40 + 12 * seed)
        a, b = (np.array(x, np.int64) for x in zip(*[r for r in rows if r[0] != r[1]], strict=True))
        nodes, roots = components.roots_of(a, b)
        assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == smallest(rows)
    assert all(len(x) == 0 for x in components.roots_of(np.array([], np.int64), np.array([], np.int64)))


def test_few_edges_are_joined_without_rounds_and_many_in_rounds(spark, monkeypatch):
    """Each round is four checkpoints of as many files and tasks as there are partitions, whatever the number of edges."""
    made, whole = [], components.checkpointed
    monkeypatch.setattr(components, "checkpointed", lambda df: made.append(1) or whole(df))
    rows = graph(3, 200, 100)
    df = spark.createDataFrame(rows, "a long, b long")
    got = [(r.node, r.root) for r in components.connected_components(df).collect()]
    assert dict(got) == smallest(rows) and len(got) == len(dict(got))
    assert len(made) == 1
    monkeypatch.setattr(components, "ONE_TASK", 10)
    assert {r.node: r.root for r in components.connected_components(df).collect()} == smallest(rows)
    assert len(made) > 8
