import random

import pytest

from voxtree.operators.hierarchy import descendants, hierarchy

S = "neuron_id bigint, node_id int, parent_id int, loaded_at timestamp, path string, root_id string"


def brute(rows):
    """Every chain of parents, walked."""
    last = {}
    for n, i, p, t in rows:
        if n is None or i is None:
            continue
        key = (t or "", p is not None, p or 0)
        if (n, i) not in last or key > last[n, i][0]:
            last[n, i] = (key, p)
    up = {k: (v[1] if v[1] is not None and (k[0], v[1]) in last else None) for k, v in last.items()}
    out = {}
    for n, i in up:
        chain, at = [i], up[n, i]
        while at is not None and at not in chain:
            chain.append(at)
            at = up[n, at]
        if at is None:
            out[n, i] = (up[n, i], chain[-1], len(chain) - 1, None, chain[::-1])
        else:
            out[n, i] = (up[n, i], None, None, min(chain[chain.index(at) :]), None)
    return out


def sample(seed):
    rng = random.Random(seed)
    rows = []
    for n in (1, 2, 3):
        ids = rng.sample(range(1, 500), 60)
        for k, i in enumerate(ids):
            p = rng.choice([ids[k - 1] if k else None, rng.choice(ids), None, 999, -1, i]) if rng.random() < 0.5 else (ids[rng.randrange(k)] if k else -1)
            rows.append((n, i, p, f"2026-01-0{rng.randint(1, 9)} 00:00:00" if rng.random() < 0.9 else None))
            if rng.random() < 0.3:
                rows.append((n, i, rng.choice(ids), rows[-1][3] if rng.random() < 0.3 else "2026-01-05 00:00:00"))
            if rng.random() < 0.2:
                rows.append(rows[-1])
    return [*rows, (None, 1, 2, None), (4, None, 1, None), (5, 7, 7, None), (6, 1, None, None)]


@pytest.mark.parametrize("seed,block", [(1, 10**6), (2, 10**6), (3, 20)])
def test_against_walk(spark, seed, block):
    rows = sample(seed)
    df = spark.createDataFrame([(*r[:3], r[3], "p", "q") for r in rows], S.replace("loaded_at timestamp", "loaded_at string")).selectExpr("* except (loaded_at)", "cast(loaded_at as timestamp) loaded_at")
    found = hierarchy(df, paths=True, block_rows=block)
    got = {(r.neuron_id, r.node_id): r for r in found.collect()}
    want = brute(rows)
    assert {k: (r.parent_id, r.root_id, r.depth, r.cycle_id, r.path) for k, r in got.items()} == want
    for (n, i), r in got.items():
        if r.cycle_id is None:
            below = {k for k, w in want.items() if k[0] == n and w[4] and i in w[4] and k[1] != i}
            assert r.n_descendants == len(below)
            assert {k for k, o in got.items() if k[0] == n and o.lft and r.lft < o.lft <= r.rgt} == below
    assert {(r.neuron_id, r.node_id, r.cycle_id) for r in hierarchy(df, only_endless=True, block_rows=block).collect()} == {(*k, w[3]) for k, w in want.items() if w[3] is not None}


def test_deep_and_empty(spark):
    df = spark.range(1, 30001).selectExpr("cast(1 as bigint) neuron_id", "cast(id as int) node_id", "cast(id - 1 as int) parent_id", "timestamp'2026-01-01' loaded_at")
    top = hierarchy(df).orderBy("depth", ascending=False).first()
    assert (top.node_id, top.depth, top.root_id, top.lft, top.n_descendants) == (30000, 29999, 1, 30000, 0)
    assert hierarchy(spark.createDataFrame([], S), paths=True).count() == 0


def test_descendants(spark):
    df = spark.createDataFrame([(1, 1, None, None, "", ""), (1, 2, 1, None, "", ""), (1, 3, 2, None, "", ""), (1, 4, 1, None, "", "")], S)
    found = descendants(hierarchy(df), spark.createDataFrame([(1, 2), (1, 1)], "neuron_id bigint, node_id int"))
    assert sorted((r.ancestor_id, r.node_id) for r in found.collect()) == [(1, 2), (1, 3), (1, 4), (2, 3)]


def test_many_tasks(spark):
    """Trees stay whole in their tasks after the large ones are set apart."""
    rows = [r for seed in range(4) for r in ((None if r[0] is None else r[0] * 10 + seed, *r[1:]) for r in sample(seed))]
    df = spark.createDataFrame([(*r, "p", "q") for r in rows], S.replace("loaded_at timestamp", "loaded_at string")).selectExpr("* except (loaded_at)", "cast(loaded_at as timestamp) loaded_at")
    hot = spark.range(1, 400).selectExpr("cast(7 as bigint) neuron_id", "cast(id as int) node_id", "cast(id - 1 as int) parent_id", "'p' path", "'q' root_id", "timestamp'2026-01-01' loaded_at")
    # joins are planned as sorted ones and become broadcasts at run time, as they do on larger tables
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for source in (df.repartition(5), df.unionByName(hot).repartition(5)):
            got = {(r.neuron_id, r.node_id): (r.parent_id, r.root_id, r.depth, r.cycle_id) for r in hierarchy(source, block_rows=150).where("neuron_id <> 7").collect()}
            assert got == {k: w[:4] for k, w in brute(rows).items()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
