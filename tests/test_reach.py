"""What can be reached, and in how many steps, against a breadth-first search."""

import random
from collections import deque

import pytest

from waymesh.operators import verify


def searched(ways, starts):
    found, todo = {s: 0 for s in starts}, deque(starts)
    out = {}
    for a, b in ways:
        out.setdefault(a, set()).add(b)
    while todo:
        a = todo.popleft()
        for b in out.get(a, ()):
            if b not in found:
                found[b] = found[a] + 1
                todo.append(b)
    return found


def graph(seed):
    """Chains between junctions, shortcuts, rings with and without a way in, loops, repeated ways."""
    rng, ways, n = random.Random(seed), [], 100
    for _ in range(25):
        a, b = rng.randrange(12), rng.randrange(12)
        chain = [a, *range(n, n + rng.choice([0, 1, 5, 40])), b]
        n += 50
        ways += list(zip(chain, chain[1:]))
    ring = list(range(n, n + 9))
    ways += list(zip(ring, ring[1:] + ring[:1])) + [(n + 20, n + 21), (n + 21, n + 20), (3, n + 20), (5, 5), ways[0]]
    return ways


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("few", [0, 2000])
def test_reachable(spark, seed, few):
    ways = graph(seed)
    starts = [0, 7, 105]
    edges, start = spark.createDataFrame(ways, "src long, dst long"), spark.createDataFrame([(s,) for s in starts], "node_id long")
    got = verify.reachable(edges, start, few=few).collect()
    assert len(got) == len({r.node_id for r in got}) and {r.node_id: r.steps for r in got} == searched(ways, starts)


def test_long_chain_takes_few_jobs(spark):
    n = 10_000
    edges = spark.range(n).selectExpr("id as src", "id + 1 as dst")
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("chain", "chain")
    try:
        far = verify.reachable(edges, spark.createDataFrame([(0,)], "node_id long")).selectExpr("max(steps) as m", "count(*) as n").first()
        jobs = len(tracker.getJobIdsForGroup("chain"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert (far.m, far.n) == (n, n + 1) and jobs < 150
