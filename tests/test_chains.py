"""Replacement chains of every shape against following them link by link."""

import random

from colloquy import runtime
from colloquy.curation import fold


def _flags(spark, step):
    return spark.createDataFrame([(a, False, b) for a, b in step.items()], "id long, hidden boolean, superseded_by long")


def _follow(step, at):
    chain, first = [], at
    while (at := step.get(at)) is not None and at not in chain and at != first:
        chain.append(at)
    return chain, at is None


def _checked(spark, step, asked):
    flags = _flags(spark, step)
    want = {a: _follow(step, a) for a in step}
    assert {r.id: r.latest for r in fold.chain_ends(flags).collect()} == {a: c[-1] for a, (c, ends) in want.items() if ends}
    ids = spark.createDataFrame([(a,) for a in asked], "id long")
    got = fold.chains(flags, ids).collect()
    assert len(got) == len(asked & step.keys()) and {r.id: r.chain for r in got} == {a: want[a][0] for a in asked if a in step}
    some = {r.id: r.latest for r in fold.chain_ends(flags, ids).collect()}
    assert some == {a: want[a][0][-1] for a in asked if a in step and want[a][1]}


def test_random_links(spark):
    """Trees, tails that run into cycles, cycles of every length up to some dozens."""
    dice = random.Random(4)
    step = {a: b for a in range(300) if (b := dice.randrange(330)) != a}
    step |= {1000 + i: 1000 + (i + 1) % 7 for i in range(7)} | {2000 + i: 2001 + i for i in range(40)} | {2040: 1003}
    step |= {3000: 3001, 3001: 3000, 3002: 3001} | {4000 + i: 4001 + i for i in range(33)}
    _checked(spark, step, {*range(0, 300, 7), 1002, 2000, 2039, 3000, 3002, 4000, 4032, 9999})


def test_no_links_and_self_links(spark):
    empty = _flags(spark, {1: 1})
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert fold.chain_ends(empty).count() == fold.chains(empty, ids).count() == 0


def test_long_chain_in_few_rounds(spark, monkeypatch):
    """Ten thousand links: ends in eight cuts, the whole chain in twenty-one."""
    cuts = []
    whole = runtime.checkpoint
    monkeypatch.setattr(runtime, "checkpoint", lambda df: cuts.append(1) or whole(df))
    n = 10_000
    flags = _flags(spark, {i: i + 1 for i in range(n)} | {n + 2: n + 3, n + 3: n + 2})
    ends = fold.chain_ends(flags)
    assert ends.selectExpr("count(*)", "min(latest)", "max(latest)").first()[:] == (n, n, n) and len(cuts) <= 8
    cuts.clear()
    chain = fold.chains(flags, spark.createDataFrame([(0,), (n - 2,)], "id long"))
    assert {r.id: r.chain for r in chain.collect()} == {0: list(range(1, n + 1)), n - 2: [n - 1, n]} and len(cuts) <= 21
