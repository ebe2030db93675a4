"""Bounded state restarts at the gaps of the exact wanted rows, however many these and the streams are."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from test_domain import lengths, samplers
from test_engine import client, numbers, values  # noqa: F401

from rowloom.plans import domain as D


def counts(wanted, warmup):
    """What CounterBounded gives for wanted rows: rows since the last gap."""
    fed = sorted({r for w in wanted for r in range(max(0, w - warmup), w + 1)})
    since, out = 0, {}
    for i, r in enumerate(fed):
        since = since + 1 if i and fed[i - 1] == r - 1 else 0
        out[r] = since
    return [out[w] for w in wanted]


@pytest.mark.parametrize("n", [2560, 2561, 20_000])
def test_stride(spark, client, n):  # noqa: F811
    x = client.io.Input([numbers(spark, n)])
    got = values(client.frame(client.streams.Stride(client.ops.CounterBounded(ignore=x, bounded_state=3), [10])))
    assert got == counts(range(0, n, 10), 3) == [0] + [3] * (len(got) - 1)


@pytest.mark.parametrize("k", [256, 257, 1000])
def test_gather(spark, client, k):  # noqa: F811
    chosen = [7 * i + i % 3 for i in range(k)]
    x = client.io.Input([numbers(spark, 8000)])
    assert values(client.frame(client.streams.Gather(client.ops.CounterBounded(ignore=x, bounded_state=3), [chosen]))) == counts(chosen, 3)


def test_many_streams_with_rows_of_their_own(spark, client):  # noqa: F811
    x = client.io.Input([numbers(spark, 60) for _ in range(33)])
    strides = [1 + i % 11 for i in range(33)]
    df = client.frame(client.streams.Stride(client.ops.CounterBounded(ignore=x, bounded_state=2), strides))
    got = {i: [] for i in range(33)}
    for r in df.orderBy("stream_id", "row_id").collect():
        got[r["stream_id"]].append(r["value"])
    assert got == {i: counts(range(0, 60, s), 2) for i, s in enumerate(strides)}


def test_chain_of_stencil_and_samplers(spark, client):  # noqa: F811
    x = client.io.Input([numbers(spark, 30_000)])
    seen = client.ops.CounterBounded(ignore=x, bounded_state=1)
    got = values(client.frame(client.streams.Range(client.streams.Stride(client.ops.Window(x=seen, stencil=[0, 2]), [20]), [(100, 1400)])))
    fed = [r for t in range(2000, 28_000, 20) for r in (t, t + 1, t + 2)]
    found = dict(zip(fed, counts(fed, 1)))
    assert got == [found[t] + found[t + 2] for t in range(2000, 28_000, 20)]


@given(samplers, samplers, lengths, st.integers(0, 3), st.integers(0, 3), st.integers(0, 5))
def test_wanted_rows_against_brute_force(first, second, n, before, after, width):
    middle = first.count(n)
    needed = lambda s, size, chosen: {r for k in chosen for r in range(*s.needed((k, k + 1), size))}
    below = needed(second, middle, range(second.count(middle)))
    below = {r for r in range(middle) if any(t in below for t in range(r - before, r + after + 1))}
    want = needed(first, n, below)
    half = D.Wanted(middle, False, (second.asks(D.Wanted(second.count(middle)), middle),))
    exact = D.Wanted(n, False, (first.asks(D.within_windows(half, before, after), n),))
    lo = np.arange(n)
    assert exact.any(lo, lo + width).tolist() == [any(r in want for r in range(a, a + width + 1)) for a in range(n)]
