"""The algebra of rows against brute force."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from rowloom.plans import domain as D

lengths = st.integers(0, 60)
samplers = st.one_of(
    st.just(D.All()),
    st.builds(D.Stride, st.integers(1, 9)),
    st.builds(D.Repeat, st.integers(1, 5), st.booleans()),
    st.builds(lambda r, s: D.Ranges(tuple((min(a, b), max(a, b)) for a, b in r), s), st.lists(st.tuples(st.integers(0, 80), st.integers(0, 80)), max_size=4), st.integers(1, 4)),
    st.builds(lambda r: D.Gather(tuple(r)), st.lists(st.integers(0, 70), max_size=8)),
)


@given(samplers, lengths)
def test_count_is_the_number_of_rows(sampler, n):
    assert sampler.count(n) == len(sampler.rows(n))


@given(samplers, lengths, st.integers(0, 100), st.integers(0, 100))
def test_needs_cover_what_rows_are_made_of(sampler, n, a, b):
    rows = sampler.rows(n)
    a, b = min(a, len(rows)), min(b, len(rows))
    found = sampler.needs(D.merge([(a, b)]), n)
    inside = {r for x, y in found for r in range(x, y)}
    assert {r for r in rows[a:b] if r is not None} <= inside
    assert all(0 <= r < max(n, 1) for r in inside)


@given(st.one_of(st.builds(D.GroupsOf, st.integers(1, 20), st.integers(1, 4))), lengths)
def test_group_lengths(partitioner, n):
    assert list(partitioner.lengths(n)) == [len(g) for g in partitioner.groups(n)]


def test_expected_counts():
    n = 720
    assert D.Stride(8).count(n) == 90
    assert D.Ranges(((0, 30),)).count(n) == 30
    assert D.Ranges(((0, 300),), 10).count(n) == 30
    assert D.Gather((0, 150, 377, 500)).count(n) == 4
    assert D.Repeat(8).count(n) == 5760
    assert D.Gather((0, 800, 1)).count(n) == 1
    assert D.Ranges(((0, 10), (700, 800), (900, 950))).count(n) == 30
    assert D.GroupsOf(50).lengths(n).runs == ((50, 14), (20, 1))
    assert D.GroupsOf(250).lengths(10**12).groups == 4 * 10**9


@pytest.mark.parametrize("make", [lambda: D.Stride(0), lambda: D.Repeat(0), lambda: D.Ranges(((5, 1),)), lambda: D.Ranges(((0, 1),), 0), lambda: D.Gather((-1,)), lambda: D.GroupsOf(0)])
def test_bad_arguments(make):
    with pytest.raises(ValueError):
        make()


def test_slices_must_lie_in_the_stream():
    with pytest.raises(ValueError):
        D.RangeGroups(((0, 10),)).lengths(5)
    with pytest.raises(ValueError):
        D.GatherGroups(((7,),)).lengths(5)


def test_stencil_and_state_needs():
    assert D.stencil_needs(((0, 1),), (-1, 0), 10) == ((0, 1),)
    assert D.stencil_needs(((4, 5),), (-2, 1), 10) == ((2, 6),)
    assert D.bounded_needs(((0, 1), (10, 11), (25, 28)), 3) == ((0, 1), (7, 11), (22, 28))
    assert D.unbounded_needs(((5, 6),)) == ((0, 6),)


def test_many_intervals_become_one():
    assert D.merge([(2 * i, 2 * i + 1) for i in range(D.MAX_INTERVALS + 1)]) == ((0, 2 * D.MAX_INTERVALS + 1),)
