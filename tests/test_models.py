"""Model types against a plain tick-by-tick restatement, and their guarantees as properties."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidegauge import schema
from tidegauge.functions import models as M, xor

floats = st.floats(-1e6, 1e6, width=32, allow_nan=False)
smooth = st.lists(st.integers(-3, 3), min_size=1, max_size=150).map(lambda d: (np.cumsum(d) / 4 + 10).tolist())
series = st.one_of(st.lists(floats, min_size=1, max_size=150), smooth,
                   st.lists(st.sampled_from([0.0, 1.0, -0.0, 2.5]), min_size=1, max_size=150))
BOUNDS = st.sampled_from([0.0, 0.5, 5.0, 30.0])


def column(values):
    return np.array(values, dtype=np.float32)[:, None]


def error(approx, real):
    return float(M.percentage_error(approx, real))


def naive_constant(v, eps):
    total, low, high, length = 0.0, np.inf, -np.inf, 0
    for tick in v:
        total += float(sum(map(float, tick)))
        low, high = min(low, tick.min()), max(high, tick.max())
        mean = np.float32(total / ((length + 1) * len(tick)))
        if error(mean, low) > eps or error(mean, high) > eps:
            break
        length += 1
    return length


def naive_linear(v, si, eps):
    start = np.float32(np.mean(v[0].astype(np.float64)))
    if any(error(start, x) > eps for x in v[0]):
        return 0
    up, low = np.inf, -np.inf
    for i, tick in enumerate(v[1:], 1):
        for x in map(float, tick):
            d, dt = abs(x * (eps / 100.1)), i * si
            if np.isfinite(up) and (x - d > float(start) + up * dt or x + d < float(start) + low * dt):
                return i
            up, low = min(up, (x + d - float(start)) / dt), max(low, (x - d - float(start)) / dt)
    return len(v)


def values_of(mtid, fit, si, width):
    n = fit.length
    if mtid == schema.XOR:
        return xor.decode_many([fit.payload], np.array([n * width])).reshape(n, width)
    if mtid == schema.RAW:
        return np.frombuffer(fit.payload, "<f4").reshape(n, width)
    return np.repeat((fit.b + fit.a * (np.arange(n) * float(si))).astype(np.float32)[:, None], width, axis=1)


@settings(max_examples=150, deadline=None)
@given(series, BOUNDS)
def test_prefix_lengths(values, eps):
    v = column(values)
    with np.errstate(all="ignore"):
        assert M.Constant().fit(v, 1000, eps).length == naive_constant(v, eps)
        assert M.Linear().fit(v, 1000, eps).length == naive_linear(v, 1000, eps)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(*[st.integers(90, 110)] * 3), min_size=1, max_size=90), BOUNDS)
def test_prefix_lengths_of_groups(ticks, eps):
    v = np.array(ticks, dtype=np.float32)
    with np.errstate(all="ignore"):
        assert M.Constant().fit(v, 1000, eps).length == naive_constant(v, eps)
        assert M.Linear().fit(v, 1000, eps).length == naive_linear(v, 1000, eps)


@settings(max_examples=200, deadline=None)
@given(series, BOUNDS)
def test_segments_cover_the_run_within_the_bound(values, eps):
    v = column(values)
    segments, end = M.segment_run(v, 1000, eps, (M.Constant(), M.Linear(), M.Xor(50)), 50)
    assert end == len(v) and [s[0] for s in segments] == list(np.cumsum([0] + [s[2].length for s in segments])[:-1])
    for at, mtid, fit in segments:
        real, approx = v[at:at + fit.length], values_of(mtid, fit, 1000, 1)
        assert (M.percentage_error(approx, real) <= eps).all()
        if eps == 0:
            assert (approx == real).all()


@settings(max_examples=100, deadline=None)
@given(series, BOUNDS, st.integers(1, 60))
def test_unflushed_segments_are_a_prefix_of_the_final_ones(values, eps, cut):
    """A stream decides as a batch does."""
    v = column(values)
    models = (M.Constant(), M.Linear(), M.Xor(20))
    whole = M.segment_run(v, 1000, eps, models, 20)[0]
    early, at = M.segment_run(v[:cut], 1000, eps, models, 20, flush=False)
    rest = [(s + at, m, f) for s, m, f in M.segment_run(v[at:], 1000, eps, models, 20)[0]]
    assert repr(early + rest) == repr(whole)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.floats(width=32, allow_nan=False), min_size=1, max_size=80), min_size=1, max_size=8))
def test_xor_round_trip(columns):
    arrays = [np.array(c, dtype=np.float32) for c in columns]
    decoded = xor.decode_many([xor.encode(a) for a in arrays], np.array([len(a) for a in arrays]))
    assert decoded.view(np.uint32).tolist() == np.concatenate(arrays).view(np.uint32).tolist()


def test_xor_of_wide_groups():
    a = np.random.default_rng(0).normal(size=20_000).astype(np.float32)
    assert (xor.decode_many([xor.encode(a)], np.array([len(a)])) == a).all()


def test_five_constant_ticks():
    v = column([25.0] * 5)
    assert M.Constant().fit(v, 100, 0.0)[:2] == (5, 4.0)
    assert M.Linear().fit(v, 100, 0.0)[:2] == (5, 8.0)
    assert M.Xor(50).fit(v, 100, 0.0)[:2] == (5, 5.0)


def test_group_of_three_within_ten_percent():
    v = np.array([[13.0, 12.0, 14.0]], dtype=np.float32)
    assert M.Constant().fit(v, 100, 10.0).length == 1
    assert M.Constant().fit(v, 100, 1.0).length == 0


def test_raw_is_the_last_resort():
    v = np.array([[1.0, 9.0]] * 3, dtype=np.float32)
    segments, _ = M.segment_run(v, 100, 0.0, (M.Constant(), M.Linear()), 50)
    assert {m for _, m, _ in segments} == {schema.RAW} and sum(f.length for *_, f in segments) == 3


@pytest.mark.parametrize("eps", [0.0, 5.0])
def test_shortcuts_change_nothing(eps, monkeypatch):
    rng = np.random.default_rng(3)
    for v in (rng.normal(100, 3, 300), np.cumsum(rng.integers(-1, 2, 300)), np.repeat(rng.normal(size=30), 10)):
        v = column(v)
        models = (M.Constant(), M.Linear(), M.Xor(50))
        fast = M.segment_run(v, 1000, eps, models, 50)
        monkeypatch.setattr(M, "_QUICK_TICKS", 10**9)
        assert repr(fast) == repr(M.segment_run(v, 1000, eps, models, 50))
        monkeypatch.undo()


def test_leaders_collect_members_within_twice_the_bound():
    v = np.array([[100, 101, 150, 119, np.nan], [100, 99, 151, 119, 100]], dtype=np.float32)
    assert [g.tolist() for g in M.correlated_members(v, 10.0)] == [[0, 1, 3, 4], [2]]


def tick_by_tick(v, si, eps, models, length_bound):
    """Segments when ticks arrive one at a time: each model is given up once it refuses a tick, and
    the best one is stored when the last has refused."""
    def best(buffer):
        chosen, chosen_ratio = None, None
        for m in models:
            fit = m.fit(buffer, si, eps)
            if fit.length and not np.isnan(fit.size):
                ratio = M.compression_ratio(fit.length, fit.size, 0)
                if chosen is None or not ratio < chosen_ratio:
                    chosen, chosen_ratio = (m.mtid, fit.length), ratio
        return chosen or (schema.RAW, min(length_bound, len(buffer)))

    out, start, end, current = [], 0, 0, 0
    while end < len(v):
        end += 1
        if models[current].fit(v[start:end], si, eps).length < end - start:
            current += 1
            if current == len(models):
                out.append((start, *best(v[start:end])))
                start, current = start + out[-1][2], 0
    while start < end:
        out.append((start, *best(v[start:end])))
        start += out[-1][2]
    return out


@settings(max_examples=150, deadline=None)
@given(series, BOUNDS, st.sampled_from([5, 20]), st.booleans())
def test_same_segments_as_tick_by_tick(values, eps, bound, coded):
    v = column(values)
    models = (M.Constant(), M.Linear(), M.Xor(bound)) if coded else (M.Constant(), M.Linear())
    with np.errstate(all="ignore"):
        want = tick_by_tick(v, 1000, eps, models, bound)
    got = [(at, mtid, fit.length) for at, mtid, fit in M.segment_run(v, 1000, eps, models, bound)[0]]
    assert got == want


def test_xor_fits_of_a_prepared_run_equal_single_ones():
    from tidegauge.functions.models import Xor
    values = np.array([0, -0.0, 1.5, 1.5, -7, 3e38, 1e-45, 2, *np.random.default_rng(1).normal(size=120)], dtype=np.float32)[:, None]
    model = Xor(50)
    known = model.quick(values, 1000, 0.0)
    assert [known(at) for at in range(len(values))] == [model.fit(values[at:], 1000, 0.0) for at in range(len(values))]
