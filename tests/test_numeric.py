"""Quantizers, coders and containers against plain definitions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boundwave.operators import compressors, container, interpolate, lorenzo, mixture, predictors, rangecoder
from boundwave.sources import synthetic

SIZES = [0, 1, 2, 3, 4, 7, 8, 9, 31, 33, 100, 513]


def walk(n, seed=0):
    return np.rint(np.cumsum(np.random.default_rng(seed).normal(0, 50, n)))


@pytest.mark.parametrize("n", SIZES)
def test_bounds_and_decoding(n):
    x, tau = walk(n), 3.7
    for name, f in predictors.CLASSICAL.items():
        q, xhat = f(x, tau)
        assert len(q) == n
        if name.startswith("interp"):
            level, t, q, xhat = interpolate.encode(x, tau, name[7:])
            back = interpolate.decode(q, tau, name[7:])
            assert sorted(t.tolist()) == list(range(n)) and (np.diff(level) >= 0).all()
            assert np.allclose(back[t], xhat, atol=1e-9)
            xhat = back
        assert n == 0 or np.abs(xhat - x).max() <= tau + 1e-6


def test_lattice_is_the_closed_loop_off_ties():
    x, tau = walk(2000), 2.3
    m = np.rint(x / (2 * tau)).astype(int)
    for k in (1, 2, 3):
        want = m.copy()
        for _ in range(k):
            want = np.diff(want, prepend=0)
        assert (lorenzo.closed_loop(x, tau, k)[0] == want).all()


@pytest.mark.parametrize("n", [2, 5, 64, 65, 300])
def test_levels_of_interpolation(n):
    level, t, _, _ = interpolate.encode(walk(n), 1.1, "cubic")
    top = interpolate.levels_of(n)
    zeros = np.array([top if i == 0 else min(top, (int(i) & -int(i)).bit_length() - 1) for i in t])
    assert (level == top - zeros).all()  # the level follows from the trailing zeros of t


def test_interpolation_reproduces_polynomials():
    t = np.arange(513)
    line, cubic = 3 * t - 700, (t - 250) ** 3 // 1  # integers: on the lattice of step 1 nothing is lost
    for x, kind, reach in ((line, "linear", 1), (line, "cubic", 1), (cubic, "cubic", 3)):
        level, at, q, xhat = interpolate.encode(x.astype(float), 0.5, kind)
        half = 2 ** (interpolate.levels_of(len(x)) - level)
        inner = (level > 0) & (at - reach * half >= 0) & (at + reach * half < len(x))
        assert inner.sum() > 400 and (q[inner] == 0).all() and (xhat == x[at]).all()


def test_samples_depend_on_coarser_levels_alone():
    x = walk(300)
    for kind in ("linear", "cubic"):
        level, t, q, _ = interpolate.encode(x, 1.1, kind)
        for k in (2, 5):
            other = x.copy()
            other[t[level > k]] += 1000.0
            level2, _, q2, _ = interpolate.encode(other, 1.1, kind)
            assert (q2[level2 <= k] == q[level <= k]).all() and (q2 != q).any()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**40), 2**40), max_size=60), st.integers(1, 3))
def test_range_coder_round_trip(values, buckets):
    b = [i % buckets for i in range(len(values))]
    data = rangecoder.encode(values, b, buckets)
    assert rangecoder.decode(data, len(values), b, buckets).tolist() == values
    assert rangecoder.code_length(values, b, buckets) <= 8 * len(data) <= rangecoder.code_length(values, b, buckets) + 64


def test_decisions_of_an_index():
    slot, bit = rangecoder.decisions([0, -1, 9])
    raw = slot == rangecoder.RAW
    assert bit[raw].tolist() == [1, 0, 0, 0, 1, 0, 0] and raw.sum() == 7  # signs, then 4 = 00100
    assert bit[~raw].tolist() == [0, 1, 0, 1, 1, 1, 1, 1, 1]
    assert len(rangecoder.encode([])) == 5


def test_range_coder_shapes():
    r = np.random.default_rng(0)
    for x in (r.laplace(0, 3, 4000), r.laplace(0, 0.4, 4000), r.standard_t(2, 4000) * 8, np.zeros(4000), r.integers(-200, 201, 4000)):
        x = np.rint(x).astype(int)
        assert (rangecoder.decode(rangecoder.encode(x), len(x)) == x).all()


def test_noise_costs_its_bits():
    x = synthetic.iid_noise(np.random.default_rng(3), 6000)
    assert mixture.fair_bits(x - 2048, 4096).mean() == pytest.approx(12.0, abs=0.02)


@pytest.mark.parametrize("n", [5, 40, 700])
def test_container(n):
    parts = [walk(n, s) for s in range(3)]
    taus = [2.5, 7.0, 0.5]
    for p in (predictors.Last(), predictors.SeasonalLag(24), predictors.Linear([-1, 2])):
        blob, out = container.encode(parts, taus, p, 64)
        back = container.decode(blob, p)
        for x, tau, a, b in zip(parts, taus, out, back, strict=True):
            assert np.allclose(a, b) and np.abs(a - x).max() <= tau + 1e-6
        assert len(container.blocks(blob)) == 6


def test_container_rejects():
    with pytest.raises(ValueError):
        container.blocks(b"no container")
    with pytest.raises(ValueError):
        container.encode([np.zeros(3), np.zeros(4)], [1, 1], predictors.Last())


def test_hybrids_keep_the_bound():
    x = walk(900)
    for mode in ("blend", "leader"):
        _, xhat = predictors.hybrid(x, 4.0, mode, predictors.Last(), predictors.Linear([-1, 2]), 64, 64)
        assert np.abs(xhat - x).max() <= 4 + 1e-6
    _, xhat = predictors.lpc_from(x, 4.0, 100)
    assert np.abs(xhat[100:] - x[100:]).max() <= 4 + 1e-6
    coarse, fine, xhat = predictors.two_level(x, 4.0, 16, predictors.Last())
    assert len(coarse) + len(fine) == len(x) and np.abs(xhat - x).max() <= 4 + 1e-6


def test_serial_forms():
    a = np.array([5, 260, 7])
    data, w = compressors.serialize(a)
    assert w == 1 and compressors.serialize(a * 1000)[1] == 4
    for b in (a, a * 1000, a - 300, a[:0]):
        data, w = compressors.serialize(b)
        assert (compressors.deserialize(data, w, int(b.min()) if len(b) else 0) == b).all()
    assert compressors.shuffle(b"abcdef", 2) == b"acebdf"
    found = compressors.sizes(walk(200))
    assert {"xz_raw", "bz2_delta_shuffled"} <= set(found)
    assert compressors.bucketed_bytes(walk(100).astype(int), np.arange(100.0), 2.0) > 0


def test_gains():
    assert predictors.gain_of("lorenzo2") == pytest.approx(5**0.5)
    assert predictors.gain_of("interp_cubic") == pytest.approx((2 * (1 / 16) ** 2 + 2 * (9 / 16) ** 2) ** 0.5)


@pytest.mark.parametrize("name", list(synthetic.GENERATORS))
def test_generators(name):
    a, b = (synthetic.GENERATORS[name](np.random.default_rng(5), 400) for _ in range(2))
    assert (a == b).all() and len(a) == 400 and (a == np.rint(a)).all()


class Still:
    """A source of no noise: what is left of a generator is its definition."""

    def __init__(self, events=()):
        self.events = set(events)

    def standard_normal(self, n=None):
        return 0.0 if n is None else np.zeros(n)

    def random(self, n=None):
        return np.array([0.0 if i in self.events else 1.0 for i in range(n)])


def unit(x):
    return (x - x.min()) / (x.max() - x.min())


def test_generators_by_definition():
    t = np.arange(4032)
    want = 30 * np.sin(t / 288 * 2 * np.pi) + 12 * np.sin(t / 2016 * 2 * np.pi + 0.7) + t / 250 + 25 * (t == 77)
    assert np.abs(synthetic.seasonal_metric(Still([77]), 4032) / 65535 - unit(want)).max() < 1e-5
    beat = synthetic.ecg_like(Still(), 1000)
    peaks = np.flatnonzero(beat > 3000)
    assert np.ptp(beat) == 4095 and set((peaks + 5) // 200) == set(range(5)) and ((peaks + 5) % 200 <= 10).all()  # a beat every 0.8 s at 250 Hz
    flat = synthetic.sparse_spiky(Peaks({3: 100.0, 6: -50.0}), 12)
    want = np.zeros(12)
    want[3:6], want[6:] = 100 * 0.92 ** np.arange(1, 4), -50 * 0.92 ** np.arange(1, 7)  # a new spike takes the level's place
    assert np.abs(flat / 65535 - unit(want)).max() < 1e-5


class Peaks(Still):
    def __init__(self, heights):
        super().__init__(heights)
        self.heights = heights

    def standard_normal(self, n=None):
        out = np.zeros(n)
        if not hasattr(self, "drawn"):  # the heights are drawn before the noise
            self.drawn = True
            for i, h in self.heights.items():
                out[i] = h / 100
        return out
