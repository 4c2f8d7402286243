import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.operators import filters as f
from spindrift.sources.raw import from_arrays


def direct(sos, x):
    """Sections one after the other, sample by sample."""
    y = x.astype(float).copy()
    for b0, b1, b2, _, a1, a2 in sos:
        out, s1, s2 = np.zeros_like(y), 0.0, 0.0
        for i, v in enumerate(y):
            out[i] = b0 * v + s1
            s1, s2 = b1 * v - a1 * out[i] + s2, b2 * v - a2 * out[i]
        y = out
    return y


@pytest.mark.parametrize("kind,cutoff", [("high", 300.0), ("low", 3000.0)])
def test_response_of_the_design(kind, cutoff):
    rate = 20000.0
    sos = f.butterworth(cutoff, rate, kind)

    def gain(freq):
        z = np.exp(-2j * np.pi * freq / rate)
        return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sos]))

    assert abs(gain(cutoff) - np.sqrt(0.5)) < 1e-9
    assert gain(0 if kind == "high" else rate / 2) < 1e-9 and abs(gain(rate / 2 if kind == "high" else 0) - 1) < 1e-9
    w = lambda q: np.tan(np.pi * q / rate)
    for freq in (100.0, 700.0, 5000.0):
        ratio = w(cutoff) / w(freq) if kind == "high" else w(freq) / w(cutoff)
        assert abs(gain(freq) - 1 / np.sqrt(1 + ratio**10)) < 1e-8


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 700), st.integers(0, 300))
def test_chunked_run_equals_direct_form(n, cut):
    x = np.random.default_rng(n).normal(size=(n, 2))
    system = f.System(f.cascade(10000.0, 300.0, 4000.0, 2))
    a, s = system.run(x[:cut])
    b, _ = system.run(x[cut:], s)
    want = np.stack([direct(system.sos, x[:, c]) for c in range(2)], axis=1)
    assert np.allclose(np.concatenate([a, b]), want, atol=1e-9)


def test_zero_phase_keeps_an_impulse_in_place():
    x = np.zeros((101, 1))
    x[50] = 1
    y = f.zero_phase(f.System(f.smoother(2)), x)[:, 0]
    assert y.argmax() == 50 and np.allclose(y[30:50], y[70:50:-1], atol=1e-9)
    steady = np.full((500, 1), 3.0)
    assert np.allclose(f.zero_phase(f.System(f.butterworth(1000, 10000, "low")), steady), 3.0)


def test_blocks_are_close_to_whole_segments(spark):
    r = np.random.default_rng(0)
    x = r.normal(0, 10, (6000, 3))
    p = f.Preprocessing(10000.0, 500.0, 4000.0)
    got = f.preprocess_blocks(from_arrays(spark, [x, x[:1000]]), p, 1024, 150).collect()
    one = np.array([r.v for r in sorted((r for r in got if r.segment == 0), key=lambda r: r.sample)])
    want = f.preprocess(x, p, normalise=False)
    assert len(got) == 7000
    inner = slice(200, -200)
    assert np.abs(one - want)[inner].max() / np.abs(want[inner]).mean() < 0.05


@pytest.mark.parametrize("chunk", [174, 512, 1024])
def test_stream_is_close_to_whole_segment(chunk):
    x = np.random.default_rng(1).normal(0, 10, (9000, 2))
    p = f.Preprocessing(10000.0, 500.0, 4000.0)
    stream = f.StreamFilter(p, 150, 2)
    state, parts, at = stream.empty, [], 0
    for a in range(0, len(x), chunk):
        state, first, values = stream.push(state, x[a : a + chunk])
        assert first == at or not len(values)
        at += len(values)
        parts.append(values)
    out, want = np.concatenate(parts), f.preprocess(x, p, normalise=False)
    assert len(out) == 9000 - 150
    assert np.abs(out - want[: len(out)])[300:-50].max() / np.abs(want).mean() < 0.05


def test_missing_cutoffs():
    assert f.cascade(1000.0, None, 0).tolist() == [[1, 0, 0, 1, 0, 0]] and len(f.cascade(1000.0, 100, 900)) == 3
    with pytest.raises(ValueError):
        f.butterworth(600, 1000, "high")
