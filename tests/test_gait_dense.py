"""Means of many neighbours: the same as a convolution's, in a time that does not grow with their number."""

import time

import numpy as np
import pytest

from chronospan.operators import gait


@pytest.mark.parametrize("mode", ["valid", "same"])
def test_means_are_those_of_a_convolution(mode):
    r = np.random.default_rng(3)
    for size, n in ((10, 1), (10, 4), (11, 11), (500, 7), (501, 60)):
        y = r.normal(size=size)
        assert gait._mean_around(y, n, mode) == pytest.approx(np.convolve(y, np.ones(n) / n, mode))


def test_dense_recordings_take_no_longer_a_sample():
    y = np.random.default_rng(3).normal(size=2_000_000)
    began = time.process_time()
    gait._mean_around(y, 500_000, "same")
    assert time.process_time() - began < 5


def test_low_bins_are_those_of_the_padded_transform():
    y = np.random.default_rng(3).normal(size=9001)
    assert gait._low_spectrum(y, 8 * 9001, 390) == pytest.approx(np.fft.rfft(y, 8 * 9001)[:390], rel=1e-9, abs=1e-9)
