"""Published and hand-derived values of the small-sample functions."""

import math

import pytest

from cohortlens.functions.special import binomial_cdf, chi2_sf, clopper_pearson, fisher_exact, mcnemar_p, two_sided_p


def test_binomial_tail_is_the_sum_of_its_terms():
    for n, p in ((1, 0.3), (7, 0.5), (40, 0.05), (200, 0.9)):
        for k in range(n):
            want = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert binomial_cdf(k, n, p) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize(
    ("k", "n", "lo", "hi"),
    [(81, 263, 0.25273674558527126, 0.3676219226013514), (490, 500, 0.9635275917077902, 0.9903685704135666), (0, 20, 0, 0.16843347098308534), (20, 20, 0.8315665290169146, 1)],
)
def test_clopper_pearson(k, n, lo, hi):
    assert clopper_pearson(k, n) == pytest.approx((lo, hi), abs=1e-9)


def test_clopper_pearson_without_rows():
    assert clopper_pearson(0, 0) is None


def test_mcnemar():
    assert mcnemar_p(10, 2) == ("exact", None, pytest.approx(0.03857421875))
    assert mcnemar_p(0, 0)[2] == 1.0
    method, x, p = mcnemar_p(20, 8)
    assert method == "chi2_continuity" and x == pytest.approx(121 / 28) and p == pytest.approx(math.erfc(math.sqrt(x / 2)))


def test_chi2():
    assert chi2_sf(4.6327272727, 2) == pytest.approx(0.0986315946, abs=1e-9)
    assert chi2_sf(4.0833333333, 1) == pytest.approx(0.0433081428, abs=1e-9)
    assert chi2_sf(0, 3) == 1
    assert chi2_sf(3.0, 3) == pytest.approx(0.3916251762710877, abs=1e-12)


def test_fisher_and_normal():
    assert fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857, abs=1e-9)
    assert two_sided_p(1.8856180832) == pytest.approx(0.0593464388, abs=1e-9)
