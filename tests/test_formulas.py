import math

import pytest
from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark.functions import contact as C, pricing as P, rates as R, text_time as T
from tidemark.operators.composites import slot_weight, staff_blend, starter_weight
from tidemark.operators.counts import event_outs

def null():
    return F.lit(None).cast("double")


def lit(*values):
    return [F.lit(v) for v in values]


def test_safe_div_needs_a_positive_denominator(one):
    assert one(R.safe_div(*lit(3, 4)), R.safe_div(*lit(3, 0)), R.safe_div(F.lit(3), F.lit(None).cast("int"))) == (0.75, None, None)


def test_siera_by_hand(one):
    k, w, g = 60 / 250, 20 / 250, (80 - 50 - 10) / 250
    want = 6.145 - 16.986 * k + 11.434 * w - 1.858 * g + 7.653 * k * k - 6.664 * w * w + 10.130 * k * g - 5.195 * w * g
    assert one(R.siera(*lit(60, 20, 80, 50, 10, 250))) == pytest.approx(want)
    w = 40 / 250
    want_wild = 6.145 - 16.986 * k + 11.434 * w - 1.858 * g + 7.653 * k * k + 6.664 * w * w + 10.130 * k * g - 5.195 * w * g
    assert one(R.siera(*lit(60, 40, 80, 50, 10, 250))) == pytest.approx(want_wild)
    assert one(R.siera(*lit(1, 1, 1, 1, 1, 0))) is None


def test_fip_family(one):
    assert one(R.fip(*lit(100, 30, 5, 10, 90.0))) == pytest.approx((130 + 105 - 200) / 90 + 3.13)
    assert one(R.xfip(*lit(100, 30, 5, 100, 90.0))) == pytest.approx((13 * 11 + 105 - 200) / 90 + 3.13)
    assert one(R.fip(*lit(1, 1, 1, 1, 0.0))) is None
    assert one(R.fip_constant(F.lit(2019)), R.fip_constant(F.lit(1950))) == (3.21, 3.13)


def test_two_pythagoreans_differ_on_missing_runs(one):
    half = one(R.pythag(*lit(4.0, 4.0)))
    assert half == pytest.approx(0.5)
    assert one(R.pythag(null(), F.lit(4.0))) is None
    assert one(R.pythag_zero_filled(null(), F.lit(4.0))) == pytest.approx(0.0, abs=1e-9)


def test_american_prices(one):
    assert one(P.american_to_decimal(F.lit(150.0)), P.american_to_decimal(F.lit(-200.0)), P.american_to_decimal(F.lit(0.0))) == (2.5, 1.5, 1.0)
    assert one(P.american_to_implied(null())) is None
    # The older conversion disagrees at zero and at a missing price.
    assert one(P.american_to_implied_legacy(F.lit(0.0)), P.american_to_implied_legacy(null())) == (0.0, 0.0)
    assert one(P.american_to_implied(F.lit(0.0))) == 1.0


@pytest.mark.parametrize("p,q", [(0.55, 0.5), (0.8, 0.3), (0.52, 0.52)])
def test_margin_removal_sums_to_one(one, p, q):
    for method in ("proportional", "power"):
        a, b = P.remove_vig(F.lit(p), F.lit(q), method)
        assert sum(one(a, b)) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        P.remove_vig(F.lit(p), F.lit(q), "other")


def test_kelly_is_never_negative_and_capped(one):
    assert one(P.kelly_fraction(F.lit(0.6), F.lit(2.0))) == pytest.approx(0.10)
    assert one(P.kelly_fraction(F.lit(0.6), F.lit(2.0), cap=None)) == pytest.approx(0.2)
    assert one(P.kelly_fraction(F.lit(0.3), F.lit(2.0)), P.kelly_fraction(F.lit(0.6), F.lit(1.0))) == (0.0, 0.0)


def test_units_fall_back_when_the_reference_is_unusable(one):
    assert P.kelly_reference_fallback() == pytest.approx(0.00125)
    assert one(P.kelly_to_units(F.lit(0.00125), F.lit(0.0))) == pytest.approx(1.0)
    assert one(P.kelly_to_units(F.lit(1.0), F.lit(0.001)), P.kelly_to_units(F.lit(0.0), F.lit(0.001))) == (2.0, 0.5)
    assert one(P.kelly_to_units(F.lit(0.005))) == pytest.approx(1.0)


def test_expected_value_variants(one):
    assert one(P.expected_value(*lit(0.5, 2.1))) == pytest.approx(0.05)
    assert one(P.expected_value_american(*lit(0.5, -110.0))) == pytest.approx(0.5 * 100 / 110 - 0.5)


def test_settlement(one):
    assert one(P.outcome_of(*lit("home", 3, 2)), P.outcome_of(*lit("away", 3, 2)), P.outcome_of(*lit("away", 2, 2))) == ("won", "lost", "push")
    assert one(P.outcome_of(F.lit("home"), F.lit(3), F.lit(None).cast("int"))) is None
    assert one(P.settle_profit(*lit("won", 2.5, 2.0)), P.settle_profit(*lit("lost", 2.5, 2.0)), P.settle_profit(*lit("push", 2.5, 2.0))) == (3.0, -2.0, 0.0)


MIX = {"GB": 0.4, "FB": 0.3, "LD": 0.2, "PU": 0.1}


def mix(values):
    return {k: F.lit(v) for k, v in values.items()}


def test_blend_normalises_and_falls_back(one):
    other = {"GB": 0.5, "FB": 0.2, "LD": 0.2, "PU": 0.1}
    out = one(*C.blend_contact(mix(MIX), mix(other)).values())
    assert sum(out) == pytest.approx(1.0)
    assert out[0] == pytest.approx(0.44)
    zero = dict.fromkeys(MIX, 0.0)
    assert one(*C.blend_contact(mix(zero), mix(zero)).values()) == (0.43, 0.33, 0.20, 0.04)
    missing = {k: null() for k in MIX}
    assert one(*C.blend_contact(mix(MIX), missing).values()) == (None,) * 4


def test_park_factors_by_flight(one):
    by_event = {"1B": F.lit(1.1), "2B": F.lit(1.2), "3B": F.lit(1.3), "HR": F.lit(1.4)}
    park = C.flight_park_factors(F.lit(True), by_event)
    assert one(park["FB"]) == pytest.approx((0.0176 * 1.1 + 0.0381 * 1.2 + 0.0162 * 1.3 + 0.189 * 1.4) / 0.2609)
    assert one(park["LD"]) == pytest.approx((0.44 * 1.1 + 0.1905 * 1.2 + 0.0324 * 1.3 + 0.063 * 1.4) / 0.7259)
    neutral = C.flight_park_factors(F.lit(False), {k: null() for k in by_event})
    assert one(*neutral.values()) == (1.0, 1.0, 1.0, 1.0)
    assert one(C.matchup_park_factor(mix(MIX), neutral)) == pytest.approx(1.0)


def test_defense_factor(one):
    d = C.matchup_defense_factor(mix(MIX), F.lit(10.0), F.lit(-4.0))
    assert one(d) == pytest.approx(1 - 0.00115 * (10 * 0.4 - 4 * 0.5))


def test_personal_park_factor(one):
    counts = {"HR": F.lit(10), "1B": F.lit(20)}
    park = {"HR": F.lit(1.2), "1B": F.lit(0.9)}
    want = (2.1 * 10 * 1.2 + 0.88 * 20 * 0.9) / (2.1 * 10 + 0.88 * 20)
    assert one(C.personal_park_factor(F.lit(True), counts, park)) == pytest.approx(want)
    assert one(C.personal_park_factor(F.lit(False), counts, park), C.personal_park_factor(F.lit(True), {}, park)) == (1.0, 1.0)


def test_legacy_scalars(one):
    ground, air = one(*C.air_share(*lit(0.45, 0.35, 0.2)))
    assert ground + air == pytest.approx(1.0)
    assert one(*C.air_share(*lit(0.0, 0.0, 0.0))) == (0.5, 0.5)
    assert one(C.park_adjust(F.lit(4.5), *lit(0.45, 0.35, 0.2, 1.0))) == pytest.approx(4.5)
    assert one(C.defense_adjust(*lit(4.5, 10.0, 15.0))) == pytest.approx(4.5 * (1 - 0.0011 * 25))


def test_slot_weights_and_staff(one):
    assert sum(K.SLOT_WEIGHTS) == pytest.approx(1.0)
    assert one(slot_weight(F.lit(10)), slot_weight(F.lit(0))) == (None, None)
    assert one(slot_weight(F.lit(1))) == pytest.approx(0.122 / sum(K.RAW_SLOT_SHARES))
    assert one(starter_weight(F.lit(1.0)), starter_weight(F.lit(9.0))) == (0.25, 0.85)
    assert one(starter_weight(null())) == pytest.approx(5.5 / 9)
    assert one(staff_blend(F.lit(3.0), F.lit(4.5), F.lit(5.0))) == pytest.approx(4.0)
    assert one(staff_blend(null(), F.lit(4.5), F.lit(5.0)), staff_blend(F.lit(3.0), F.lit(4.5), null())) == (5.0, 3.0)


def test_text_and_time(one):
    assert one(T.surname(F.lit("juan DE la cruz")), T.surname(F.lit(" ")), T.surname(F.lit(None).cast("string"))) == ("Cruz", "TBD", "TBD")
    assert one(T.title_name(F.lit("mary ann"), F.lit("o'neil"))) == "Mary Ann O'neil"
    assert str(one(T.eastern_date(F.lit("2024-06-02 03:30:00").cast("timestamp")))) == "2024-06-01"
    assert one(T.attempts_from_rates(F.lit("5"), F.lit("4%")), T.attempts_from_rates(F.lit("0"), F.lit("4%")), T.attempts_from_rates(F.lit("5"), F.lit("0%"))) == (125, None, None)
    assert one(event_outs(F.lit("double_play")), event_outs(F.lit("walk")), event_outs(F.lit(None).cast("string"))) == (2, 0, 0)
    assert math.isclose(one(T.percent(F.lit("-3%"))), -0.03)
