import pytest

from offertide.settings import Settings


@pytest.mark.parametrize("bad", [
    {"smd_threshold": 0}, {"n_campaign_waves": 0}, {"cluster_k_max": 2}, {"validation_wave_cutoff": 6},
    {"serving_temperature_default": 2.0}, {"blend_mode": "other"}, {"attribution_priority": "random"},
    {"gain_curve_confidence_level": 1.0}, {"blend_temperature": -0.1}, {"rows_per_task": 0},
])
def test_bad_values_are_rejected(bad):
    with pytest.raises(ValueError):
        Settings(**bad)


def test_defaults_and_copies():
    cfg = Settings()
    assert cfg.quadrant_tau_epsilon == 0.012 and cfg.blend_lambda == 0.3 and len(cfg.gain_curve_budgets) == 4
    assert cfg.but(seed=7).seed == 7 and cfg.seed == 42
