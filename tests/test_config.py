"""Settings: defaults, checks, and their way through requests."""

import pytest

from frameloom.config import ExportSettings, ReviewSettings, request_of, settings_of


def test_defaults_and_round_trip():
    assert ReviewSettings().phash_distance == 8 and ReviewSettings().ssim_threshold == 0.94
    assert ExportSettings() == settings_of(ExportSettings, {}) == settings_of(ExportSettings, request_of(ExportSettings()))
    assert settings_of(ReviewSettings, {"min_width": 10}).min_width == 10


@pytest.mark.parametrize(
    "wrong",
    [{"min_width": 0}, {"min_sharpness": float("nan")}, {"max_low_information": 1.1}, {"phash_distance": 65}, {"similarity_scope": "all"}, {"ssim_threshold": -0.1}, {"unknown": 1}],
)
def test_wrong_review_settings(wrong):
    with pytest.raises(ValueError):
        settings_of(ReviewSettings, wrong)


@pytest.mark.parametrize("wrong", [{"content": "films"}, {"review_scope": ""}, {"conflict": "overwrite"}, {"x": 1}])
def test_wrong_export_settings(wrong):
    with pytest.raises(ValueError):
        settings_of(ExportSettings, wrong)
