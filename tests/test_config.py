import json

import pytest

from quillon import config


def write(path, data):
    path.write_text(json.dumps(data))
    return str(path)


def test_criteria_and_override(tmp_path):
    base = write(tmp_path / "c.json", {"_note": "x", "postcode_prefixes": ["78"], "min_surface_m2": 75, "weights": {"lift": 5}})
    over = write(tmp_path / "o.json", {"min_rooms": 3, "weights": {"surface": 1}})
    criteria, weights = config.load_criteria(base, over)
    assert (criteria.min_rooms, criteria.min_surface_m2, criteria.postcode_prefixes) == (3, 75.0, ["78"]) and (weights.lift, weights.surface) == (5, 1)


@pytest.mark.parametrize("bad", [{"postcodes": []}, {"min_rooms": "3", "places": ["a"]}, {"min_rooms": True, "places": ["a"]}, {}, {"places": ["a"], "exclude_patterns": ["("]}, {"places": ["a"], "exclude_patterns": ["é"]}, {"places": "a"}])
def test_errors(tmp_path, bad):
    with pytest.raises(config.ConfigError):
        config.load_criteria(write(tmp_path / "c.json", bad))


def test_field_maps(tmp_path):
    maps = config.load_field_maps(write(tmp_path / "s.json", {"demo": {"ref": ["id"], "charges_included": True}}))
    assert maps["demo"].ref == ["id"] and maps["demo"].charges_included
    with pytest.raises(config.ConfigError):
        config.load_field_maps(write(tmp_path / "s.json", {"demo": {"title": ["x"]}}))
