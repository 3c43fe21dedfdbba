"""Configuration in JSON, read strictly: unknown keys, wrong types and patterns that don't compile are errors."""

from __future__ import annotations

import dataclasses
import json
import re
import types
import typing

from quillon.operators.filters import Criteria
from quillon.operators.score import Weights
from quillon.sources.listings import FieldMap


class ConfigError(ValueError):
    """A message with the path of the key that is wrong."""


def merged(base, over):
    """base with over on top: objects key by key, all else replaced."""
    if isinstance(base, dict) and isinstance(over, dict):
        return {k: merged(base[k], over[k]) if k in base and k in over else over.get(k, base.get(k)) for k in {**base, **over}}
    return over


def _checked(value, kind, path: str):
    origin = typing.get_origin(kind)
    if origin in (types.UnionType, typing.Union):
        if value is None:
            return None
        return _checked(value, next(k for k in typing.get_args(kind) if k is not type(None)), path)
    if origin is list:
        if not isinstance(value, list):
            raise ConfigError(f"{path}: a list is needed")
        return [_checked(v, typing.get_args(kind)[0], f"{path}/{i}") for i, v in enumerate(value)]
    if origin is dict:
        if not isinstance(value, dict):
            raise ConfigError(f"{path}: an object is needed")
        return {k: _checked(v, typing.get_args(kind)[1], f"{path}/{k}") for k, v in value.items()}
    if kind is float and type(value) in (int, float):
        return float(value)
    if type(value) is not kind:
        raise ConfigError(f"{path}: {kind.__name__} is needed, not {type(value).__name__}")
    return value


def read(kind: type, data: dict, path: str = ""):
    """A dataclass from an object whose keys are its fields; keys that start with an underscore are comments."""
    hints = typing.get_type_hints(kind)
    known = {f.name for f in dataclasses.fields(kind)}
    given = {k: v for k, v in data.items() if not k.startswith("_")}
    if extra := sorted(given.keys() - known):
        raise ConfigError(f"{path}/{extra[0]}: unknown key")
    try:
        return kind(**{k: _checked(v, hints[k], f"{path}/{k}") for k, v in given.items()})
    except TypeError as e:
        raise ConfigError(f"{path}: {e}") from e
    except ValueError as e:
        raise e if isinstance(e, ConfigError) else ConfigError(f"{path}: {e}") from e


def load_criteria(path: str, override: str | None = None) -> tuple[Criteria, Weights]:
    """Criteria and weights (key ``weights``) of a file, with a second file's keys on top."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if override:
        with open(override, encoding="utf-8") as f:
            data = merged(data, json.load(f))
    weights = read(Weights, data.pop("weights", {}), "/weights")
    criteria = read(Criteria, data)
    for name in ("exclude_patterns", "exclude_title_patterns"):
        for i, p in enumerate(getattr(criteria, name)):
            try:
                re.compile(p)
            except re.error as e:
                raise ConfigError(f"/{name}/{i}: {e}") from e
            if not p.isascii():
                raise ConfigError(f"/{name}/{i}: patterns meet folded text and must be ASCII")
    return criteria, weights


def load_field_maps(path: str) -> dict[str, FieldMap]:
    """Source name -> field map."""
    with open(path, encoding="utf-8") as f:
        return {k: read(FieldMap, v, f"/{k}") for k, v in json.load(f).items() if not k.startswith("_")}
