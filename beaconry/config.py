"""Configurations: nested settings with inheritance and literal overrides."""

from __future__ import annotations

import ast
import json
from pathlib import Path


def merged(base: dict, over: dict) -> dict:
    """``base`` with ``over`` laid on it, level by level; lists and values are replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _parsed(path: Path) -> dict:
    if path.suffix == ".json":
        return json.loads(path.read_text(encoding="utf-8"))
    import yaml

    return yaml.safe_load(path.read_text(encoding="utf-8")) or {}


class Config:
    """Settings by key or attribute; nested tables come as Config either way."""

    def __init__(self, values: dict | None = None) -> None:
        self._values = dict(values or {})

    @classmethod
    def from_file(cls, path: str) -> Config:
        """A YAML or JSON file, laid on the files that its ``_base_`` names, relative to it."""
        told = _parsed(at := Path(path))
        bases = told.pop("_base_", [])
        out: dict = {}
        for b in [bases] if isinstance(bases, str) else bases:
            out = merged(out, cls.from_file(str(at.parent / b)).to_dict())
        return cls(merged(out, told))

    def overridden(self, pairs: dict[str, str]) -> Config:
        """With dotted keys set to literals; text that is no literal stays text."""
        out = self.to_dict()
        for key, raw in pairs.items():
            try:
                value = ast.literal_eval(raw) if isinstance(raw, str) else raw
            except (ValueError, SyntaxError):
                value = raw
            nested: dict = {}
            at = nested
            *parents, last = key.split(".")
            for p in parents:
                at = at.setdefault(p, {})
            at[last] = value
            out = merged(out, nested)
        return Config(out)

    def problems(self) -> list[str]:
        """What keeps the settings from being run."""
        out = [f"{k} is missing" for k in ("dataset", "model") if k not in self._values]
        return out + [f"{k}.type is missing" for k in ("dataset", "model") if isinstance(self._values.get(k), dict) and "type" not in self._values[k]]

    def get(self, key: str, default: object = None) -> object:
        at: object = self._values
        for p in key.split("."):
            if not isinstance(at, dict) or p not in at:
                return default
            at = at[p]
        return Config(at) if isinstance(at, dict) else at

    def __getitem__(self, key: str) -> object:
        if self.get(key) is None:
            raise KeyError(key)
        return self.get(key)

    def __getattr__(self, key: str) -> object:
        if key.startswith("_") or key not in self._values:
            raise AttributeError(key)
        return self.get(key)

    def __contains__(self, key: str) -> bool:
        return self.get(key) is not None

    def to_dict(self) -> dict:
        return json.loads(json.dumps(self._values))


DEFAULTS = {
    "dataset": {"type": "ujindoorloc", "normalize": True, "normalize_method": "minmax"},
    "model": {"type": "wknn", "k": 5},
    "metrics": ["mean_position_error", "median_position_error", "floor_accuracy", "building_accuracy"],
}
