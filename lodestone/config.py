"""Settings with overrides."""

from __future__ import annotations

import json


def load_config(path: str, overrides: dict | None = None) -> dict:
    """A YAML or JSON file's settings; an override that is not None wins, by top-level key.

    YAML needs the ``yaml`` package; JSON files (by their name) do not.
    """
    with open(path) as f:
        if path.endswith(".json"):
            settings = json.load(f)
        else:
            import yaml

            settings = yaml.safe_load(f) or {}
    return settings | {k: v for k, v in (overrides or {}).items() if v is not None}
