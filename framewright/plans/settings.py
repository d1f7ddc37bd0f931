"""Settings of a run: defaults, files and overrides, merged on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any


def merged(defaults: Mapping[str, Any], *layers: Mapping[str, Any]) -> dict[str, Any]:
    """defaults with the values of later layers; nested mappings merge, anything else is replaced. A name that the defaults
    don't have is a KeyError, but below an empty mapping any may stand."""
    out = {k: merged(v) if isinstance(v, Mapping) else v for k, v in defaults.items()}
    for layer in layers:
        for name, value in (layer or {}).items():
            if out and name not in out:
                raise KeyError(f"unknown setting {name}")
            own = out.get(name)
            out[name] = merged(own, value) if own and isinstance(own, Mapping) and isinstance(value, Mapping) else value
    return out


def overrides(words: Iterable[str]) -> dict[str, Any]:
    """a.b=value words as a layer; values are JSON where they can be read so, else texts."""
    out: dict[str, Any] = {}
    for word in words:
        path, found, text = word.partition("=")
        if not found:
            raise ValueError(f"no = in {word}")
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        *above, last = path.split(".")
        at = out
        for name in above:
            at = at.setdefault(name, {})
        at[last] = value
    return out
