"""Preferences as JSON: read with defaults in place of what is invalid, written at once or not at all."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path

#: Defaults, what may be chosen, and ranges.
DEFAULTS = {"source": "auto", "target": "es", "model": "base", "compute": "auto", "device_name": "", "font_size": 20, "opacity": 0.95, "threshold": 0.008, "chunk_seconds": 8.0, "audio_mode": "system", "vad_profile": "natural", "separation_mode": "auto"}
CHOICES = {
    "source": ("auto", "es", "en", "pt"),
    "target": ("es", "en", "pt"),
    "model": ("base", "small", "small.en", "medium"),
    "compute": ("auto", "cpu"),
    "audio_mode": ("system", "mic", "both"),
    "vad_profile": ("fast", "balanced", "natural"),
    "separation_mode": ("auto", "disabled", "spectral", "mossformer", "sepformer"),
}
RANGES = {"font_size": (16, 48), "opacity": (0.45, 1), "threshold": (0.002, 0.05), "chunk_seconds": (2, 15)}


def problems(values: Mapping) -> list[str]:
    """Names whose values aren't allowed; truth values aren't numbers, and a size is whole."""
    def number(name: str) -> bool:
        v, (low, high) = values[name], RANGES[name]
        kinds = int if name == "font_size" else (int, float)
        return isinstance(v, kinds) and not isinstance(v, bool) and low <= v <= high

    bad = [name for name, allowed in CHOICES.items() if values[name] not in allowed]
    bad += [name for name in RANGES if not number(name)]
    return bad + (["device_name"] if not isinstance(values["device_name"], str) else [])


def load(path: str | os.PathLike) -> tuple[dict, str]:
    """(values, message): the defaults and a message if the file is broken or holds a value that isn't allowed; unknown names are left out."""
    if not Path(path).exists():
        return dict(DEFAULTS), ""
    try:
        read = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as error:
        return dict(DEFAULTS), f"preferences can't be read: {error}"
    if not isinstance(read, dict):
        return dict(DEFAULTS), "preferences aren't an object"
    values = DEFAULTS | {k: v for k, v in read.items() if k in DEFAULTS}
    bad = problems(values)
    return (dict(DEFAULTS), f"not allowed: {', '.join(bad)}") if bad else (values, "")


def save(path: str | os.PathLike, values: Mapping) -> None:
    """Writes a file beside the old one and puts it in its place; raises for values that aren't allowed."""
    whole = DEFAULTS | dict(values)
    if bad := [k for k in whole if k not in DEFAULTS] + problems(whole):
        raise ValueError(f"not allowed: {', '.join(bad)}")
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    beside = target.with_name(target.name + ".new")
    beside.write_text(json.dumps(whole, ensure_ascii=False, indent=2), encoding="utf-8")
    os.replace(beside, target)
