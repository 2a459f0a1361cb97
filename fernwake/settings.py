"""Settings of an experiment as one tree: read from a file, overridden by dotted names, checked, written back."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from fernwake.operators.contrastive import Views
from fernwake.operators.encoders import Shape
from fernwake.operators.preparation import Settings as Preparation
from fernwake.operators.study import Plan
from fernwake.operators.training import Training
from fernwake.sources.recordings import ScanConfig


@dataclass(frozen=True)
class Experiment:
    """Every part checks itself when it is made."""

    scan: ScanConfig = field(default_factory=lambda: ScanConfig("."))
    preparation: Preparation = field(default_factory=Preparation)
    views: Views = field(default_factory=Views)
    encoder: Shape = field(default_factory=Shape)
    training: Training = field(default_factory=Training)
    study: Plan = field(default_factory=Plan)
    name: str = "experiment"
    seed: int = 0


def merged(base: object, changes: dict, at: str = "") -> object:
    """``base`` with the named fields changed, parts of parts too; an unknown name is a ValueError."""
    known = {f.name for f in dataclasses.fields(base)}
    new = {}
    for k, v in changes.items():
        if k not in known:
            raise ValueError(f"unknown setting {at}{k}; there are {', '.join(sorted(known))}")
        old = getattr(base, k)
        if dataclasses.is_dataclass(old):
            if not isinstance(v, dict):
                raise ValueError(f"{at}{k} is a part of settings")
            new[k] = merged(old, v, f"{at}{k}.")
        elif isinstance(v, dict) and not isinstance(old, dict):
            raise ValueError(f"{at}{k} has no parts")
        else:
            new[k] = tuple(v) if isinstance(old, tuple) and isinstance(v, list) else v
    return dataclasses.replace(base, **new)


def _value(text: str) -> object:
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return text


def nested(overrides: list[str]) -> dict:
    """"study.cap=100" and the like as a tree of changes; values are JSON, or else text. Later ones win."""
    out: dict = {}
    for o in overrides:
        name, sign, text = o.partition("=")
        if not sign or not name:
            raise ValueError(f"{o!r} is not name=value")
        *parts, last = name.split(".")
        at = out
        for p in parts:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise ValueError(f"{name} goes through a value")
        at[last] = _value(text)
    return out


def load(path: str | None = None, overrides: list[str] | None = None, base: Experiment | None = None) -> Experiment:
    """The experiment of a JSON or YAML file on top of ``base``, the overrides on top of that."""
    out = base or Experiment()
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            found = yaml.safe_load(text)
        else:
            found = json.loads(text)
        out = merged(out, found or {})
    return merged(out, nested(overrides or []))


def dump(e: Experiment, path: str) -> None:
    """The whole tree as JSON, which ``load`` reads back to an equal one."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(dataclasses.asdict(e), f, indent=1, sort_keys=True)
