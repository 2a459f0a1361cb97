"""Channels and feature types behind column names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The endings that name a feature type.
FEATURE_TYPES = ("Mean", "Std", "Variance", "Entropy", "DeltaPower", "ThetaPower", "AlphaPower", "BetaPower", "GammaPower")


def split_name(name: str) -> tuple[str, str]:
    """Channel and feature type; a name without a known ending is a channel's Value."""
    for t in sorted(FEATURE_TYPES, key=lambda t: (-len(t), t)):
        if name.endswith(t) and len(name) > len(t):
            return name[: -len(t)], t
    return name, "Value"


def channel_of(c: Column) -> Column:
    return F.regexp_replace(c, _ENDING, "")


def type_of(c: Column) -> Column:
    t = F.regexp_extract(c, _ENDING, 1)
    return F.when(t == "", "Value").otherwise(t)


_ENDING = "(?<=.)(" + "|".join(sorted(FEATURE_TYPES, key=lambda t: (-len(t), t))) + ")$"


@dataclass
class Layout:
    columns: list[str]

    def __post_init__(self) -> None:
        pairs = [split_name(c) for c in self.columns]
        self.channels = list(dict.fromkeys(c for c, _ in pairs))
        self.types = list(dict.fromkeys(t for _, t in pairs))
        self.pairs = pairs

    @property
    def regular(self) -> bool:
        return len(self.channels) * len(self.types) == len(self.columns)

    def channel_groups(self) -> list[list[int]]:
        return [[i for i, (c, _) in enumerate(self.pairs) if c == ch] for ch in self.channels]

    def band_groups(self) -> list[list[int]]:
        return [[i for i, (_, t) in enumerate(self.pairs) if t == ty] for ty in self.types if ty.endswith("Power")]

    def grid(self, x: Column) -> Column:
        """A row's features as channels x types."""
        if not self.regular:
            raise ValueError("the layout is not regular")
        at = {p: i for i, p in enumerate(self.pairs)}
        return F.array(*[F.array(*[F.get(x, at[c, t]) for t in self.types]) for c in self.channels])
