"""Names of the rolling columns, generated from the number of matches X."""

from __future__ import annotations

from dataclasses import dataclass

DEFAULT_XS = (1, 2, 3, 5)


@dataclass(frozen=True)
class Family:
    """One kind of points: per-match columns ``off`` and ``deff``, and their sum ``diff``."""

    off: str
    deff: str
    diff: str

    @property
    def names(self) -> tuple[str, str, str]:
        return (self.off, self.deff, self.diff)


NEUTRAL = Family("off", "def", "diff")
RANKED = Family("ranked_off", "ranked_def", "ranked_diff")


def playtime_col(x: int) -> str:
    return f"playtime_last_{x}"


def total_col(name: str, x: int) -> str:
    return f"total_{name}_last_{x}"


def avg_col(name: str, x: int) -> str:
    return f"avg_{name}_last_{x}"


def rolling_columns(xs, families) -> list[str]:
    """All rolling columns, X by X: playtime, then totals, then averages."""
    out: list[str] = []
    for x in xs:
        out.append(playtime_col(x))
        out += [total_col(n, x) for f in families for n in f.names]
        out += [avg_col(n, x) for f in families for n in f.names]
    return out


def attribute_columns(xs, families) -> list[str]:
    """The columns a model is trained on: playtime, and offensive and defensive points."""
    out: list[str] = []
    for x in xs:
        out.append(playtime_col(x))
        for f in families:
            out += [total_col(f.off, x), total_col(f.deff, x)]
            out += [avg_col(f.off, x), avg_col(f.deff, x)]
    return out


def averages_in(attributes) -> dict[str, tuple[str, str]]:
    """Of ``attributes`` the averages that follow from two others: name -> (total, playtime)."""
    parts = {avg: avg.removeprefix("avg_").rpartition("_last_") for avg in attributes if avg.startswith("avg_")}
    found = {avg: (total_col(name, x), playtime_col(x)) for avg, (name, _, x) in parts.items()}
    return {avg: both for avg, both in found.items() if set(both) <= set(attributes)}


ATTRIBUTE_ORDER = attribute_columns(DEFAULT_XS, (NEUTRAL,))

# The numbers of matches whose columns the wide goal model is trained on.
WIDE_XS = (1, 2, 3, 4, 5, 6, 8, 13, 21)
WIDE_ATTRIBUTES = attribute_columns(WIDE_XS, (NEUTRAL, RANKED))
