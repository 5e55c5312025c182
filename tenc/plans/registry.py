"""Encoders by name, as used in role maps, experiment grids and reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame

from tenc.operators.encoders.bayes import fit_empirical_bayes
from tenc.operators.encoders.heldout import fit_leave_one_out
from tenc.operators.encoders.plain import fit_counts
from tenc.operators.encoders.target import Shrinkage, fit
from tenc.operators.prepare import DELETE, NUMERICAL, ONE_HOT, SPECIAL


class Encoding(Protocol):
    """What a fitted encoder offers; ``apply_training`` may treat its own rows differently."""

    def apply(self, df: DataFrame, suffix: str = ...) -> DataFrame: ...


Fit = Callable[[DataFrame, str, str, str, str | None], Encoding]


@dataclass(frozen=True)
class FoldRule:
    """How a value follows from a category's rows and target sums in the training part of a fold.

    ``kind`` is ``target`` (with a shrinkage), ``left_out`` (a training row's own target is taken out) or ``count``.
    """

    kind: str
    shrinkage: Shrinkage | None = None
    noise: float = 0.0


@dataclass(frozen=True)
class Encoder:
    """A named encoder: ``fit(df, column, y, task, key)``, and its rule for all folds at once if it has one."""

    name: str
    fit: Fit
    fold_rule: FoldRule | None = None


def _target(kind: str = "bayes", **settings) -> tuple[Fit, FoldRule]:
    def rule(df, column, y, task, key):
        return fit(df, [column], y, task, kind, unknown="ignore", **settings)

    return rule, FoldRule("target", Shrinkage(kind, **settings))


def _leave_one_out(noise: float) -> tuple[Fit, FoldRule]:
    def rule(df, column, y, task, key):
        return fit_leave_one_out(df, [column], y, task, noise=noise, key=key)

    return rule, FoldRule("left_out", noise=noise)


def _empirical_bayes() -> tuple[Fit, FoldRule]:
    def rule(df, column, y, task, key):
        return fit_empirical_bayes(df, [column], y, task, k=5, f=1.0, noise=0.01, key=key)

    return rule, FoldRule("target", Shrinkage("sigmoid", k=5, f=1.0), noise=0.01)


def _counts() -> tuple[Fit, FoldRule]:
    return lambda df, column, y, task, key: fit_counts(df, [column]), FoldRule("count")


# Names and settings are fixed values: they identify runs in stored results.
ENCODERS: dict[str, Encoder] = {
    name: Encoder(name, *rule)
    for name, rule in {
        "TargetEncoder": _target(m="n_avg"),
        "TargetEncoder-shrinkage=bayes": _target(m="n_avg"),
        "TargetEncoder-shrinkage=bayes_1": _target(m=1),
        "TargetEncoder-shrinkage=exp_1_1": _target("exponential", k=1, f=1.0),
        "TargetEncoder-shrinkage=exp_5_1": _target("exponential", k=5, f=1.0),
        "TargetEncoder-dirty_cat": _target(m="n_avg"),
        "TargetEncoder-category_encoders": _target("exponential", k=1, f=1.0),
        "LeaveOneOutEncoder-category_encoders": _leave_one_out(0.0),
        "TargetEncoder-hcc-bayes": _empirical_bayes(),
        "TargetEncoder-hcc-loo": _leave_one_out(0.01),
        "CountEncoder": _counts(),
    }.items()
}


def register(name: str, rule: Fit) -> None:
    """Make a user's encoder available under ``name``."""
    if name in ENCODERS or name in ONE_HOT or name in (DELETE, NUMERICAL):
        raise ValueError(f"encoder {name!r} exists already")
    ENCODERS[name] = Encoder(name, rule)


def resolve(role: str | None, encoder: str) -> str:
    """The action for a column: its role, or the encoder under test for special columns."""
    action = encoder if role == SPECIAL else role
    if action is None or action in (DELETE, NUMERICAL) or action in ONE_HOT or action in ENCODERS:
        return action
    raise ValueError(f"unknown role or encoder {action!r}")
