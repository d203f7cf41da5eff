"""Energies and occupancies (M1 to M20 of the survey) as column functions and small matrix functions."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Temperature in kelvin, gas constant in kcal / (mol K).
T, R = 300.0, 1.987e-3
RT = R * T


def logistic(x: Column) -> Column:
    """M2."""
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    """M2."""
    return F.ln(p) - F.ln(1 - p)


def occupancy(mu: Column, energy: Column) -> Column:
    """M3, M6: share of sites bound at chemical potential mu."""
    return 1 / (1 + F.exp((energy - mu) / RT))


def log_occupancy(mu: Column, energy: Column) -> Column:
    """M4: -ln(1 + e^x) in three ranges."""
    x = (energy - mu) / RT
    return -F.when(x < -10, F.exp(x)).when(x < 35, F.log1p(F.exp(x))).otherwise(x)


def log_sum_exp(xs: Column) -> Column:
    """M5 of an array."""
    top = F.array_max(xs)
    return top + F.ln(F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def soft_min(xs: Column) -> Column:
    """mean of the values weighted by e^-x, from the smallest on."""
    low = F.array_min(xs)
    weight = F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.exp(low - x))
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x * F.exp(low - x)) / weight


def any_bound(p: Column) -> Column:
    """M16, an aggregate: the chance that at least one of independent sites is bound."""
    return 1 - F.exp(F.sum(F.ln(1 - p)))


def skipped_mse(label: Column, score: Column) -> Column:
    """L11, an aggregate: mean square error over rows that are not ambiguous."""
    return F.avg(F.when(label != -1, (score - label) * (score - label)))


def skipped_cross_entropy(label: Column, score: Column) -> Column:
    """L11, an aggregate: cross entropy over rows that are not ambiguous, scores clipped."""
    p = F.least(F.greatest(score, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.avg(F.when(label != -1, -(label * F.ln(p) + (1 - label) * F.ln(1 - p))))


def expected_f1_loss(label: Column, score: Column) -> Column:
    """L11, an aggregate: minus the F1 of expected counts."""
    hit = F.sum(F.when(label == 1, score))
    return -2 * hit / (F.sum(F.when(label != -1, score)) + F.sum(F.when(label == 1, 1.0)))


def log_abs_penalty(row: Column) -> Column:
    """L15 of an array: ln(1 + sum of absolute values)."""
    return F.log1p(F.aggregate(row, F.lit(0.0), lambda a, x: a + F.abs(x)))


def absolute_penalty(row: Column) -> Column:
    """L15 of an array: the sum of absolute values."""
    return F.aggregate(row, F.lit(0.0), lambda a, x: a + F.abs(x))


def negative_penalty(row: Column) -> Column:
    """L15 of an array: the sum of what lies below 0, (|x| - x) / 2."""
    return F.aggregate(row, F.lit(0.0), lambda a, x: a + (F.abs(x) - x) / 2)


def mole_fraction(concentration: float, volume: float = 1.0) -> float:
    """Moles in a volume per mole of water."""
    return concentration * volume / 55.5


# -- matrices of one motif: L rows of four numbers ----------------------------------------------------------------------


def clipped_log2(pwm: np.ndarray, low: float = 1e-4) -> np.ndarray:
    """log2 of 1 - p, clipped on both sides."""
    return np.log2(np.clip(1 - np.asarray(pwm, float), low, 1 - low))


def with_consensus(ddg: np.ndarray, consensus: float) -> np.ndarray:
    """The consensus energy is added to the first row."""
    out = np.array(ddg, float)
    out[0] += consensus
    return out


@dataclass(frozen=True)
class EnergyModel:
    """M7 to M9: energies in kcal/mol, a row of four for each position with a minimum of 0, above a consensus energy."""

    ddg: np.ndarray
    consensus: float = 0.0
    mean: float = 0.0


def energies_of_pwm(pwm: np.ndarray) -> EnergyModel:
    """M7: minus the logit of slightly shrunk probabilities, from 0 in each row, scaled so that the mean energy of a
    site is -2 and the consensus lies 1.5 for each position below it."""
    p = 5e-4 + (1 - 1e-3) * np.asarray(pwm, float)
    e = -np.log(p / (1 - p))
    e -= e.min(1, keepdims=True)
    return EnergyModel(e * (1.5 * len(e) / e.mean(1).sum()), -2.0 - 1.5 * len(e), -2.0)


def energy_range(ddg: np.ndarray, consensus: float = 0.0) -> tuple[float, float]:
    """M8, M9: lowest and highest energy of any site."""
    return consensus + float(np.min(ddg, 1).sum()), consensus + float(np.max(ddg, 1).sum())


def zeroed(ddg: np.ndarray, consensus: float = 0.0) -> tuple[np.ndarray, float]:
    """M8: rows shifted to a minimum of 0, what they lose added to the consensus energy."""
    low = np.min(ddg, 1, keepdims=True)
    return ddg - low, consensus + float(low.sum())


def updated(ddg: np.ndarray, consensus: float) -> EnergyModel:
    """M8: a model of new energies, rows shifted to 0; its mean energy is that of a single entry above the consensus."""
    ddg, consensus = zeroed(np.asarray(ddg, float), consensus)
    return EnergyModel(ddg, consensus, consensus + float(ddg.mean()))


def differences(model: EnergyModel) -> tuple[float, np.ndarray]:
    """M8: the energy of a site of A only, and for C, G, T (a row each) what they add at each position."""
    ddg = np.asarray(model.ddg, float)
    return model.consensus + float(ddg[:, 0].sum()), (ddg[:, 1:] - ddg[:, :1]).T


def contributions(diff: np.ndarray) -> np.ndarray:
    """M9: the rows of four of differences from A."""
    return np.column_stack([np.zeros(diff.shape[1]), np.asarray(diff).T])


def summary(model: EnergyModel) -> str:
    """M9: consensus, mean and lowest energy and the rows of a model as text."""
    rows = ["".join(f"{x:10.2f}" for x in r) for r in model.ddg]
    low, high = energy_range(model.ddg, model.consensus)
    return "\n".join([f"Consensus: {consensus(model.ddg)}", f"Mean: {model.mean:.4f}", f"Min: {low:.4f}", f"Max: {high:.4f}", "".join(f"{b:>10}" for b in "ACGT"), *rows])


def flipped(matrix: np.ndarray) -> np.ndarray:
    """M9: the matrix of the other strand."""
    return np.asarray(matrix)[::-1, ::-1]


def consensus(ddg: np.ndarray) -> str:
    """M9: the bases of lowest energy."""
    return "".join("ACGT"[i] for i in np.argmin(ddg, 1))


def partition_function(energies: np.ndarray, mu: float) -> float:
    """L7 in small: mean occupancy over given energies."""
    return float(np.mean(1 / (1 + np.exp((np.asarray(energies) - mu) / RT))))


def root(f, low: float, high: float, steps: int = 200) -> float:
    """L1: bisection of a falling or rising function."""
    sign = math.copysign(1, f(low))
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if math.copysign(1, f(mid)) == sign else (low, mid)
    return (low + high) / 2
