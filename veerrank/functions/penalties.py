"""Scores that combine a positive and a negative stream: one Column expression per penalty, by name.

Inputs: sb (positive stream), sn (negative stream), tau (threshold, a constant or a query's own), mask (0 or 1), and
where a penalty needs it, og_rank (the document's rank for the unchanged query).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import relu, sigmoid, softplus


@dataclass(frozen=True)
class Streams:
    sb: Column
    sn: Column
    tau: Column
    mask: Column
    og_rank: Column | None = None


def _when(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def classic(s: Streams, alpha: float = 1.0) -> Column:
    return s.sb - alpha * relu(s.sn - s.tau) * s.mask


def masked_score(s: Streams, alpha: float = 1.0) -> Column:
    """The mask acts on the score before the threshold: differs from classic for tau < 0."""
    return s.sb - alpha * relu(s.sn * s.mask - s.tau)


def pat(s: Streams, alpha: float = 1.0, tau0: float = 0.0, lam: float = 0.2) -> Column:
    return s.sb - alpha * relu(s.sn - (tau0 + lam * s.sb)) * s.mask


def pat_protected(s: Streams, alpha: float = 1.0, tau0: float = 0.0, lam: float = 0.2, k: int = 5, factor: float = 0.0) -> Column:
    penalty = alpha * relu(s.sn - (tau0 + lam * s.sb)) * s.mask
    return s.sb - F.when(s.og_rank <= k, penalty * factor).otherwise(penalty)


def pat_hybrid(s: Streams, alpha: float = 1.0, tau0: float = 0.0, lam: float = 0.2, k: int = 5, factor: float = 0.0, boost: float = 0.5) -> Column:
    lifted = F.when((s.og_rank > k) & (s.og_rank <= 20), boost * s.sb).otherwise(0.0)
    return pat_protected(s, alpha, tau0, lam, k, factor) + lifted


def micro(s: Streams, alpha: float = 2.0, margin: float = 0.1, beta: float = 20.0) -> Column:
    return s.sb * (1 - alpha * softplus(s.sn - s.sb + margin, beta) * s.mask)


def _clamped(x: Column, most: float) -> Column:
    return F.least(relu(x), F.lit(most))


def micro_v2(s: Streams, alpha: float = 0.5, margin: float = -0.1, beta: float = 20.0, most: float = 0.5) -> Column:
    return s.sb * (1 - _clamped(alpha * softplus(s.sn - s.sb + margin, beta) * s.mask, most))


def micro_v3(s: Streams, alpha: float = 0.5, margin: float = -0.05, beta: float = 20.0, most: float = 0.5) -> Column:
    return s.sb * (1 - _clamped(alpha * softplus(s.sn - F.greatest(s.sb, s.tau) + margin, beta) * s.mask, most))


def hybrid(s: Streams, alpha: float = 0.3, margin: float = -0.05, beta: float = 20.0, most: float = 0.3) -> Column:
    return s.sb - _clamped(alpha * relu(s.sn - s.tau) * s.mask * softplus(s.sn - s.sb + margin, beta) * s.mask, most)


def hybrid_v2(s: Streams, alpha: float = 2.0, margin: float = 0.1, beta: float = 20.0) -> Column:
    return s.sb - alpha * softplus(s.sn - (s.sb - margin), beta) * s.mask


def hybrid_v3(s: Streams, alpha: float = 1.0, margin: float = -0.15, beta: float = 20.0) -> Column:
    return s.sb - alpha * softplus(s.sn - F.greatest(s.sb - margin, s.tau), beta) * s.mask


def soft(s: Streams, alpha: float = 1.0, beta: float = 20.0) -> Column:
    return s.sb - alpha * softplus(s.sn - s.tau, beta) * s.mask


def adaptive(s: Streams, alpha: float = 1.0, beta: float = 20.0) -> Column:
    return s.sb - alpha * (1 + (1 - s.sb)) * softplus(s.sn - s.tau, beta) * s.mask


def double_threshold(s: Streams, alpha: float = 1.0, margin: float = 0.05, beta: float = 20.0) -> Column:
    over = s.sn - s.tau
    return s.sb - (alpha * softplus(over, beta) + alpha * relu(over - margin)) * s.mask


def double_threshold_cut(s: Streams, alpha: float = 1.0, margin: float = 0.05, beta: float = 50.0) -> Column:
    return s.sb - alpha * F.when(s.sn >= s.tau - margin, softplus(s.sn - s.tau, beta)).otherwise(0.0) * s.mask


def hard(s: Streams, alpha: float = 1.0, beta: float = 50.0) -> Column:
    return s.sb - alpha * (relu(s.sn - s.tau) + softplus(s.sn - s.tau, beta)) * s.mask


def exponential(s: Streams, alpha: float = 1.0, gamma: float = 5.0) -> Column:
    return s.sb - alpha * (F.exp(gamma * relu(s.sn - s.tau)) - 1) / gamma * s.mask


def rank_aware(s: Streams, alpha: float = 1.0, beta: float = 50.0) -> Column:
    return s.sb - alpha * (1 + F.pow(1 - s.sb, 2)) * softplus(s.sn - s.tau, beta) * s.mask


def combined(s: Streams, alpha: float = 1.0, share: float = 0.5, beta: float = 50.0) -> Column:
    return s.sb - alpha * (share * relu(s.sn - s.tau) + (1 - share) * softplus(s.sn - s.tau, beta)) * s.mask


def conditional(s: Streams, alpha: float = 1.0, below: float = 0.7, beta: float = 50.0) -> Column:
    return s.sb - alpha * _when(s.sb < below) * softplus(s.sn - s.tau, beta) * s.mask


def gradual(s: Streams, alpha: float = 1.0, below: float = 0.7, beta: float = 50.0) -> Column:
    return s.sb - alpha * (1 - sigmoid(10 * (s.sb - below))) * softplus(s.sn - s.tau, beta) * s.mask


def smart(s: Streams, alpha: float = 1.0, beta: float = 50.0) -> Column:
    return s.sb - alpha * sigmoid(10 * (s.sn - s.sb)) * softplus(s.sn - s.tau, beta) * s.mask


def selective(s: Streams, alpha: float = 1.0, below: float = 0.5, boost: float = 0.1, beta: float = 50.0) -> Column:
    return s.sb - alpha * sigmoid(10 * (s.sn - s.sb + boost)) * sigmoid(10 * (below - s.sb)) * softplus(s.sn - s.tau, beta) * s.mask


def harm_aware(s: Streams, alpha: float = 1.0, gamma: float = 1.0, beta: float = 50.0) -> Column:
    return s.sb - alpha * F.exp(gamma * relu(s.sn - s.sb)) * softplus(s.sn - s.tau, beta) * s.mask


def triple(s: Streams, alpha: float = 1.0, below: float = 0.5, above: float = 0.3, beta: float = 50.0) -> Column:
    return s.sb - alpha * _when(s.sb < below) * _when(s.sn > above) * _when(s.sn > s.tau) * softplus(s.sn - s.tau, beta) * s.mask


PENALTIES: dict[str, Callable[..., Column]] = {
    f.__name__: f
    for f in (classic, masked_score, pat, pat_protected, pat_hybrid, micro, micro_v2, micro_v3, hybrid, hybrid_v2, hybrid_v3, soft, adaptive, double_threshold, double_threshold_cut, hard, exponential, rank_aware, combined, conditional, gradual, smart, selective, harm_aware, triple)
}


def penalty(name: str) -> Callable[..., Column]:
    if name not in PENALTIES:
        raise ValueError(f"unknown penalty {name!r}; known: {', '.join(sorted(PENALTIES))}")
    return PENALTIES[name]


def _classic_array(sb: np.ndarray, sn: np.ndarray, tau: float, mask: float, og_rank: np.ndarray | None, alpha: float = 1.0) -> np.ndarray:
    return sb - alpha * np.maximum(sn - tau, 0.0) * mask


def _exponential_array(sb: np.ndarray, sn: np.ndarray, tau: float, mask: float, og_rank: np.ndarray | None, alpha: float = 1.0, gamma: float = 5.0) -> np.ndarray:
    return sb - alpha * (np.exp(gamma * np.maximum(sn - tau, 0.0)) - 1) / gamma * mask


def _pat_array(sb: np.ndarray, sn: np.ndarray, tau: float, mask: float, og_rank: np.ndarray | None, alpha: float = 1.0, tau0: float = 0.0, lam: float = 0.2) -> np.ndarray:
    return sb - alpha * np.maximum(sn - (tau0 + lam * sb), 0.0) * mask


def _pat_protected_array(sb: np.ndarray, sn: np.ndarray, tau: float, mask: float, og_rank: np.ndarray, alpha: float = 1.0, tau0: float = 0.0, lam: float = 0.2, k: int = 5, factor: float = 0.0) -> np.ndarray:
    penalty = alpha * np.maximum(sn - (tau0 + lam * sb), 0.0) * mask
    return sb - np.where(og_rank <= k, penalty * factor, penalty)


def _pat_hybrid_array(sb: np.ndarray, sn: np.ndarray, tau: float, mask: float, og_rank: np.ndarray, alpha: float = 1.0, tau0: float = 0.0, lam: float = 0.2, k: int = 5, factor: float = 0.0, boost: float = 0.5) -> np.ndarray:
    return _pat_protected_array(sb, sn, tau, mask, og_rank, alpha, tau0, lam, k, factor) + np.where((og_rank > k) & (og_rank <= 20), boost * sb, 0.0)


#: Penalties over arrays of one query's scores, for tasks that hold no row for a pair.
ARRAYS: dict[str, Callable[..., np.ndarray]] = {"classic": _classic_array, "exponential": _exponential_array, "pat": _pat_array, "pat_protected": _pat_protected_array, "pat_hybrid": _pat_hybrid_array}


def method(name: str) -> Callable[..., Column]:
    """The two methods of the plain scorer: micro, or classic for any other name."""
    return micro if name == "micro" else classic


def gated(s: Streams, raw_alpha: Column, raw_tau: Column) -> Column:
    """The classic penalty with a raw gate: softplus gives alpha, a sigmoid tau."""
    return classic(Streams(s.sb, s.sn, sigmoid(raw_tau), s.mask), softplus(raw_alpha))
