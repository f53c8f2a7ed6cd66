"""Plain versions of the tracing fits, skill by skill with whole padded matrices or loops, to hold the engine's against."""

from __future__ import annotations

import numpy as np


def _expectations(seqs: np.ndarray, mask: np.ndarray, prior: float, learn: float, guess: float, slip: float):
    """Scaled forward-backward of all padded sequences at once: posteriors, expected learning and log-likelihood."""
    n, length = seqs.shape
    emit = np.where(mask[..., None], np.where(seqs[..., None] == 1, [guess, 1 - slip], [1 - guess, slip]), 1.0)
    move = np.array([[1 - learn, learn], [0.0, 1.0]])
    alpha, scale = np.zeros((n, length, 2)), np.ones((n, length))
    now = np.array([1 - prior, prior]) * emit[:, 0]
    for t in range(length):
        if t:
            now = (alpha[:, t - 1] @ move) * emit[:, t]
        scale[:, t] = np.maximum(now.sum(1), 1e-300)
        alpha[:, t] = now / scale[:, t, None]
    beta = np.ones((n, length, 2))
    for t in range(length - 2, -1, -1):
        beta[:, t] = ((emit[:, t + 1] * beta[:, t + 1]) @ move.T) / scale[:, t + 1, None]
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(2, keepdims=True), 1e-300)
    stay = np.zeros(2)
    if length > 1:
        both = alpha[:, :-1, 0, None] * move[0] * (emit[:, 1:] * beta[:, 1:]) / scale[:, 1:, None]
        stay = (both * mask[:, 1:, None]).sum((0, 1))
    return gamma, stay, float((np.log(scale) * mask).sum())


def fit_skill(sequences: list[np.ndarray], seed: int, restarts: int = 5, iterations: int = 100, tolerance: float = 1e-4) -> dict[str, float]:
    """Parameters with the best likelihood over random starts."""
    length = max(map(len, sequences))
    seqs, mask = np.zeros((len(sequences), length), int), np.zeros((len(sequences), length), bool)
    for i, s in enumerate(sequences):
        seqs[i, : len(s)], mask[i, : len(s)] = s, True
    rng, best, best_ll = np.random.default_rng(seed), None, -np.inf
    for _ in range(restarts):
        prior, learn, guess, slip = rng.uniform(0.05, 0.5), *rng.uniform(0.05, 0.4, 3)
        before = -np.inf
        for _ in range(iterations):
            gamma, move, ll = _expectations(seqs, mask, prior, learn, guess, slip)
            known, unknown = gamma[..., 1] * mask, gamma[..., 0] * mask
            prior = float(np.clip(gamma[:, 0, 1].mean(), 0.001, 0.999))
            learn = float(np.clip(move[1] / max(move.sum(), 1e-300), 0.001, 0.999))
            guess = float(np.clip((unknown * seqs).sum() / max(unknown.sum(), 1e-300), 0.001, 0.49))
            slip = float(np.clip((known * (1 - seqs)).sum() / max(known.sum(), 1e-300), 0.001, 0.49))
            if ll - before < tolerance:
                break
            before = ll
        if ll > best_ll:
            best, best_ll = (prior, learn, guess, slip), ll
    return dict(zip(("prior", "learns", "guesses", "slips"), best, strict=True))


def fit_filtered_skill(sequences: list[list[int]], seed: int = 221, iterations: int = 30, cap: float = 0.5) -> dict[str, float]:
    """Forward-only expectations, one label after the other."""
    rng = np.random.default_rng(seed)
    prior, learn, guess, slip = rng.uniform(0.1, 0.9), rng.uniform(0.05, 0.4), min(rng.uniform(0.1, 0.4), 0.5), min(rng.uniform(0.05, 0.3), 0.5)
    share = lambda a, b, old: a / b if b > 1e-12 else old
    for _ in range(iterations):
        starts, count, moved, stayed, tally = 0.0, 0, 0.0, 0.0, {(k, y): 0.0 for k in (0, 1) for y in (0, 1)}
        for seq in sequences:
            belief, states = prior, []
            for y in seq:
                known = belief * ((1 - slip) if y else slip)
                total = known + (1 - belief) * (guess if y else 1 - guess)
                if total <= 0:
                    states = None
                    break
                states.append(known / total)
                belief = states[-1] + (1 - states[-1]) * learn
            if states is None:
                continue
            starts, count = starts + states[0], count + 1
            for g, y in zip(states, seq):
                tally[1, y] += g
                tally[0, y] += 1 - g
            moved += sum((1 - g) * learn for g in states[:-1])
            stayed += sum((1 - g) - (1 - g) * learn for g in states[:-1])
        prior, learn = share(starts, count, prior), share(moved, moved + stayed, learn)
        guess = min(share(tally[0, 1], tally[0, 0] + tally[0, 1], guess), cap)
        slip = min(share(tally[1, 0], tally[1, 0] + tally[1, 1], slip), cap)
    clip = lambda x, top: float(min(max(x, 1e-6), top))
    return {"prior": clip(prior, 1 - 1e-6), "learns": clip(learn, 1 - 1e-6), "guesses": clip(guess, 0.5), "slips": clip(slip, 0.5)}
