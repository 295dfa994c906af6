"""The training method restated on numpy arrays, for comparison in tests."""

import numpy as np


def loss_and_gradient(x, y, w, reg):
    z = x @ w
    loss = np.maximum(z, 0) - y * z + np.log1p(np.exp(-np.abs(z)))
    residual = 1 / (1 + np.exp(-z)) - y
    return loss.mean() + reg / 2 * (w @ w), x.T @ residual / len(y) + reg * w


def vector_two_loop(pairs, g):
    """The textbook recursion on full vectors."""
    q, alphas = g.copy(), []
    for s, t in reversed(pairs):
        alpha = (s @ q) / (s @ t)
        q -= alpha * t
        alphas.append(alpha)
    s, t = pairs[-1]
    q *= (s @ t) / (t @ t)
    for (s, t), alpha in zip(pairs, reversed(alphas)):
        q += (alpha - (t @ q) / (s @ t)) * s
    return -q


def train(x, y, reg, num_iters, corrections, tol=1e-10):
    """Objectives of all computed steps, step lengths, and the kept weights."""
    w = np.zeros(x.shape[1])
    f, g = loss_and_gradient(x, y, w, reg)
    pairs, objectives, lengths = [], [f], []
    for k in range(num_iters - 1):
        d = -0.5 * g if k < 3 else vector_two_loop(pairs, g)
        slope, a = g @ d, 1.0
        if slope >= 0:
            break
        while True:
            new_f, new_g = loss_and_gradient(x, y, w + a * d, reg)
            if new_f < f + a * 1e-5 * slope:
                break
            a /= 2
        objectives.append(new_f)
        lengths.append(a)
        if f - new_f < tol:
            break
        pairs = [*pairs, (a * d, new_g - g)][-corrections:]
        w, f, g = w + a * d, new_f, new_g
    return objectives, lengths, w


def optimum(x, y, reg):
    """Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        _, g = loss_and_gradient(x, y, w, reg)
        s = 1 / (1 + np.exp(-(x @ w)))
        h = (x * (s * (1 - s))[:, None]).T @ x / len(y) + reg * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def auc(scores, labels):
    pos, neg = scores[labels > 0], scores[labels <= 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))
