"""Small numpy versions of the reference's model steps (scipy / sklearn are
not installed): StandardScaler, Ridge with intercept, KFold, RidgeCV."""

from __future__ import annotations

import numpy as np


def scaler(X):
    mu = X.mean(axis=0)
    sd = X.std(axis=0)
    sd[sd < 10 * np.finfo(float).eps * np.maximum(1.0, np.abs(mu))] = 1.0
    return mu, sd


def ridge_fit(X, y, alpha):
    xm, ym = X.mean(axis=0), y.mean()
    Xc, yc = X - xm, y - ym
    beta = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(X.shape[1]), Xc.T @ yc)
    return beta, ym - xm @ beta


def r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def pearson_r2(y, p):
    return np.corrcoef(y, p)[0, 1] ** 2


def kfold_slices(n, k):
    sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
    out, start = [], 0
    for s in sizes:
        out.append(np.arange(start, start + s))
        start += s
    return out


def ridge_cv(X, y, alphas, k, metric=r2):
    """Scale on all rows, CV contiguous folds, first best alpha, refit.
    Returns (alpha, beta_unscaled, intercept, mean_cv_score)."""
    mu, sd = scaler(X)
    Z = (X - mu) / sd
    folds = kfold_slices(len(y), k)
    means = []
    for a in alphas:
        sc = []
        for f in folds:
            tr = np.setdiff1d(np.arange(len(y)), f)
            b, b0 = ridge_fit(Z[tr], y[tr], a)
            sc.append(metric(y[f], Z[f] @ b + b0))
        means.append(np.mean(sc))
    best = int(np.argmax(means))
    b, b0 = ridge_fit(Z, y, alphas[best])
    beta = b / sd
    return alphas[best], beta, b0 - mu @ beta, means[best]


def power_transform(x, lams, method):
    """``[len(lams), len(x)]`` Box-Cox or Yeo-Johnson values."""
    lam = np.asarray(lams)[:, None]

    def one(log, power):
        small = np.abs(power) < 1e-12
        safe = np.where(small, 1.0, power)
        return np.where(small, log, np.expm1(safe * log) / safe)

    if method == "boxcox":
        return one(np.log(x)[None, :], lam)
    size = np.log1p(np.abs(x))[None, :]
    return np.where(x[None, :] >= 0, one(size, lam), -one(size, 2.0 - lam))


def llf(x, lams, method):
    """Profile log-likelihood of each lambda."""
    jac = np.log(x).sum() if method == "boxcox" else (np.sign(x) * np.log1p(np.abs(x))).sum()
    return (np.asarray(lams) - 1) * jac - len(x) / 2 * np.log(power_transform(x, lams, method).var(axis=1))
