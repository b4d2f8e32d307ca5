"""Leading eigenvectors of a symmetric matrix that is only known by its products with blocks of vectors.

Block Jacobi-Davidson: a subspace grows by the solutions of projected correction equations, which MINRES
solves inexactly for all wanted vectors at once; Rayleigh-Ritz takes the best vectors of the subspace, and
those whose residual is down to rounding are locked.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Product = Callable[[np.ndarray], np.ndarray]

EPS = float(np.finfo(np.float64).eps)

# A residual counts as rounding when it is below this many units of the largest eigenvalue.
ROUNDING = 16 * EPS


def leading_eigenvectors(
    product: Product, size: int, wanted: int, inner_steps: int = 4, most_columns: int = 48, seed: int = 1,
    most_rounds: int = 300,
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors as columns, the largest entry positive.

    ``product`` multiplies the matrix by a block of columns; each call is one pass over the data behind it.
    ``size`` is the order of the matrix; the subspace never has more than ``most_columns`` columns. The rounds
    end when all residuals are below ``ROUNDING``, or have stopped falling at the level that the rounding
    of the products allows.
    """
    wanted = min(wanted, size)
    most_columns = min(size, max(most_columns, 4 * wanted))
    locked = np.zeros((size, 0))
    locked_values: list[float] = []
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, min(size, wanted + 4))))[0]
    image = product(basis)
    best, stalled = np.inf, 0
    for round_ in range(most_rounds):
        values, turn = np.linalg.eigh(_symmetric(basis.T @ image))
        values, turn = values[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        todo = min(wanted - len(locked_values), basis.shape[1])
        residual = image[:, :todo] - basis[:, :todo] * values[:todo]
        residual -= locked @ (locked.T @ residual)
        error = np.linalg.norm(residual, axis=0)
        scale = max([abs(values[0]), *locked_values])
        worst = float(error.max())
        stalled = 0 if worst < best / 2 else stalled + 1
        best = min(best, worst)
        # Where products carry more rounding than the limit, residuals stop falling close above it.
        done = error <= max(ROUNDING * scale, 2 * best if stalled >= 3 and best <= 1e-11 * scale else 0.0)
        n_done = int(np.argmin(done)) if not done.all() else todo
        whole = basis.shape[1] + len(locked_values) >= size
        if whole:
            n_done = todo  # the subspace is the whole space, its Ritz vectors are the eigenvectors
        if n_done:
            locked = np.linalg.qr(np.hstack([locked, basis[:, :n_done]]))[0]
            locked_values += [float(v) for v in values[:n_done]]
            basis, image = basis[:, n_done:], image[:, n_done:]
            residual, values = residual[:, n_done:todo], values[n_done:]
            best, stalled = np.inf, 0
        todo = wanted - len(locked_values)
        if not todo:
            break
        if basis.shape[1] + todo > most_columns - locked.shape[1]:
            basis, image = basis[:, : 2 * wanted], image[:, : 2 * wanted]
        if residual.shape[1]:
            fixed = np.hstack([locked, basis[:, : residual.shape[1]]])
            steps = _corrections(product, fixed, values[: residual.shape[1]], residual, inner_steps, 2.0 ** -(round_ + 1))
        else:
            steps = np.zeros((size, 0))
        new = _new_directions(np.hstack([locked, basis]), steps, seed + round_ + 1)
        basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
    else:
        raise ArithmeticError("the eigenvectors did not converge")
    return _finished(product, locked)


def _symmetric(m: np.ndarray) -> np.ndarray:
    return (m + m.T) / 2


def _finished(product: Product, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One more Rayleigh-Ritz on the locked vectors together, which also puts them into order."""
    values, turn = np.linalg.eigh(_symmetric(vectors.T @ product(vectors)))
    vectors = np.linalg.qr(vectors @ turn[:, ::-1])[0]
    top = np.abs(vectors).argmax(axis=0)
    signs = np.sign(vectors[top, np.arange(vectors.shape[1])])
    return np.maximum(values[::-1], 0.0), vectors * np.where(signs == 0, 1.0, signs)


def _new_directions(basis: np.ndarray, steps: np.ndarray, seed: int) -> np.ndarray:
    """Orthonormal columns of ``steps`` outside ``basis``; a random one if nothing is left of them."""
    room = basis.shape[0] - basis.shape[1]
    out = np.zeros((basis.shape[0], 0))
    spare = np.random.default_rng(seed).standard_normal((basis.shape[0], 1))
    for column in [*steps.T, *spare.T]:
        if out.shape[1] == room or (out.shape[1] and column is spare.T[0]):
            break
        size = np.linalg.norm(column)
        for _ in range(3):
            for against in (basis, out):
                column = column - against @ (against.T @ column)
        left = np.linalg.norm(column)
        if left > 1e-10 * size:
            out = np.hstack([out, (column / left)[:, None]])
    return out


def _corrections(
    product: Product, fixed: np.ndarray, shifts: np.ndarray, residual: np.ndarray, steps: int, reduce_to: float
) -> np.ndarray:
    """Solve (I - QQ')(A - shift I)(I - QQ') t = -residual for every column, with Q the ``fixed`` columns.

    MINRES for all columns side by side: each step is one product with a block. It ends after ``steps`` steps, or
    when all residuals are down to ``reduce_to`` of their start.
    """

    def outside(x: np.ndarray) -> np.ndarray:
        return x - fixed @ (fixed.T @ x)

    v = -outside(residual)
    beta = np.linalg.norm(v, axis=0)
    start, eta = beta.copy(), beta.copy()
    v = v / np.where(beta > 0, beta, 1.0)
    x, v_old, w, w_old = (np.zeros_like(v) for _ in range(4))
    c, c_old, s, s_old = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    active = beta > 0
    for _ in range(steps):
        if not active.any():
            break
        p = outside(product(v) - v * shifts)
        alpha = (v * p).sum(axis=0)
        p = p - v * alpha - v_old * beta
        beta_new = np.linalg.norm(p, axis=0)
        # The new column of the tridiagonal matrix under the last two rotations, then a third one.
        delta = c * alpha - c_old * s * beta
        rho_1 = np.hypot(delta, beta_new)
        rho_2 = s * alpha + c_old * c * beta
        rho_3 = s_old * beta
        active &= rho_1 > 0
        rho = np.where(rho_1 > 0, rho_1, 1.0)
        c_new, s_new = delta / rho, beta_new / rho
        w_new = (v - w_old * rho_3 - w * rho_2) / rho
        x = np.where(active, x + w_new * (c_new * eta), x)
        eta = np.where(active, -s_new * eta, eta)
        v_old, v = v, p / np.where(beta_new > 0, beta_new, 1.0)
        w_old, w, c_old, c, s_old, s, beta = w, w_new, c, c_new, s, s_new, beta_new
        active &= (beta_new > EPS * np.abs(shifts).max(initial=0.0)) & (np.abs(eta) > reduce_to * start)
    return outside(x)
