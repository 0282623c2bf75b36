"""Matrices inside the sequential kernel: rows of numbers, na as None, the same rules as the matrix columns."""

from __future__ import annotations

import statistics

import numpy as np

from barframe.functions.matrices import EPS, _eigenvectors


class Grid:
    """A matrix that programs change in place."""

    def __init__(self, rows: list[list]):
        self.rows = rows

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.rows), len(self.rows[0]) if self.rows else 0

    def cells(self) -> list:
        return [x for r in self.rows for x in r]

    def numbers(self) -> list:
        return [x for x in self.cells() if x is not None]

    def array(self) -> np.ndarray | None:
        a = np.array([[np.nan if x is None else x for x in r] for r in self.rows], float)
        return a if a.ndim == 2 and a.size and np.isfinite(a).all() else None

    def square(self) -> np.ndarray | None:
        a = self.array()
        return a if a is not None and a.shape[0] == a.shape[1] else None

    def map(self, f) -> Grid:
        return Grid([[f(x, i, j) for j, x in enumerate(r)] for i, r in enumerate(self.rows)])


def _plain(f):
    """na for na operands."""
    return lambda *x: None if any(v is None for v in x) else f(*x)


def _both(m: Grid, other, f) -> Grid:
    g = _plain(f)
    if isinstance(other, Grid):
        return Grid([[g(a, b) for a, b in zip(r, s)] for r, s in zip(m.rows, other.rows)])
    return m.map(lambda x, i, j: g(x, other))


def _wrap(a: np.ndarray | None) -> Grid | None:
    return None if a is None else Grid(a.tolist())


def _mult(m: Grid, other):
    if isinstance(other, Grid):
        if m.shape[1] != other.shape[0]:
            return None
        columns = list(zip(*other.rows))
        return Grid([[_dot(r, c) for c in columns] for r in m.rows])
    if isinstance(other, list):
        return [_dot(r, other) for r in m.rows] if m.shape[1] == len(other) else None
    return _both(m, other, lambda a, b: a * b)


def _dot(a, b):
    return None if any(x is None for x in (*a, *b)) else sum(x * y for x, y in zip(a, b))


def _regular(m: Grid) -> np.ndarray | None:
    a = m.square()
    return None if a is None or np.linalg.matrix_rank(a, tol=EPS) < len(a) else a


def _inv(m: Grid):
    a = _regular(m)
    return None if a is None else _wrap(np.linalg.inv(a))


def _det(m: Grid):
    a = m.square()
    return None if a is None else 0.0 if _regular(m) is None else float(np.linalg.det(a))


def _pow(m: Grid, power):
    a = m.square()
    return None if a is None or power != int(power) or power < 0 else _wrap(np.linalg.matrix_power(a, int(power)))


def _eigenvalues(m: Grid):
    a = m.square()
    return None if a is None else np.sort(np.linalg.eigvals(a).real)[::-1].tolist()


def _vectors(m: Grid):
    a = m.square()
    return None if a is None else _wrap(_eigenvectors(a))


def _sort(m: Grid, column=0, order="ascending") -> None:
    sign = -1 if "desc" in str(order) else 1
    m.rows.sort(key=lambda r: (r[int(column)] is None, sign * (r[int(column)] or 0)))


def _fill(m: Grid, x, r0=0, r1=None, c0=0, c1=None) -> None:
    rows, columns = m.shape
    for i in range(int(r0), rows if r1 is None else min(int(r1), rows)):
        for j in range(int(c0), columns if c1 is None else min(int(c1), columns)):
            m.rows[i][j] = x


def _reshape(m: Grid, r, c) -> None:
    flat, r, c = m.cells(), int(r), int(c)
    if len(flat) == r * c:
        m.rows[:] = [flat[i * c : (i + 1) * c] for i in range(r)]


def _swap_columns(m: Grid, a, b) -> None:
    for r in m.rows:
        r[int(a)], r[int(b)] = r[int(b)], r[int(a)]


def _swap_rows(m: Grid, a, b) -> None:
    m.rows[int(a)], m.rows[int(b)] = m.rows[int(b)], m.rows[int(a)]


def _concat(m: Grid, other: Grid) -> Grid:
    if m.shape[1] == other.shape[1]:
        m.rows += [list(r) for r in other.rows]
    return m


def _add_col(m: Grid, at=None, values=None) -> None:
    at, values = (None, at) if values is None and isinstance(at, list) else (at, values)
    if not m.rows and values:
        m.rows += [[] for _ in values]
    for i, r in enumerate(m.rows):
        r.insert(len(r) if at is None else int(at), None if values is None else values[i])


def _add_row(m: Grid, at=None, values=None) -> None:
    at, values = (None, at) if values is None and isinstance(at, list) else (at, values)
    m.rows.insert(len(m.rows) if at is None else int(at), [None] * m.shape[1] if values is None else list(values))


def _remove_row(m: Grid, i=None) -> list | None:
    at = len(m.rows) - 1 if i is None else int(i)
    return m.rows.pop(at) if 0 <= at < len(m.rows) else None


def _remove_col(m: Grid, j=None) -> list:
    return [r.pop(len(r) - 1 if j is None else int(j)) for r in m.rows]


def _every(m: Grid, f, square: bool = True) -> bool:
    n, k = m.shape
    return (not square or n == k) and all(x is not None and f(x, i, j) for i, r in enumerate(m.rows) for j, x in enumerate(r))


def _cell(m: Grid, i, j):
    return m.rows[int(i)][int(j)] if 0 <= i < m.shape[0] and 0 <= j < m.shape[1] else None


def _put(m: Grid, i, j, x) -> None:
    if 0 <= i < m.shape[0] and 0 <= j < m.shape[1]:
        m.rows[int(i)][int(j)] = x


def _part(m: Grid, r0=0, r1=None, c0=0, c1=None) -> Grid:
    end = lambda x: None if x is None else int(x)
    return Grid([r[int(c0) : end(c1)] for r in m.rows[int(r0) : end(r1)]])


def _kron(a: Grid, b: Grid) -> Grid:
    times = _plain(lambda x, y: x * y)
    return Grid([[times(x, y) for x in r for y in s] for r in a.rows for s in b.rows])


def _of(f):
    """A reducer of the known cells, na without any."""
    return lambda m: f(m.numbers()) if m.numbers() else None


def _trace(m: Grid):
    n, k = m.shape
    return _plain(lambda *x: float(sum(x)))(*[m.rows[i][i] for i in range(n)]) if n == k else None


MATRIX = {
    "new": lambda rows=0, columns=0, initial_value=None: Grid([[initial_value] * int(columns) for _ in range(int(rows))]),
    "copy": lambda m: Grid([list(r) for r in m.rows]),
    "rows": lambda m: m.shape[0],
    "columns": lambda m: m.shape[1],
    "elements_count": lambda m: m.shape[0] * m.shape[1],
    "get": _cell,
    "set": _put,
    "row": lambda m, i: list(m.rows[int(i)]) if 0 <= i < m.shape[0] else None,
    "col": lambda m, j: [r[int(j)] for r in m.rows] if 0 <= j < m.shape[1] else None,
    "add_row": _add_row,
    "add_col": _add_col,
    "remove_row": _remove_row,
    "remove_col": _remove_col,
    "swap_rows": _swap_rows,
    "swap_columns": _swap_columns,
    "fill": _fill,
    "reshape": _reshape,
    "submatrix": _part,
    "concat": _concat,
    "transpose": lambda m: Grid([list(r) for r in zip(*m.rows)]),
    "reverse": lambda m: m.rows.__setitem__(slice(None), [r[::-1] for r in m.rows[::-1]]),
    "sort": _sort,
    "sum": lambda m, x: _both(m, x, lambda a, b: a + b),
    "diff": lambda m, x: _both(m, x, lambda a, b: a - b),
    "mult": _mult,
    "kron": _kron,
    "pow": _pow,
    "avg": _of(lambda v: sum(v) / len(v)),
    "min": _of(min),
    "max": _of(max),
    "median": _of(statistics.median),
    "mode": _of(lambda v: min(statistics.multimode(v))),
    "trace": _trace,
    "det": _det,
    "inv": _inv,
    "pinv": lambda m: None if (a := m.array()) is None else _wrap(np.linalg.pinv(a)),
    "rank": lambda m: None if (a := m.array()) is None else int(np.linalg.matrix_rank(a, tol=EPS)),
    "eigenvalues": _eigenvalues,
    "eigenvectors": _vectors,
    "is_square": lambda m: m.shape[0] == m.shape[1],
    "is_zero": lambda m: _every(m, lambda x, i, j: x == 0, False),
    "is_binary": lambda m: _every(m, lambda x, i, j: x in (0, 1), False),
    "is_identity": lambda m: _every(m, lambda x, i, j: x == (i == j)),
    "is_diagonal": lambda m: _every(m, lambda x, i, j: i == j or x == 0),
    "is_antidiagonal": lambda m: _every(m, lambda x, i, j: i + j == m.shape[0] - 1 or x == 0),
    "is_symmetric": lambda m: _every(m, lambda x, i, j: x == m.rows[j][i]),
    "is_antisymmetric": lambda m: _every(m, lambda x, i, j: m.rows[j][i] is not None and x == -m.rows[j][i]),
    "is_triangular": lambda m: _every(m, lambda x, i, j: i <= j or x == 0) or _every(m, lambda x, i, j: i >= j or x == 0),
    "is_stochastic": lambda m: _every(m, lambda x, i, j: x >= 0) and all(abs(sum(r) - 1) <= 1e-10 for r in m.rows),
}
