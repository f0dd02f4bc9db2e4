"""Configuration, diagnostics and errors."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from enum import Enum

U32_MAX = 2**32 - 1
#: Distance from 1 to the next number, in double and in single precision.
EPS, EPS_SINGLE = 2.0**-52, 2.0**-23
#: Solved variables up to which a block is factored exactly unless told otherwise.
DEFAULT_MAX_DIM = 24


class ExactFailure(Enum):
    """What becomes of a block whose exact factorization meets an unusable pivot."""

    FALL_BACK = "fall_back_to_approximate"
    ERROR = "error"


class DenseFailure(Enum):
    NON_POSITIVE = "non_positive_pivot"
    NON_FINITE = "non_finite_pivot"


@dataclass(frozen=True)
class Backend:
    """Blocks of 1 to ``max_dim`` solved variables are factored exactly, others approximately; 0: none exactly."""

    max_dim: int = DEFAULT_MAX_DIM
    on_failure: ExactFailure = ExactFailure.FALL_BACK

    @staticmethod
    def approximate() -> Backend:
        return Backend(0)

    def routes_exact(self, solved: int) -> bool:
        return 1 <= solved <= self.max_dim


@dataclass(frozen=True)
class Config:
    """``split``: copies into which each edge is split before elimination; None, 0 and 1 mean no splitting."""

    seed: int = 0
    split: int | None = None
    backend: Backend = field(default_factory=Backend)

    @property
    def copies(self) -> int:
        return self.split if self.split and self.split >= 2 else 1

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=lambda e: e.value)

    @staticmethod
    def from_json(text: str) -> Config:
        raw = json.loads(text)
        own = raw.get("backend")
        backend = Backend(own["max_dim"], ExactFailure(own["on_failure"])) if own else Backend()
        return Config(raw.get("seed", 0), raw.get("split"), backend)


@dataclass(frozen=True)
class Fallback:
    """A block that was to be factored exactly and was not. ``kind``: invalid_pivot or will_not_fit."""

    kind: str
    vertex: int | None = None
    failure: DenseFailure | None = None
    dim: int | None = None


class LapgraphError(ValueError):
    """Base of all errors; ``fields`` say where."""

    def __init__(self, message: str, **fields):
        super().__init__(message)
        self.fields = fields


class CsrError(LapgraphError):
    """Arrays that are no CSR matrix."""


class NonFiniteValue(LapgraphError):
    def __init__(self, position: int):
        super().__init__(f"matrix value at CSR position {position} is not finite", position=position)


class Asymmetric(LapgraphError):
    def __init__(self, row: int, col: int):
        super().__init__(f"matrix is not symmetric at ({row}, {col}) and ({col}, {row})", row=row, col=col)


class PositiveOffDiagonal(LapgraphError):
    def __init__(self, row: int, col: int):
        super().__init__(f"off-diagonal ({row}, {col}) is positive; off-diagonals must be <= 0", row=row, col=col)


class NotDiagonallyDominant(LapgraphError):
    def __init__(self, row: int):
        super().__init__(f"row {row} is not diagonally dominant", row=row)


class NonFiniteRow(LapgraphError):
    def __init__(self, row: int):
        super().__init__(f"row {row} sums to a non-finite diagonal or off-diagonal magnitude", row=row)


class DenseFactorizationFailed(LapgraphError):
    def __init__(self, vertex: int, failure: DenseFailure):
        super().__init__(f"exact dense Cholesky failed at vertex {vertex}: {failure.value}", vertex=vertex, failure=failure)


class SolveError(LapgraphError):
    """A right-hand side or buffer of the wrong length."""


class FactorError(LapgraphError):
    """Stored factor tables that do not hold a factor."""
