"""Parameters of an embedding, and the values that the numerics fix."""

from __future__ import annotations

from dataclasses import dataclass

#: Grid sizes with fast transforms, padding included.
FAST_GRID_SIZES = (
    8, 9, 10, 11, 12, 13, 14, 15, 16, 20, 25, 26, 28, 32, 33, 35, 36, 39, 40, 42, 44, 45, 48, 49, 50, 52, 54, 55, 56,
    60, 63, 64, 65, 66, 70, 72, 75, 77, 78, 80, 84, 88, 90, 91, 96, 98, 99, 100, 104, 105, 108, 110, 112, 117, 120,
    125, 126, 130, 132, 135, 140, 144, 147, 150, 154, 156, 160, 165, 168, 175, 176, 180, 182, 189, 192, 195, 196, 198,
    200, 208, 210, 216, 220, 224, 225, 231, 234, 240, 245, 250, 252, 260, 264, 270, 273, 275, 280, 288, 294, 297, 300,
    308, 312, 315, 320, 325, 330, 336, 343, 350, 351, 352, 360, 364, 375, 378, 385, 390, 392, 396, 400, 416, 420, 432,
    440, 441, 448, 450, 455, 462, 468, 480, 490, 495, 500, 504, 512,
)
#: Smallest grid, grid spacing by dimensions, boxes by dimensions (least, most) and points in a box.
LEAST_GRID = 14
SPACING = {1: 0.5, 2: 0.7, 3: 1.2}
BOXES = {1: (20, None), 2: (50, 240), 3: (20, 60), 4: (5, 15)}
BOX_POINTS = {1: 5, 2: 3, 3: 3, 4: 3}
#: Smallest normal numbers of the two float kinds, and the spacing of doubles at 1.
FLT_MIN, DBL_MIN, EPS = 1.1754943508222875e-38, 2.2250738585072014e-308, 2.220446049250313e-16


@dataclass(frozen=True)
class EmbeddingParams:
    """d dimensions; u perplexity; lam target of the rescaling (1: none); alpha exaggeration for early_iter steps;
    repulsion is grid, exact or tree (then theta is the largest side over distance of a cell that stands for its points)."""

    d: int = 2
    u: float = 30.0
    lam: float = 1.0
    alpha: float = 12.0
    max_iter: int = 1000
    early_iter: int = 250
    eta: float = 200.0
    momentum: float = 0.5
    late_momentum: float = 0.8
    momentum_iter: int = 250
    gain_up: float = 0.2
    gain_down: float = 0.8
    least_gain: float = 0.01
    h: float | None = None
    drop_leaf: bool = False
    stochastic: bool = False
    repulsion: str = "grid"
    theta: float = 0.5
    grid: int | None = None
    tol: float = 0.0
    seed: int = 0

    @property
    def k(self) -> int:
        """Neighbours of a point: three times the perplexity, rounded up."""
        return -int(-3 * self.u // 1)

    @property
    def spacing(self) -> float:
        return self.h if self.h is not None else SPACING[min(self.d, 3)]


def grid_size(spread: float, h: float) -> int:
    """Grid nodes a side for points that spread so far, without the padding of two."""
    want = max(int(-(-spread // h)), LEAST_GRID) + 2
    return next((s for s in FAST_GRID_SIZES if s >= want), FAST_GRID_SIZES[-1]) - 2


def box_count(spread: float, d: int, speedup: float = 1.0) -> int:
    least, most = BOXES[d]
    n = max(least, int(-(-spread * speedup // 1)))
    return n if most is None else min(most, n)
