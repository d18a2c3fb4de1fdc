"""Cameras: parameters become literals, so that view queries are plain projections and filters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from geolode.functions.columns import clamp


def orbit(yaw: float, pitch: float, radius: float, target: tuple[float, float, float]) -> np.ndarray:
    """World matrix of a camera that circles a target; z is up."""

    def turn(axis: int, angle: float) -> np.ndarray:
        m, (i, j) = np.eye(4), [(1, 2), (2, 0), (0, 1)][axis]
        m[i, i] = m[j, j] = np.cos(angle)
        m[i, j], m[j, i] = -np.sin(angle), np.sin(angle)
        return m

    def move(x: float, y: float, z: float) -> np.ndarray:
        m = np.eye(4)
        m[:3, 3] = x, y, z
        return m

    flip = np.array([[1, 0, 0, 0], [0, 0, 1, 0], [0, -1, 0, 0], [0, 0, 0, 1]], float)
    return move(*target) @ turn(2, yaw) @ turn(0, pitch) @ move(0, -radius, 0) @ np.linalg.inv(flip)


def perspective(fov: float, aspect: float, near: float, far: float) -> np.ndarray:
    f = 1 / np.tan(fov / 2)
    return np.array([[f / aspect, 0, 0, 0], [0, f, 0, 0], [0, 0, (far + near) / (near - far), 2 * far * near / (near - far)], [0, 0, -1, 0]])


@dataclass(frozen=True)
class Camera:
    """A view: yaw, pitch and radius around a target, and the size of the picture."""

    yaw: float = 0.3
    pitch: float = -0.7
    radius: float = 6000.0
    target: tuple[float, float, float] = (5000.0, 500.0, 0.0)
    width: int = 640
    height: int = 360
    fov: float = 1.0
    near: float = 1.0
    far: float = 100000.0

    @property
    def world(self) -> np.ndarray:
        return orbit(self.yaw, self.pitch, self.radius, self.target)

    @property
    def position(self) -> np.ndarray:
        return self.world[:3, 3]

    @property
    def matrix(self) -> np.ndarray:
        """From world to clip space. Rounded, so that it can be written down exactly."""
        return np.round(perspective(self.fov, self.width / self.height, self.near, self.far) @ np.linalg.inv(self.world), 9)

    def clip(self, x: Column, y: Column, z: Column) -> list[Column]:
        """Clip coordinates x, y, z, w."""
        return [F.lit(float(m[0])) * x + F.lit(float(m[1])) * y + F.lit(float(m[2])) * z + F.lit(float(m[3])) for m in self.matrix]

    def screen(self, x: Column, y: Column, z: Column) -> list[Column]:
        """Picture x and y (not rounded) and depth w."""
        cx, cy, _, w = self.clip(x, y, z)
        return [(cx / w * 0.5 + 0.5) * float(self.width), (cy / w * 0.5 + 0.5) * float(self.height), w]

    def screen_box(self, low: list[Column], high: list[Column]) -> list[Column]:
        """Least and greatest picture x and y over a box's corners."""
        corners = [self.screen(*[(high if k >> d & 1 else low)[d] for d in range(3)]) for k in range(8)]
        return [F.least(*[c[0] for c in corners]), F.least(*[c[1] for c in corners]), F.greatest(*[c[0] for c in corners]), F.greatest(*[c[1] for c in corners])]

    @property
    def planes(self) -> np.ndarray:
        """Six planes (a, b, c, d) of the frustum; inside where all are at or above 0."""
        m = self.matrix
        return np.array([m[3] + s * m[k] for k in range(3) for s in (1, -1)])

    def sees_point(self, x: Column, y: Column, z: Column) -> Column:
        return reduce(lambda a, b: a & b, [float(a) * x + float(b) * y + float(c) * z + float(d) >= 0 for a, b, c, d in self.planes])

    def sees_box(self, low: list[Column], high: list[Column], flat: bool = False) -> Column:
        """Whether the box's furthest corner along each plane's normal is inside; flat leaves z out."""
        tests = []
        for plane in self.planes:
            terms = [float(plane[k]) * (high if plane[k] > 0 else low)[k] for k in range(2 if flat else 3)]
            tests.append(reduce(lambda a, b: a + b, terms) + float(plane[3]) >= 0)
        return reduce(lambda a, b: a & b, tests)

    def may_show_box(self, low: list[Column], high: list[Column]) -> Column:
        """Whether anything of a box may lie on the picture: false only if all of it is beyond one of the four sides, however far or near."""
        tests = [reduce(lambda a, b: a + b, [float(p[k]) * (high if p[k] > 0 else low)[k] for k in range(3)]) + float(p[3]) >= 0 for p in self.planes[:4]]
        return reduce(lambda a, b: a & b, tests)

    def in_picture(self, px: Column, py: Column, w: Column, border: int = 2) -> Column:
        return (w > 0) & (px >= border) & (px <= self.width - border - 1) & (py >= border) & (py <= self.height - border - 1)

    def centre_distance(self, x: Column, y: Column, z: Column) -> Column:
        """Distance of a point's projection from the picture's centre, in half pictures."""
        cx, cy, _, w = self.clip(x, y, z)
        return F.sqrt((cx / w) * (cx / w) + (cy / w) * (cy / w))

    def size_on_screen(self, low: list[Column], high: list[Column]) -> Column:
        """Area of a box on the picture, weighted by how central it is."""
        x0, y0, x1, y1 = self.screen_box(low, high)
        d = self.centre_distance(*[(a + b) * 0.5 for a, b in zip(low, high, strict=True)])
        return clamp(F.exp(-(d * d) / 0.04), 0.1, 1.0) * (x1 - x0) * (y1 - y0)

    def tile_weight(self, low: list[Column], high: list[Column], points: Column) -> Column:
        d = self.centre_distance(*[(a + b) * 0.5 for a, b in zip(low, high, strict=True)])
        return self.size_on_screen(low, high) * clamp(1.0 - d, 0.0, 1.0) / clamp(points / 1e6, 0.1, 10.0)

    def task_weight(self, x: Column, y: Column, z: Column) -> Column:
        """Urgency of a patch: central and near first, 0 behind the camera."""
        w = self.clip(x, y, z)[3]
        return F.when(w < 0, 0.0).otherwise(clamp(1.0 - self.centre_distance(x, y, z), 0.0, 1.0) / w)

    def corner_rays(self) -> np.ndarray:
        """Directions from the camera through the picture's corners."""
        inverse = np.linalg.inv(self.matrix)
        far = [inverse @ np.array([x, y, 1, 1.0]) for x in (-1, 1) for y in (-1, 1)]
        rays = np.array([f[:3] / f[3] - self.position for f in far])
        return rays / np.linalg.norm(rays, axis=1, keepdims=True)
