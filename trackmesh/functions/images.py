"""Packed 8-bit RGB frames as arrays: nearest resize, letterbox, crop, planes for a model. For use inside mapInPandas."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Fixed value: the grey that pads a letterbox.
PAD = 114


@dataclass(frozen=True)
class Placement:
    """Where a source image lies in a model's input."""

    scale_x: float
    scale_y: float
    pad_x: float
    pad_y: float
    source_w: int
    source_h: int

    def to_source(self, boxes: np.ndarray) -> np.ndarray:
        """Boxes of the input in the source, clamped to it, a pixel wide and high at least."""
        pad, scale = np.tile([self.pad_x, self.pad_y], 2), np.tile([self.scale_x, self.scale_y], 2)
        found = np.clip((boxes - pad) / scale, 0, np.tile([self.source_w, self.source_h], 2))
        found[:, 2:] = np.maximum(found[:, 2:], found[:, :2] + 1)
        return found


def unpack(data: bytes, width: int, height: int) -> np.ndarray:
    if len(data) != width * height * 3:
        raise ValueError("a frame's bytes are not width x height x 3")
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each pixel takes the source pixel at its own place, scaled and rounded down."""
    h, w = image.shape[:2]
    return image[(np.arange(height) * h // height)[:, None], np.arange(width) * w // width]


def letterbox(image: np.ndarray, width: int, height: int, pad: int = PAD) -> tuple[np.ndarray, Placement]:
    """The image as large as fits, in the middle of a padded frame."""
    h, w = image.shape[:2]
    scale = min(width / w, height / h)
    inner_w, inner_h = (int(np.clip(np.floor(n * scale + 0.5), 1, most)) for n, most in ((w, width), (h, height)))
    x, y = (width - inner_w) // 2, (height - inner_h) // 2
    out = np.full((height, width, 3), pad, np.uint8)
    out[y : y + inner_h, x : x + inner_w] = resize(image, inner_w, inner_h)
    return out, Placement(inner_w / w, inner_h / h, float(x), float(y), w, h)


def crop(image: np.ndarray, left: float, top: float, right: float, bottom: float) -> np.ndarray:
    """Whole pixels that a box touches, a pixel at least, within the image."""
    h, w = image.shape[:2]
    x, y = int(np.clip(np.floor(left), 0, w - 1)), int(np.clip(np.floor(top), 0, h - 1))
    return image[y : max(int(min(np.ceil(bottom), h)), y + 1), x : max(int(min(np.ceil(right), w)), x + 1)]


def planes(image: np.ndarray, mean: tuple[float, float, float] = (0.0, 0.0, 0.0), std: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Values in 0 to 1, less the mean and over the deviation, channel by channel."""
    return ((image / 255.0 - mean) / std).transpose(2, 0, 1).astype(np.float32)
