"""Pixel features of images with NumPy; decoding needs Pillow and is left out without it.

``analyse_images`` turns ``binaryFile`` rows into feature rows in Arrow batches. Images are
H x W x 3 arrays of bytes.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenlake.config import Settings

_LUMA = np.array([0.299, 0.587, 0.114])


def shrink(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area average to a smaller (or equal) size."""
    x = image.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        n = x.shape[axis]
        edge = np.linspace(0, n, size + 1)
        total = np.concatenate([np.zeros_like(x.take([0], axis)), np.cumsum(x, axis)], axis)
        low = np.minimum(edge.astype(int), n - 1)
        shape = [-1 if a == axis else 1 for a in range(x.ndim)]
        upto = total.take(low, axis) + x.take(low, axis) * (edge - low).reshape(shape)
        x = np.diff(upto, axis=axis) / (n / size)
    return x


def grey(image: np.ndarray) -> np.ndarray:
    return np.rint(image.astype(np.float64) @ _LUMA)


def raw_metrics(image: np.ndarray) -> dict[str, float]:
    """Laplacian variance, midpoint closeness, clipped share, deviation of luminance, colourfulness."""
    top = max(image.shape[:2])
    if top > 1200:
        image = np.rint(shrink(image, max(1, round(image.shape[0] * 1200 / top)), max(1, round(image.shape[1] * 1200 / top))))
    g = grey(image)
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    y = g / 255
    r, gr, b = (image[..., k].astype(np.float64) for k in range(3))
    rg, yb = r - gr, 0.5 * (r + gr) - b
    return {
        "laplacian_variance": float(laplacian.var()), "midpoint": max(0.0, 1 - abs(float(y.mean()) - 0.5) / 0.5), "clipped": float(((y < 0.015) | (y > 0.985)).mean()),
        "deviation": float(y.std()), "colorfulness": math.hypot(rg.std(), yb.std()) + 0.3 * math.hypot(rg.mean(), yb.mean()),
    }


def hue_histogram(image: np.ndarray) -> np.ndarray:
    """64 numbers of unit length: hue by saturation, eight bins each, of the picture at 128 x 128."""
    x = np.clip(np.rint(shrink(image, 128, 128)), 0, 255)
    top, low = x.max(-1), x.min(-1)
    span = np.where(top > low, top - low, 1)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    hue = np.where(top == r, (g - b) / span, np.where(top == g, 2 + (b - r) / span, 4 + (r - g) / span)) / 6 % 1
    hue = np.where(top > low, hue, 0)
    saturation = np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0)
    counts = np.histogram2d(hue.ravel(), saturation.ravel(), bins=8, range=[[0, 1], [0, 256 / 255]])[0].ravel()
    return (counts / max(np.linalg.norm(counts), 1e-12)).astype(np.float32)


def _hex(bits: np.ndarray) -> str:
    return f"{int(''.join('1' if b else '0' for b in bits.ravel()), 2):016x}"


def perceptual_hash(image: np.ndarray) -> str:
    """The 8 x 8 lowest frequencies of the cosine transform at 32 x 32, against their median."""
    g = shrink(grey(image), 32, 32)
    k, n = np.arange(32)[:, None], np.arange(32)[None, :]
    c = np.cos(np.pi * k * (2 * n + 1) / 64)
    low = (c @ g @ c.T)[:8, :8]
    return _hex(low > np.median(low))


def difference_hash(image: np.ndarray) -> str:
    """Whether brightness rises from left to right, at 8 x 9."""
    g = shrink(grey(image), 8, 9)
    return _hex(g[:, 1:] > g[:, :-1])


def describe_image(image: np.ndarray, width: int, height: int) -> dict:
    """All features of one decoded image; ``width`` and ``height`` are the original's."""
    return raw_metrics(image) | {"megapixels": width * height / 1e6, "perceptual_hash": perceptual_hash(image), "difference_hash": difference_hash(image), "visual_features": hue_histogram(image).tolist()}


FEATURES = "path string, width int, height int, laplacian_variance double, midpoint double, clipped double, deviation double, colorfulness double, megapixels double, perceptual_hash string, difference_hash string, visual_features array<float>, error string"


def decode(content: bytes, settings: Settings = Settings()) -> tuple[np.ndarray, int, int]:
    """Upright RGB pixels and original size; transparent parts become white. Needs Pillow."""
    from PIL import Image, ImageOps

    with Image.open(io.BytesIO(content)) as raw:
        width, height = raw.size
        if width * height / 1e6 > settings.max_image_megapixels:
            raise ValueError("too_large")
        if int(raw.getexif().get(274) or 1) in (5, 6, 7, 8):
            width, height = height, width
        upright = ImageOps.exif_transpose(raw)
        if upright.mode == "RGBA":
            back = Image.new("RGB", upright.size, "white")
            back.paste(upright, mask=upright.getchannel("A"))
            upright = back
        upright = upright.convert("RGB")
        upright.thumbnail((max(1600, settings.preview_size),) * 2)
        return np.asarray(upright, dtype=np.uint8), width, height


def analyse_images(files: DataFrame, settings: Settings = Settings(), decoder=decode) -> DataFrame:
    """Features of ``binaryFile`` rows (``path, content``); files that can't be read get an error instead."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    image, width, height = decoder(content, settings)
                    rows.append({"path": path, "width": width, "height": height} | describe_image(image, width, height))
                except Exception as e:  # one bad file must not stop a batch
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"[:200]})
            yield pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))

    return files.select("path", "content").mapInArrow(run, schema)


def encode_jpeg(image: np.ndarray, size: int, settings: Settings = Settings()) -> bytes:
    """A progressive JPEG of at most ``size`` pixels a side. Needs Pillow."""
    from PIL import Image

    picture = Image.fromarray(image)
    picture.thumbnail((size, size))
    out = io.BytesIO()
    picture.save(out, format="JPEG", quality=settings.jpeg_quality, optimize=True, progressive=True)
    return out.getvalue()


def derivatives(files: DataFrame, settings: Settings = Settings(), decoder=decode, encoder=encode_jpeg) -> DataFrame:
    """``path, kind, content`` of thumbnails and previews of ``binaryFile`` rows, to be written as a table.

    A file that can't be read gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    image = decoder(content, settings)[0]
                    rows += [{"path": path, "kind": k, "content": encoder(image, n, settings)} for k, n in (("thumbs", settings.thumb_size), ("previews", settings.preview_size))]
                except Exception:  # reported by analyse_images
                    continue
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("kind", pa.string()), ("content", pa.binary())]))

    return files.select("path", "content").mapInArrow(run, "path string, kind string, content binary")


FACES = "path string, face int, x double, y double, width double, height double, confidence double, embedding array<float>, model string, error string"


def detect_faces(files: DataFrame, models: list[tuple[str, Callable[[], Callable]]], settings: Settings = Settings(), decoder=decode) -> DataFrame:
    """Faces of ``binaryFile`` rows (``path, content``), found by the first of ``models`` that can be loaded.

    A model is a name and a function that loads it, once in each worker; what that returns takes an image and gives
    dicts with ``x, y, width, height`` (shares of the image), ``confidence`` and ``embedding`` (null if the model has none). If a
    model fails on an image, the next is tried; a file that none can do has one row with its error. No model is part of this repository.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(FACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Callable | Exception] = {}

        def find(path: str, content: bytes) -> list[dict]:
            image, error = decoder(content, settings)[0], "no model"
            for name, load in models:
                if name not in loaded:
                    try:
                        loaded[name] = load()
                    except Exception as e:
                        loaded[name] = e
                try:
                    if isinstance(loaded[name], Exception):
                        raise loaded[name]
                    return [{"path": path, "face": i, "model": name} | f for i, f in enumerate(loaded[name](image))]
                except Exception as e:
                    error = f"{name}: {type(e).__name__}: {e}"
            return [{"path": path, "error": error[:200]}]

        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows += find(path, content)
                except Exception as e:  # one bad file must not stop a batch
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"[:200]})
            yield pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))

    return files.select("path", "content").mapInArrow(run, schema)
