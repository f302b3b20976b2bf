"""Rendering and speech: checked arguments and plans here, the work in providers that a caller brings."""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.errors import DependencyUnavailableError, ValidationError
from folioscope.functions.naming import page_name
from folioscope.functions.payloads import data_uri

DPI, SCALE = (36, 1200), (0.05, 8.0)
LONGEST_TEXT, RATE, VOLUME = 1_000_000, (1, 1000), (0.0, 1.0)


class Renderer(Protocol):
    """Draws one page; has to be picklable, as it runs on executors."""

    def png(self, document: bytes, page: int, zoom: float) -> bytes: ...


class Speaker(Protocol):
    def save(self, text: str, path: str, rate: int | None, volume: float | None) -> None: ...

    def speak(self, text: str, rate: int | None, volume: float | None) -> None: ...


def _between(name: str, value: Any, bounds: tuple[float, float], whole: bool = False) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValidationError(f"{name} must be a number, got {value!r}")
    value = int(value) if whole else float(value)
    if not bounds[0] <= value <= bounds[1]:
        raise ValidationError(f"{name} must be between {bounds[0]} and {bounds[1]}, got {value}", {name: value})
    return value


def zoom_of_dpi(dpi: Any) -> float:
    return _between("dpi", dpi, DPI, whole=True) / 72


def checked_scale(scale: Any) -> float:
    return _between("scale", scale, SCALE)


def rendered(files: DataFrame, pages: DataFrame, renderer: Renderer | None, zoom: float) -> DataFrame:
    """(path, page, png): pages (path, page) of files (path, content), drawn in Arrow batches."""
    if renderer is None:
        raise DependencyUnavailableError("no renderer was given")

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            drawn = [renderer.png(bytes(c), p, zoom) for c, p in zip(pdf["content"], pdf["page"], strict=True)]
            yield pdf[["path", "page"]].assign(png=drawn)

    return pages.join(files.select("path", "content"), "path").select("path", "page", "content").mapInPandas(run, "path string, page int, png binary")


def thumbnails(drawn: DataFrame) -> DataFrame:
    return drawn.select("path", "page", data_uri("png").alias("data_uri"))


def with_base64(drawn: DataFrame) -> DataFrame:
    return drawn.select("path", "page", F.regexp_replace(F.base64("png"), r"\s", "").alias("image_base64"))


def free_path(path: str) -> str:
    """The path, or the first of path(1), path(2), ... that is free."""
    base, extension = os.path.splitext(path)
    candidate, n = path, 0
    while os.path.exists(candidate):
        n += 1
        candidate = f"{base}({n}){extension}"
    return candidate


def write_images(drawn: DataFrame, folder: str, prefix: str) -> list[str]:
    """Write each image to its own file on the driver, a page at a time; no file is overwritten."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for row in drawn.orderBy("page").toLocalIterator():
        target = free_path(os.path.join(folder, page_name(prefix, row["page"])))
        with open(target, "wb") as file:
            file.write(row["png"])
        out.append(target)
    return out


def synthesise(speaker: Speaker | None, text: Any, save_path: str | None, speak_aloud: bool, rate: Any, volume: Any) -> dict[str, Any]:
    """Save or speak a text; exactly one of the two."""
    if not isinstance(text, str) or not text.strip():
        raise ValidationError("text must not be empty")
    if len(text) > LONGEST_TEXT:
        raise ValidationError(f"text must have at most {LONGEST_TEXT} characters")
    if bool(save_path) == bool(speak_aloud):
        raise ValidationError("give either save_path or speak_aloud")
    rate = None if rate is None else int(_between("rate", rate, RATE, whole=True))
    volume = None if volume is None else _between("volume", volume, VOLUME)
    if speaker is None:
        raise DependencyUnavailableError("no speech provider was given")
    if save_path:
        speaker.save(text, save_path, rate, volume)
    else:
        speaker.speak(text, rate, volume)
    return {"mode": "save" if save_path else "speak", "output": save_path, "characters": len(text), "rate": rate, "volume": volume}
