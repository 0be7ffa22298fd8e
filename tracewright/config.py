"""Settings of a run, and its log."""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from logging.handlers import RotatingFileHandler


@dataclass(frozen=True)
class Settings:
    match_pixels: float = 24.0
    candidates: int = 50
    candidates_remote: int = 12
    max_new_tokens: int = 128
    attempts: int = 4
    pair_batch: int = 128
    strict: bool = False
    image_detail: str = "auto"
    model_path: str | None = None
    dataset_path: str | None = None
    results_path: str = "../results"
    device: str = "auto"
    model_dtype: str = "fp16"
    use_8bit: bool = False

    def __post_init__(self) -> None:
        if self.image_detail not in ("high", "low", "auto"):
            object.__setattr__(self, "image_detail", "auto")

    @classmethod
    def read(cls, values: Mapping[str, str] = os.environ) -> Settings:
        """Settings by their names in upper case, such as MODEL_PATH; others keep their defaults."""
        given = {}
        for f in fields(cls):
            text = values.get(f.name.upper())
            if text is not None:
                kind = type(f.default)
                given[f.name] = text.strip().lower() in ("1", "true", "yes") if kind is bool else kind(text) if kind in (int, float) else text
        return cls(**given)


def log_to(path: str, level: str = "INFO", name: str = "tracewright") -> logging.Logger:
    """The driver's logger, writing to a file of at most 5 MiB and three older ones."""
    logger = logging.getLogger(name)
    logger.setLevel(level.upper())
    if not any(getattr(h, "baseFilename", None) == os.path.abspath(path) for h in logger.handlers):
        handler = RotatingFileHandler(path, maxBytes=5 << 20, backupCount=3, encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        logger.addHandler(handler)
    return logger
