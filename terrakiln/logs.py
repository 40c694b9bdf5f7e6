"""Logging on the driver: INFO to the console, DEBUG to a file, set up once."""

from __future__ import annotations

import logging
import logging.config
from pathlib import Path
from typing import Any


def set_up(config: dict[str, Any] | None = None, file: str | None = None) -> None:
    """By a dictionary of the standard library's logging, or with the defaults; the file's folder is made."""
    if config:
        logging.config.dictConfig(config)
        return
    root = logging.getLogger("terrakiln")
    if root.handlers:
        return
    root.setLevel(logging.DEBUG)
    handlers: list[tuple[logging.Handler, int]] = [(logging.StreamHandler(), logging.INFO)]
    if file:
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        handlers.append((logging.FileHandler(file), logging.DEBUG))
    for handler, level in handlers:
        handler.setLevel(level)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        root.addHandler(handler)


def logger(name: str) -> logging.Logger:
    """A logger below terrakiln; the caller's settings, or `set_up`, decide where it writes."""
    return logging.getLogger(name if name.startswith("terrakiln") else f"terrakiln.{name}")
