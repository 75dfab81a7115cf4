"""Logs of the jobs, to the console and to a file."""

from __future__ import annotations

import logging

#: Fixed format: time, name, level, message.
FORMAT = "%(asctime)s - %(name)s - %(levelname)s - %(message)s"


def logger(name: str) -> logging.Logger:
    """The log of a module; it says nothing until log_to has been called, but for warnings."""
    return logging.getLogger(name if name.startswith("bhashaloom") else f"bhashaloom.{name}")


def log_to(file: str | None = None, console: bool = True, level: int = logging.INFO) -> logging.Logger:
    """Sends the package's logs to the console, a file of the driver or both. Calling it again replaces what was set."""
    top = logging.getLogger("bhashaloom")
    for old in list(top.handlers):
        top.removeHandler(old)
        old.close()
    handlers = ([logging.StreamHandler()] if console else []) + ([logging.FileHandler(file, encoding="utf-8")] if file else [])
    for new in handlers:
        new.setFormatter(logging.Formatter(FORMAT))
        top.addHandler(new)
    top.setLevel(level)
    return top
