"""Loggers that can be filtered, combined and kept from raising, over Python's logging."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import TextIO

LEVELS = ("debug", "info", "warning", "error")


@dataclass(frozen=True)
class Logger:
    """Base: log() gets a level and a message, or a function that makes one."""

    def log(self, level: str, message: str | Callable[[], str], error: BaseException | None = None) -> None:
        raise NotImplementedError

    def debug(self, message: str | Callable[[], str]) -> None:
        self.log("debug", message)

    def warning(self, message: str | Callable[[], str]) -> None:
        self.log("warning", message)


@dataclass(frozen=True)
class Null(Logger):
    def log(self, level: str, message: str | Callable[[], str], error: BaseException | None = None) -> None:
        return None


@dataclass(frozen=True)
class Python(Logger):
    name: str = "lexigrain"

    def log(self, level: str, message: str | Callable[[], str], error: BaseException | None = None) -> None:
        logging.getLogger(self.name).log(getattr(logging, level.upper()), message() if callable(message) else message, exc_info=error)


@dataclass(frozen=True)
class Writer(Logger):
    """Writes lines of time, level and message."""

    to: TextIO

    def log(self, level: str, message: str | Callable[[], str], error: BaseException | None = None) -> None:
        text = message() if callable(message) else message
        self.to.write(f"[{datetime.now(timezone.utc):%Y-%m-%d %H:%M:%S.%f}] [{level}] {text}{f': {error!r}' if error else ''}\n")


@dataclass(frozen=True)
class Combined(Logger):
    loggers: tuple[Logger, ...]

    def log(self, level: str, message: str | Callable[[], str], error: BaseException | None = None) -> None:
        for x in self.loggers:
            x.log(level, message, error)


@dataclass(frozen=True)
class Filtered(Logger):
    """Passes on the allowed levels."""

    inner: Logger
    allowed: frozenset[str]

    @classmethod
    def of(cls, inner: Logger, allowed: Iterable[str]) -> Filtered:
        levels = frozenset(allowed)
        if not levels <= set(LEVELS):
            raise ValueError(f"levels are {LEVELS}")
        return cls(inner, levels)

    def log(self, level: str, message: str | Callable[[], str], error: BaseException | None = None) -> None:
        if level in self.allowed:
            self.inner.log(level, message, error)


@dataclass(frozen=True)
class Quiet(Logger):
    """Swallows what the inner logger raises."""

    inner: Logger

    def log(self, level: str, message: str | Callable[[], str], error: BaseException | None = None) -> None:
        try:
            self.inner.log(level, message, error)
        except Exception:  # noqa: BLE001, S110
            pass
