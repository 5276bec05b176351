"""Document outlines on Spark. What a user of the library needs most is named here; operators are in ``folioscope.operators``."""

from .config import Config, Options, load
from .plans.pipeline import Reader, Result, run, run_job
from .sources.ocr_command import CommandBackend, resolve_backend

__all__ = ["CommandBackend", "Config", "Options", "Reader", "Result", "load", "resolve_backend", "run", "run_job"]
