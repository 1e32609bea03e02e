"""Configuration in layers: defaults, the user's file, the project's or an explicit file, the environment, flags."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping

from ..operators.corpus import EXCLUDED_DIRS, EXCLUDED_EXTENSIONS, MAX_FILE_BYTES, Exclusions
from .analyze import Config

#: Bytes of a configuration file, entries of an exclusion list, bytes of an entry, folders below each other,
#: lines that a limit may allow, bytes that a file limit may allow.
MAX_CONFIG_BYTES, MAX_EXCLUSIONS, MAX_EXCLUSION_BYTES, MAX_DEPTH, MAX_LINES, MAX_SIZE = 1 << 20, 10_000, 1024, 256, 1_000_000, 64 << 20
CATEGORIES_VARIABLE = "QUARRY_CATEGORIES"


def read_bounded(path: str, most: int = MAX_CONFIG_BYTES) -> str:
    """A text file of at most ``most`` bytes, whole."""
    with open(path, "rb") as f:
        raw = f.read(most + 1)
    if len(raw) > most:
        raise ValueError(f"{path}: more than {most} bytes")
    return raw.decode()


def _extended(values: list[str], more: list[str]) -> list[str]:
    """Lists of exclusions are extended, sorted and freed of repeats, never replaced."""
    return sorted({*values, *more})


def _within(name: str, value: int, least: int, most: int) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not least <= value <= most:
        raise ValueError(f"{name}: {least} to {most}, got {value}")
    return value


def load(user_file: str | None = None, project_file: str | None = None, explicit_file: str | None = None, environment: Mapping[str, str] | None = None, flags: Mapping[str, object] | None = None) -> tuple[Config, Exclusions, int, int | None]:
    """(analysis, exclusions, most bytes of a file, most depth) of all layers, checked.

    A missing user or project file is no error, a missing explicit file is. An explicit file stands in for the project's.
    flags: fields of ``Config``; those that are None are not set.
    """
    engine = {"max_file_size_bytes": MAX_FILE_BYTES, "max_depth": None}
    dirs, extensions, fields = sorted(EXCLUDED_DIRS), sorted(EXCLUDED_EXTENSIONS), {}
    if explicit_file and not os.path.exists(explicit_file):
        raise FileNotFoundError(explicit_file)
    for path in (user_file, explicit_file or project_file):
        if not path or not os.path.exists(path):
            continue
        layer = tomllib.loads(read_bounded(path))
        for name in engine:
            engine[name] = layer.get("engine", {}).get(name, engine[name])
        dirs = _extended(dirs, layer.get("engine", {}).get("exclude_dirs", []))
        extensions = _extended(extensions, layer.get("engine", {}).get("exclude_extensions", []))
        analysis = layer.get("analysis", {})
        fields |= {k: analysis[k] for k in ("categories", "min_confidence", "fail_severity") if k in analysis}
        fields |= {k: v for k, v in analysis.get("quality", {}).items() if k in ("max_file_lines", "max_function_lines")}
    environment = os.environ if environment is None else environment
    if environment.get(CATEGORIES_VARIABLE):
        fields["categories"] = [c.strip() for c in environment[CATEGORIES_VARIABLE].split(",") if c.strip()]
    fields |= {k: v for k, v in (flags or {}).items() if v is not None}
    for name, values in (("exclude_dirs", dirs), ("exclude_extensions", extensions)):
        if len(values) > MAX_EXCLUSIONS or any(not v.strip() or len(v.encode()) > MAX_EXCLUSION_BYTES for v in values):
            raise ValueError(f"engine.{name}: at most {MAX_EXCLUSIONS} values of 1 to {MAX_EXCLUSION_BYTES} bytes")
    for k in ("max_file_lines", "max_function_lines"):
        if k in fields:
            _within(f"analysis.quality.{k}", fields[k], 1, MAX_LINES)
    size = _within("engine.max_file_size_bytes", engine["max_file_size_bytes"], 1, MAX_SIZE)
    depth = engine["max_depth"] if engine["max_depth"] is None else _within("engine.max_depth", engine["max_depth"], 1, MAX_DEPTH)
    return Config(**fields), Exclusions(dirs, extensions), size, depth
