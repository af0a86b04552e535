"""Stable hashes of steps, their arguments and the functions among them."""

from __future__ import annotations

import hashlib
import inspect
import json
from typing import Any

from pyspark.sql import SparkSession

from weftline.storage import Files


def _function(f: Any) -> dict[str, Any]:
    """A function by its bytecode, constants, defaults and the values it closes over, whatever its address."""
    code = f.__code__
    consts = [_function_code(c) if inspect.iscode(c) else c for c in code.co_consts]
    closure = [canonical(c.cell_contents) for c in (f.__closure__ or ())]
    used = {n: canonical(f.__globals__[n]) for n in code.co_names if n in f.__globals__ and isinstance(f.__globals__[n], (str, int, float, bool, type(None)))}
    return {"code": code.co_code.hex(), "consts": canonical(consts), "names": list(code.co_names), "closure": closure, "defaults": canonical(f.__defaults__), "globals": used}


def _function_code(code: Any) -> str:
    return code.co_code.hex() + repr([c for c in code.co_consts if not inspect.iscode(c)])


def canonical(value: Any) -> Any:
    if isinstance(value, (str, int, float, bool, type(None))):
        return value
    if isinstance(value, bytes):
        return {"bytes": value.hex()}
    if isinstance(value, dict):
        return {"dict": sorted(([canonical(k), canonical(v)] for k, v in value.items()), key=repr)}
    if isinstance(value, (set, frozenset)):
        return {"set": sorted((canonical(v) for v in value), key=repr)}
    if isinstance(value, (list, tuple, range)):
        return [canonical(v) for v in value]
    if inspect.isfunction(value):
        return _function(value)
    if inspect.ismethod(value):
        return [_function(value.__func__), canonical(getattr(value.__self__, "__dict__", None))]
    if hasattr(value, "fingerprint"):
        return {"fingerprint": value.fingerprint}
    if hasattr(value, "__dict__"):
        return {type(value).__qualname__: canonical({k: v for k, v in vars(value).items() if not k.startswith("_")})}
    return f"{type(value).__qualname__}:{value!r}" if " at 0x" not in repr(value) else type(value).__qualname__


def fingerprint(*parts: Any) -> str:
    return hashlib.sha256(json.dumps(canonical(parts), sort_keys=True, default=str).encode()).hexdigest()


def files_state(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """Path, size and time of the files at or below some paths, on any file system, so that a changed source is noticed."""
    at = Files(spark)
    return sorted(x for p in paths for x in at.state(p))
