"""Configuration: YAML or dicts with ${a.b} references."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

REFERENCE = re.compile(r"\$\{([^}]+)\}")


def get(config: dict, path: str, default: Any = None) -> Any:
    at: Any = config
    for part in path.split("."):
        if not isinstance(at, dict) or part not in at:
            return default
        at = at[part]
    return at


def resolve(config: dict) -> dict:
    """All ${a.b} replaced by the values they name; unknown ones stay as they are."""

    def walk(x: Any, depth: int = 0) -> Any:
        if isinstance(x, dict):
            return {k: walk(v, depth) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v, depth) for v in x]
        if isinstance(x, str) and depth < 10:
            whole = REFERENCE.fullmatch(x)
            if whole:
                found = get(config, whole[1])
                return x if found is None else walk(found, depth + 1)
            return REFERENCE.sub(lambda m: str(walk(get(config, m[1], m[0]), depth + 1)), x)
        return x

    return walk(config)


def override(config: dict, changes: dict[str, Any]) -> dict:
    """A copy with dotted keys set; keys that the configuration lacks are an error."""
    out = json.loads(json.dumps(config))
    for path, value in changes.items():
        *parents, last = path.split(".")
        at = out
        for part in parents:
            at = at[part]
        if last not in at:
            raise KeyError(path)
        at[last] = value
    return out


def digest(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:8]


def load(path: str) -> dict:
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            return resolve(yaml.safe_load(f))
    except ImportError:
        with open(path, encoding="utf-8") as f:
            return resolve(json.load(f))
