"""Model backends by name, built from a configuration.

A backend is a function of options that returns a role's factory (a
zero-argument callable, see ``operators.adapters``).  Roles that name the same
backend and options share one factory; a disabled role has none.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from ..operators import adapters

ROLES = ("generation", "instruction", "embedding", "nli", "fluency")
_BACKENDS: dict[tuple[str, str], Callable[..., adapters.Factory]] = {}


def register(role: str, name: str):
    """Decorator: the backend ``name`` of a role."""
    if role not in ROLES:
        raise KeyError(f"no role {role!r}; roles: {', '.join(ROLES)}")

    def add(build: Callable[..., adapters.Factory]):
        _BACKENDS[role, name] = build
        return build

    return add


def build(config: dict[str, dict]) -> dict[str, adapters.Factory | None]:
    """role -> factory.  config: role -> {"backend": name, "enabled": bool, other options}."""
    made: dict[tuple, adapters.Factory] = {}
    out: dict[str, adapters.Factory | None] = {}
    for role, own in config.items():
        options = {k: v for k, v in own.items() if k not in ("backend", "enabled")}
        if not own.get("enabled", True):
            out[role] = None
            continue
        key = (role, own.get("backend", "fake"))
        if key not in _BACKENDS:
            known = sorted(n for r, n in _BACKENDS if r == role)
            raise KeyError(f"no backend {key[1]!r} for {role}; known: {', '.join(known)}")
        shared = (_BACKENDS[key], json.dumps(options, sort_keys=True))
        if shared not in made:
            made[shared] = _BACKENDS[key](**options)
        out[role] = made[shared]
    return out


@register("embedding", "fake")
def _fake_embedding(**_options) -> adapters.Factory:
    return adapters.fake_embedder


@register("nli", "fake")
def _fake_nli(**_options) -> adapters.Factory:
    return adapters.fake_nli


@register("fluency", "fake")
def _fake_fluency(**_options) -> adapters.Factory:
    return adapters.fake_perplexity
