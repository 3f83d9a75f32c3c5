"""Options from the environment: which stages run, from which severity they block, and how enforcement decides."""

from __future__ import annotations

import os
from collections.abc import Mapping
from typing import Any

from veriloom.operators import cascade
from veriloom.operators.rules import SEVERITIES

YES = ("1", "on", "true", "yes")


class SettingsError(ValueError):
    """An option that has no such value."""


def option(name: str, default: Any, env: Mapping[str, str] | None = None) -> Any:
    """An option of the default's type; a missing or blank one is the default. A truth value is any of YES, or false."""
    raw = (os.environ if env is None else env).get(name, "").strip()
    if not raw:
        return default
    if isinstance(default, bool):
        return raw.lower() in YES
    try:
        return type(default)(raw)
    except ValueError as e:
        raise SettingsError(f"{name} must be {'an integer' if isinstance(default, int) else 'a number'}, not {raw!r}") from e


def settings(env: Mapping[str, str] | None = None, prefix: str = "VERILOOM_") -> tuple[cascade.Config, dict[str, bool]]:
    """(config of the cascade, policy of enforcement) from prefixed options."""
    get = lambda name, default: option(prefix + name, default, env)
    severity = get("BLOCK_SEVERITY", "high").lower()
    if severity not in SEVERITIES:
        raise SettingsError(f"{prefix}BLOCK_SEVERITY must be one of {', '.join(SEVERITIES)}, not {severity!r}")
    config = cascade.Config(stage1=get("ENABLE_STAGE1", True), stage2=get("ENABLE_STAGE2", False), block_severity=severity)
    return config, {"sanitize_untrusted": get("SANITIZE_UNTRUSTED", True), "resolve_band_by_trust": get("RESOLVE_BAND_BY_TRUST", True)}
