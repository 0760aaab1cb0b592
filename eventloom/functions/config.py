"""Settings of a pipeline: YAML text with environment values in it, an environment overlay, range checks."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass

_VARIABLE = re.compile(r"\$\{([^}]*)\}")


@dataclass
class Sampling:
    default_rate: float = 1.0
    per_event: dict = field(default_factory=dict)
    tail_buffer_capacity: int = 64


@dataclass
class Limits:
    max_payload_bytes: int = 256 * 1024
    max_label_value_bytes: int = 1024


@dataclass
class Settings:
    """Unknown keys are refused; what is not given has the default."""

    filter: str = "info"
    sampling: Sampling = field(default_factory=Sampling)
    limits: Limits = field(default_factory=Limits)


def expanded(text: str, variables: Mapping[str, str]) -> str:
    """``${NAME}`` and ``${NAME:-default}`` replaced; names that nothing defines stay as they are."""

    def one(m: re.Match) -> str:
        name, has_default, default = m[1].partition(":-")
        return variables.get(name, default if has_default else m[0])

    return _VARIABLE.sub(one, text)


def _filled(kind, values: Mapping):
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown setting {sorted(unknown)[0]!r}")
    made = kind()
    for name, value in values.items():
        now = getattr(made, name)
        setattr(made, name, _filled(type(now), value or {}) if is_dataclass(now) else value)
    return made


def from_yaml(text: str, variables: Mapping[str, str], prefix: str | None = None) -> Settings:
    """Settings of a YAML text; ``PREFIX_A__B`` among the variables then overrides ``a.b``."""
    import yaml

    values = yaml.safe_load(expanded(text, variables)) or {}
    for name, value in sorted(variables.items()):
        if prefix and name.startswith(f"{prefix.upper()}_"):
            *path, last = (x.lower() for x in name[len(prefix) + 1 :].split("__"))
            at = values
            for step in path:
                at = at.setdefault(step, {})
            at[last] = yaml.safe_load(value)
    return _filled(Settings, values)


def violations(s: Settings) -> list[str]:
    """The settings that are out of their ranges."""
    out = [] if 0 <= s.sampling.default_rate <= 1 else ["sampling.default_rate"]
    out += [f"sampling.per_event.{k}" for k, v in sorted(s.sampling.per_event.items()) if not 0 <= v <= 1]
    return out + ([] if 1024 <= s.limits.max_payload_bytes <= 16 << 20 else ["limits.max_payload_bytes"])
