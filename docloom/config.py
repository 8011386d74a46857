"""Settings: defaults, then a YAML file, then the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .errors import DocloomError

#: The environment variable that overrides the responder's kind.
ENVIRONMENT = "DOCLOOM_RESPONDER"


@dataclass
class Config:
    responder: str = "recorded"
    model: str | None = None
    max_rounds: int = 5
    context_tokens: int = 4096
    ignore: list[str] = field(default_factory=lambda: ["target", ".git"])
    output: str = "docs"


def load(path: str | Path = "docloom.yaml") -> Config:
    """The settings; a file may set any of them, and a name that is none of them is an error."""
    given: dict[str, Any] = {}
    if Path(path).exists():
        import yaml

        try:
            given = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        except (OSError, UnicodeDecodeError, yaml.YAMLError) as e:
            raise DocloomError("config.load", f"{path}: {e}") from e
    if not isinstance(given, dict) or (unknown := set(given) - set(Config.__dataclass_fields__)):
        raise DocloomError("config.validation", f"unknown settings in {path}: {sorted(unknown) if isinstance(given, dict) else given}")
    out = Config(**given)
    out.responder = os.environ.get(ENVIRONMENT, out.responder)
    return out
