"""Settings from the environment, and a health report."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Keys of the external models; none is needed for the engine itself."""

    rerank_api_key: str = ""
    generate_api_key: str = ""
    embed_api_key: str = ""
    generate_model: str = ""

    @property
    def rerank_configured(self) -> bool:
        return bool(self.rerank_api_key.strip())

    @property
    def generate_configured(self) -> bool:
        return bool(self.generate_api_key.strip())


def load(env_file: str | None = ".env") -> Settings:
    """Settings from GLEANER_* variables, over those of an env file of NAME=value lines."""
    values: dict[str, str] = {}
    if env_file and Path(env_file).is_file():
        for line in Path(env_file).read_text(encoding="utf-8").splitlines():
            name, mark, value = line.partition("=")
            if mark and not name.lstrip().startswith("#"):
                values[name.strip()] = value.strip().strip("\"'")
    values |= os.environ
    return Settings(**{f: values.get(f"GLEANER_{f.upper()}", "") for f in Settings.__dataclass_fields__})


def healthcheck() -> dict[str, str]:
    return {"status": "ok", "package": "gleaner"}
