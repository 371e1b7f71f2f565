"""Runtime settings from the environment and an optional .env file; the environment wins."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    data_dir: str = "./data"
    self_url: str = ""
    user_agent: str = "tarn"
    fetch_timeout_secs: int = 30
    politeness_delay_ms: int = 250
    max_index_bytes: int = 10 * 1024**3
    peer_requests_per_minute: int = 120


def env_file(path: str | Path) -> dict[str, str]:
    """KEY=value lines; blank lines and comments are skipped, matching quotes dropped. A missing file is empty."""
    out = {}
    if Path(path).is_file():
        for line in Path(path).read_text().splitlines():
            key, eq, value = line.partition("=")
            if eq and not line.lstrip().startswith("#"):
                value = value.strip()
                out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def load(environ: Mapping[str, str] | None = None, dotenv: str | Path = ".env", prefix: str = "TARN_") -> Config:
    """Each field from PREFIX_FIELD. A number that does not parse is an error."""
    found = env_file(dotenv) | dict(os.environ if environ is None else environ)
    given = {}
    for f in fields(Config):
        if (raw := found.get(prefix + f.name.upper())) is not None:
            given[f.name] = int(raw) if f.type == "int" else raw
    return Config(**given)


def patched(current: Mapping[str, int | None], patch: Mapping[str, int | None]) -> dict[str, int | None]:
    """A runtime patch: keys that are absent stay as they are, others take the new value, null included."""
    return dict(current) | dict(patch)
