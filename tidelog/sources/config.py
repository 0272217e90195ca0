"""Configuration S10: parser settings and provider settings from TOML; a missing file gives the defaults."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

PROVIDERS = ("openai", "claude", "gemini", "ollama", "bedrock", "mock", "none")


@dataclass
class ParserConfig:
    """The parser's knobs; those about chunks, threads and streaming only name what Spark decides by input splits."""

    auto_detect: bool = True
    default_format: str | None = None
    enable_multiline: bool = True
    multiline_timeout_ms: int = 5000
    max_multiline_lines: int = 100
    parallel_parsing: bool = True
    chunk_size: int = 1000
    num_threads: int | None = None
    streaming_threshold_mb: int = 100
    custom_timestamp_formats: list[str] = field(default_factory=list)
    fallback_to_current_time: bool = True
    extract_metadata: bool = True
    custom_metadata_patterns: dict[str, str] = field(default_factory=dict)
    skip_invalid_lines: bool = True
    max_parse_errors: int | None = None
    utf8_recovery: bool = True

    def problems(self) -> list[str]:
        """What is wrong with the settings; empty if nothing is."""
        out = [f"{n} must be positive" for n in ("chunk_size", "max_multiline_lines", "streaming_threshold_mb") if getattr(self, n) <= 0]
        if self.num_threads is not None and self.num_threads <= 0:
            out.append("num_threads must be positive")
        return out

    @classmethod
    def load(cls, path: str | None) -> ParserConfig:
        raw = read_toml(path)
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in raw.items() if k in known})


def read_toml(path: str | None) -> dict:
    if not path or not Path(path).exists():
        return {}
    with open(path, "rb") as f:
        return tomllib.load(f)


@dataclass
class ProviderChoice:
    """The provider by argument, then configuration, then environment; names in any case."""

    name: str
    model: str | None = None
    key: str | None = None
    endpoint: str | None = None

    @classmethod
    def pick(cls, argument: str | None, config: dict, environ: dict[str, str] | None = None) -> ProviderChoice:
        environ = os.environ if environ is None else environ
        name = (argument or config.get("ai", {}).get("provider") or "none").lower()
        if name not in PROVIDERS:
            raise ValueError(f"unknown provider {name!r}, known: {', '.join(PROVIDERS)}")
        own = config.get("providers", {}).get(name, {})
        return cls(name, own.get("model"), own.get("api_key") or environ.get(f"{name.upper()}_API_KEY"), own.get("endpoint"))


def get_setting(path: str, key: str):
    """The value of a dotted key; None if there is none, keys of providers are masked."""
    found = read_toml(path)
    for part in key.split("."):
        found = found.get(part) if isinstance(found, dict) else None
    return "***" if found is not None and key.endswith("api_key") else found


def set_setting(path: str, key: str, text: str) -> None:
    """Set a dotted key; the text is read as a TOML value, else taken as it is.  Tables on the way are made."""
    try:
        value = tomllib.loads(f"x = {text}")["x"]
    except tomllib.TOMLDecodeError:
        value = text
    settings = read_toml(path)
    *tables, last = key.split(".")
    at = settings
    for part in tables:
        at = at.setdefault(part, {})
        if not isinstance(at, dict):
            raise ValueError(f"{part} of {key} is a value, not a table")
    at[last] = value
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(to_toml(settings), encoding="utf-8")


def to_toml(settings: dict, prefix: str = "") -> str:
    """Settings as TOML: values first, then tables."""
    own = [f"{_key(k)} = {_value(v)}\n" for k, v in settings.items() if not isinstance(v, dict)]
    out = (f"[{prefix}]\n" if prefix and own else "") + "".join(own) + ("\n" if own else "")
    return out + "".join(to_toml(v, f"{prefix}.{_key(k)}" if prefix else _key(k)) for k, v in settings.items() if isinstance(v, dict))


def _key(k: str) -> str:
    return k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else json.dumps(k)


def _value(v) -> str:
    if isinstance(v, list):
        return "[" + ", ".join(map(_value, v)) + "]"
    return json.dumps(v, ensure_ascii=False) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def shown(path: str) -> str:
    """The settings with the keys of providers masked."""
    return re.sub(r'(?m)^(api_key = )".*"$', r'\1"***"', to_toml(read_toml(path)))
