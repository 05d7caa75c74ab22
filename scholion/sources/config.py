"""Configuration and prompts: loaded on the driver, captured by closures."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path

from ..operators.annotate import Prompts


class ConfigurationError(Exception):
    pass


# Sections, providers, defaults.
SECTIONS = ("api", "extraction", "analysis", "retry", "cache", "export", "general")
PROVIDERS = ("gemini", "openai", "anthropic")
PLACEHOLDER = "your-api-key-here"


@dataclass(frozen=True)
class Api:
    provider_type: str = "gemini"
    keys: dict = field(default_factory=dict)
    timeout_seconds: float = 30.0
    rate_limit_delay: float = 1.0


@dataclass(frozen=True)
class Extraction:
    max_file_size_mb: float = 50
    timeout_seconds: float = 30.0
    normalize_text: bool = True
    extract_positions: bool = True


@dataclass(frozen=True)
class Analysis:
    chunk_size: int = 10000
    chunk_overlap: int = 500
    max_concurrent_sections: int = 3
    section_timeout_seconds: float = 60.0
    min_section_length: int = 50
    temperature: float = 0.1
    max_output_tokens: int = 100000


@dataclass(frozen=True)
class Retry:
    max_attempts: int = 3
    initial_delay_seconds: float = 2.0
    backoff_multiplier: float = 2.0
    max_delay_seconds: float = 30.0


@dataclass(frozen=True)
class Cache:
    enabled: bool = False
    ttl_seconds: int = 3600
    max_size_mb: int = 1000


@dataclass(frozen=True)
class Export:
    default_format: str = "csv"
    include_confidence: bool = True
    min_confidence_threshold: float = 0.0


@dataclass(frozen=True)
class Config:
    api: Api = field(default_factory=Api)
    extraction: Extraction = field(default_factory=Extraction)
    analysis: Analysis = field(default_factory=Analysis)
    retry: Retry = field(default_factory=Retry)
    cache: Cache = field(default_factory=Cache)
    export: Export = field(default_factory=Export)
    prompts_directory: str = "prompts"
    log_level: str = "INFO"

    def public(self) -> dict:
        """Without keys."""
        return {"provider": self.api.provider_type, "max_file_size_mb": self.extraction.max_file_size_mb, "chunk_size": self.analysis.chunk_size, "max_concurrent_sections": self.analysis.max_concurrent_sections}


def read_mapping(path: str | Path) -> dict:
    """A mapping from a JSON or, if PyYAML is there, a YAML file."""
    try:
        content = Path(path).read_text(encoding="utf-8")
    except OSError as e:
        raise ConfigurationError(f"cannot read {path}: {e}") from e
    try:
        if str(path).endswith(".json"):
            found = json.loads(content)
        else:
            import yaml

            found = yaml.safe_load(content)
    except ImportError as e:
        raise ConfigurationError("YAML files need PyYAML; use JSON instead") from e
    except Exception as e:
        raise ConfigurationError(f"invalid content in {path}: {e}") from e
    if not isinstance(found, dict):
        raise ConfigurationError("the configuration must be a mapping")
    return found


def build(kind, given: dict):
    """A dataclass from a mapping: unknown keys are left out, types are cast to those of the defaults."""
    out = {}
    for f in fields(kind):
        if f.name in given and given[f.name] is not None:
            default, value = getattr(kind(), f.name), given[f.name]
            try:
                out[f.name] = value if isinstance(default, dict) else str(value).lower() in ("1", "true", "yes") if isinstance(default, bool) else type(default)(value)
            except (TypeError, ValueError) as e:
                raise ConfigurationError(f"{f.name}: {e}") from e
    return kind(**out)


def from_mapping(given: dict, strict: bool = False, env: dict | None = None) -> Config:
    """``strict``: all sections must be there. Else defaults fill in, and keys come from the environment too."""
    env = dict(os.environ) if env is None else env
    if strict and (missing := [s for s in SECTIONS if s not in given]):
        raise ConfigurationError(f"missing sections: {', '.join(missing)}")
    api = dict(given.get("api") or {})
    provider = api.get("provider_type") if strict or "provider_type" in api else "gemini"
    if provider not in PROVIDERS:
        raise ConfigurationError(f"provider_type must be one of {', '.join(PROVIDERS)}")
    keys = {p: key for p in PROVIDERS if (key := api.get(f"{p}_api_key") or env.get(f"{p.upper()}_API_KEY")) and key != PLACEHOLDER}
    if provider not in keys:
        raise ConfigurationError(f"no API key for {provider}")
    analysis = build(Analysis, given.get("analysis") or {})
    if not 0.0 <= analysis.temperature <= 1.0:
        raise ConfigurationError("temperature must lie in [0, 1]")
    general = given.get("general") or {}
    return Config(
        build(Api, api | {"provider_type": provider, "keys": keys}), build(Extraction, given.get("extraction") or {}), analysis, build(Retry, given.get("retry") or {}),
        build(Cache, given.get("cache") or {}), build(Export, given.get("export") or {}), str(general.get("prompts_directory", "prompts")), str(general.get("log_level", "INFO")),
    )


def load(path: str | Path, strict: bool = False, env: dict | None = None) -> Config:
    return from_mapping(read_mapping(path), strict, env)


def has_valid_key(config: Config) -> bool:
    return any(k and k != PLACEHOLDER for k in config.api.keys.values())


def env_flag(name: str, env: dict | None = None) -> bool:
    """Is the variable set to true, 1 or yes?"""
    return ((os.environ if env is None else env).get(name) or "").lower() in ("true", "1", "yes")


def from_env(env: dict | None = None) -> dict:
    """What the environment sets: debug, config_path, log_level (null where it doesn't), and the keys by provider."""
    env = dict(os.environ) if env is None else env
    keys = {p: env[f"{p.upper()}_API_KEY"] for p in PROVIDERS if env.get(f"{p.upper()}_API_KEY")}
    return {"debug": env_flag("DEBUG", env), "config_path": env.get("SCHOLION_CONFIG_PATH"), "log_level": env.get("SCHOLION_LOG_LEVEL"), "keys": keys}


def resolve(directory: str, root: str | Path) -> Path:
    """Relative directories lie under the project's root."""
    p = Path(directory)
    return p if p.is_absolute() else Path(root) / p


def load_prompts(path: str | Path) -> Prompts:
    """Prompts from a file; a missing one is an error."""
    given = read_mapping(path)
    known = {f.name for f in fields(Prompts)}
    return Prompts(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known})
