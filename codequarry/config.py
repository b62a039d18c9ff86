"""Settings of an index, checked when they are read."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields

from codequarry.functions.identifiers import STOPWORDS
from codequarry.functions.structure import LANGUAGES


class ConfigError(ValueError):
    """Settings that cannot be used, with the place and the reason of each fault."""


@dataclass(frozen=True)
class Settings:
    """Settings with their defaults; unknown names are refused."""

    languages: tuple[str, ...] = ("typescript", "tsx", "javascript", "jsx", "sql")
    exclude: tuple[str, ...] = ("node_modules/**", "vendor/**", ".git/**", "dist/**", "build/**")
    scopes: dict[str, str] = field(default_factory=dict)  # a label for the paths that a glob matches
    max_file_bytes: int = 1_048_576
    dimension: int = 1024
    resource_weight: int = 3
    stopwords: tuple[str, ...] = tuple(STOPWORDS)
    tag_rules: tuple[tuple[str, str], ...] = ()
    cache_ttl_hours: int = 24
    semantic_threshold: float = 0.95
    semantic_entries: int = 1_000

    def __post_init__(self) -> None:
        faults = [f"[languages] unknown: {x}" for x in self.languages if x not in set(LANGUAGES.values())]
        for name, low, high in (("max_file_bytes", 1, 1 << 40), ("dimension", 1, 65_536), ("resource_weight", 1, 10), ("cache_ttl_hours", 1, 1 << 20), ("semantic_threshold", 0.85, 0.99), ("semantic_entries", 1, 1 << 30)):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int | float) or not low <= value <= high:
                faults.append(f"[{name}] must be from {low} to {high}")
        for tag, pattern in self.tag_rules:
            try:
                re.compile(pattern)
            except re.error as e:
                faults.append(f"[tag_rules.{tag}] {e}")
        if faults:
            raise ConfigError("; ".join(faults))


def parse_settings(values: dict) -> Settings:
    known = {f.name for f in fields(Settings)}
    if extra := sorted(set(values) - known):
        raise ConfigError("; ".join(f"[{x}] is not a setting" for x in extra))
    as_tuple = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in values.items()}
    return Settings(**as_tuple)


def load_settings(path: str) -> Settings:
    try:
        with open(path, encoding="utf-8") as f:
            return parse_settings(json.load(f))
    except OSError as e:
        raise ConfigError(f"[{path}] cannot be read: {e}") from e
    except json.JSONDecodeError as e:
        raise ConfigError(f"[{path}] is not JSON: {e}") from e
