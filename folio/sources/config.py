"""Settings: checked dataclasses, read from and written to TOML."""

from __future__ import annotations

import tomllib
from dataclasses import MISSING, asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from folio.functions import constants as C


def _between(name: str, value: float, low: float, high: float | None) -> None:
    if value < low or high is not None and value > high:
        raise ValueError(f"{name} must lie between {low} and {high}")


@dataclass(frozen=True)
class Discovery:
    mode: str = "sitemap"
    max_pages: int = 0
    max_depth: int = 3
    include: str | None = None
    exclude: str | None = None
    urls_file: str | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("sitemap", "crawl", "manual"):
            raise ValueError(f"unknown discovery mode: {self.mode}")
        _between("max_depth", self.max_depth, 1, 10)
        _between("max_pages", self.max_pages, 0, None)


@dataclass(frozen=True)
class Fetch:
    use_js: bool = False
    timeout_ms: int = 30000
    wait_selector: str | None = None
    wait_time_ms: int = 0
    click_tabs_selector: str | None = None
    page_pool_size: int = 5

    def __post_init__(self) -> None:
        _between("page_pool_size", self.page_pool_size, 1, 20)


@dataclass(frozen=True)
class Extract:
    content_selectors: tuple[str, ...] = tuple(C.CONTENT_SELECTORS)
    remove_selectors: tuple[str, ...] = tuple(C.REMOVE_SELECTORS)
    min_content_length: int = C.MIN_CONTENT_LENGTH
    include_tables: bool = True
    include_images: bool = True
    include_links: bool = True

    def __post_init__(self) -> None:
        _between("min_content_length", self.min_content_length, 0, None)


@dataclass(frozen=True)
class Output:
    mode: str = "single"
    path: str = "./output/output.md"
    include_metadata: bool = True
    include_toc: bool = True

    def __post_init__(self) -> None:
        if self.mode not in ("single", "multi"):
            raise ValueError(f"unknown output mode: {self.mode}")


@dataclass(frozen=True)
class RateLimit:
    max_concurrent: int = 5
    delay_seconds: float = 0.1
    max_retries: int = 3
    retry_base_delay: float = 1.0

    def __post_init__(self) -> None:
        _between("max_concurrent", self.max_concurrent, 1, 20)
        _between("max_retries", self.max_retries, 0, 10)
        _between("retry_base_delay", self.retry_base_delay, 0.1, 30)


@dataclass(frozen=True)
class Settings:
    base_url: str
    pattern: str | None = None
    skip_urls: str | None = None
    verbose: bool = False
    apply_detected: bool = False
    discovery: Discovery = field(default_factory=Discovery)
    fetcher: Fetch = field(default_factory=Fetch)
    extractor: Extract = field(default_factory=Extract)
    output: Output = field(default_factory=Output)
    rate_limit: RateLimit = field(default_factory=RateLimit)

    @classmethod
    def from_toml(cls, path: str) -> Settings:
        return cls.from_dict(tomllib.loads(Path(path).read_text(encoding="utf-8")))

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Settings:
        parts = {"discovery": Discovery, "fetcher": Fetch, "extractor": Extract, "output": Output, "rate_limit": RateLimit}
        made = {k: parts[k](**{n: tuple(v) if isinstance(v, list) else v for n, v in x.items()}) if k in parts else x for k, x in data.items()}
        return cls(**made)

    def to_toml(self) -> str:
        """What differs from the defaults, in two levels."""
        top, tables = [], []
        for f in fields(self):
            value = getattr(self, f.name)
            if f.default_factory is not MISSING:
                base = asdict(f.default_factory())
                if lines := [f"{k} = {_toml(v)}" for k, v in asdict(value).items() if v != base[k] and v is not None]:
                    tables += ["", f"[{f.name}]", *lines]
            elif value != f.default and value is not None:
                top.append(f"{f.name} = {_toml(value)}")
        return "\n".join([*top, *tables]) + "\n"

    def save_toml(self, path: str) -> None:
        Path(path).write_text(self.to_toml(), encoding="utf-8")


#: pacing presets: at most so many at once, seconds between starts
PACING = {"gentle": (3, 0.5), "normal": (5, 0.1), "fast": (10, 0.05)}


def _toml(value: Any) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_toml, value)) + "]"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t")
        return f'"{escaped}"'
    return str(value)
