"""Parameters of retrieval and of what is indexed, as frozen dataclasses with dotted overrides, read from TOML."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any, get_type_hints


@dataclass(frozen=True)
class Bm25:
    title: float = 3.0
    heading: float = 8.0
    heading_path: float = 4.0
    body: float = 1.0
    tags: float = 2.0
    k1: float = 1.2
    b: float = 0.75
    idf_floor: float = 1e-6


@dataclass(frozen=True)
class Graph:
    enabled: bool = True
    seed_count: int = 5
    max_hops: int = 2
    hop_decay: float = 0.6
    min_weight: float = 0.05
    related: float = 0.6
    parent: float = 0.3
    contradicts: float = 1.0
    supersedes: float = 1.0
    link: float = 0.5

    def weights(self) -> dict[str, float]:
        return {r: getattr(self, r) for r in ("related", "parent", "contradicts", "supersedes", "link")}


@dataclass(frozen=True)
class Fusion:
    k: int = 60
    lexical_weight: float = 1.0
    graph_weight: float = 1.0


@dataclass(frozen=True)
class Status:
    current: float = 1.0
    draft: float = 0.9
    archived: float = 0.4
    obsolete: float = 0.25


@dataclass(frozen=True)
class Boosts:
    heading: float = 1.30
    app: float = 1.25
    project: float = 1.35


#: Weights of where a section comes from; a correction counts most, what was imported least.
TRUST = {"correction": 1.2, "note": 1.0, "code": 0.95, "old": 0.8, "imported": 0.7}


@dataclass(frozen=True)
class Search:
    lexical_limit: int = 30
    fused_limit: int = 20
    context_sections: int = 5
    min_confidence: float = 0.001
    bm25: Bm25 = field(default_factory=Bm25)
    graph: Graph = field(default_factory=Graph)
    fusion: Fusion = field(default_factory=Fusion)
    status: Status = field(default_factory=Status)
    boosts: Boosts = field(default_factory=Boosts)

    def problems(self) -> list[str]:
        """All that is wrong with the values, not only the first."""
        out = [f"{name} must be at least 1" for name in ("lexical_limit", "fused_limit", "context_sections") if getattr(self, name) < 1]
        if not 0 < self.graph.hop_decay <= 1:
            out.append("graph.hop_decay must be above 0 and at most 1")
        if not 0 <= self.graph.max_hops <= 3:
            out.append("graph.max_hops must be 0 to 3")
        if self.fusion.k < 0:
            out.append("fusion.k must not be negative")
        if self.context_sections > self.fused_limit:
            out.append(f"context_sections ({self.context_sections}) is above fused_limit ({self.fused_limit}), so the last ones are never reached")
        return out


@dataclass(frozen=True)
class Source:
    """A folder of notes and the patterns of the files that count."""

    name: str = ""
    path: str = ""
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    vault: bool = False
    trust: str = "note"

    def problems(self, label: str) -> list[str]:
        out, path = [], Path(self.path)
        if not self.name:
            out.append(f"{label}: needs a name")
        if path == Path("/"):
            out.append(f"{label}: the whole file system isn't indexed")
        elif path == Path.home():
            out.append(f"{label}: a whole home folder isn't indexed, name a folder in it")
        elif not path.exists():
            out.append(f"{label}: {self.path} doesn't exist")
        elif not path.is_dir():
            out.append(f"{label}: {self.path} is no folder")
        for pattern in self.include + self.exclude:
            if not _balanced(pattern):
                out.append(f"{label}: {pattern!r} is no pattern")
        if self.trust not in TRUST:
            out.append(f"{label}: trust {self.trust!r} is none of {', '.join(TRUST)}")
        return out


@dataclass(frozen=True)
class Openers:
    """Programs with their arguments by kind of target (fixed placeholders in braces)."""

    markdown: tuple[str, ...] = ("nvim", "{path}")
    text: tuple[str, ...] = ("nvim", "+{line}", "{path}")
    directory: tuple[str, ...] = ("open", "{path}")
    url: tuple[str, ...] = ("open", "{url}")
    video: tuple[str, ...] = ("mpv", "--start={seconds}", "{url}")


@dataclass(frozen=True)
class Config:
    """A settings file: sources, openers and search."""

    sources: tuple[Source, ...] = ()
    openers: Openers = field(default_factory=Openers)
    search: Search = field(default_factory=Search)

    def problems(self) -> list[str]:
        """All that is wrong, so that one edit mends the file."""
        out = [] if self.sources else ["no sources are set, so there is nothing to index"]
        seen = set()
        for at, source in enumerate(self.sources):
            label = f"source {source.name!r}" if source.name else f"sources[{at}]"
            out += source.problems(label)
            if source.name and source.name in seen:
                out.append(f"{label}: the name is there twice")
            seen.add(source.name)
        out += [f"openers.{f.name}: needs a program" for f in fields(self.openers) if not getattr(self.openers, f.name)]
        return out + [f"search.{x}" for x in self.search.problems()]


class ConfigError(ValueError):
    """A settings file that can't be used; `problems` has all that is wrong."""

    def __init__(self, path: str, problems: list[str]):
        super().__init__("\n  - ".join([f"{path} can't be used:", *problems]))
        self.problems = problems


def _balanced(pattern: str) -> bool:
    """Whether the brackets and braces of a pattern close, and no backslash ends it."""
    bare = re.sub(r"(?s)\\.", "", pattern)
    bare = re.sub(r"\[[!^]?\]?[^\]]*\]", "", bare)
    depth = 0
    for c in re.sub(r"[^{}\[\\]", "", bare):
        depth += {"{": 1, "}": -1}.get(c, -9)
        if depth < 0:
            return False
    return depth == 0


def _typed(kind: Any, value: Any, where: str, problems: list[str]) -> Any:
    """value as the type of a setting; what doesn't fit is a problem and becomes None."""
    if is_dataclass(kind):
        if not isinstance(value, dict):
            problems.append(f"{where}: is a group of settings")
            return kind()
        hints, given = get_type_hints(kind), {}
        for name, x in value.items():
            at = f"{where}.{name}".lstrip(".")
            if name not in hints:
                problems.append(f"{at}: there is no such setting; known: {', '.join(sorted(hints))}")
                continue
            before = len(problems)
            made = _typed(hints[name], x, at, problems)
            if len(problems) == before or is_dataclass(hints[name]):
                given[name] = made
        return kind(**given)
    if getattr(kind, "__origin__", None) is tuple:
        if not isinstance(value, list):
            problems.append(f"{where}: is a list")
            return ()
        return tuple(_typed(kind.__args__[0], x, f"{where}[{i}]", problems) for i, x in enumerate(value))
    fits = isinstance(value, (int, float)) and not isinstance(value, bool) if kind is float else type(value) is kind
    if not fits:
        problems.append(f"{where}: {value!r} is no {kind.__name__}")
        return None
    return kind(value)


def load(path: str) -> Config:
    """The settings of a TOML file, with ~ and ~/ at the start of paths expanded. All problems are reported at once.

    Settings that the file doesn't name keep their defaults. A file that is missing or no TOML is a ConfigError too.
    """
    try:
        raw = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as error:
        raise ConfigError(path, [str(error)]) from error
    problems: list[str] = []
    config = _typed(Config, raw, "", problems)
    expand = lambda p: str(Path.home()) + p[1:] if p == "~" or p.startswith("~/") else p
    config = replace(config, sources=tuple(replace(s, path=expand(s.path)) for s in config.sources))
    problems += config.problems()
    if problems:
        raise ConfigError(path, problems)
    return config


def with_override(config: Any, key: str, value: str) -> Any:
    """A copy with one dotted key replaced; a key that doesn't exist or a value of another type is an error."""
    head, _, rest = key.partition(".")
    names = {f.name for f in fields(config)}
    if head not in names:
        raise KeyError(f"there is no setting {head!r}; known: {', '.join(sorted(names))}")
    old = getattr(config, head)
    if rest:
        if not is_dataclass(old):
            raise KeyError(f"{head!r} has no settings of its own")
        return replace(config, **{head: with_override(old, rest, value)})
    if is_dataclass(old):
        raise KeyError(f"{head!r} is a group of settings")
    if isinstance(old, bool):
        if value not in ("true", "false"):
            raise ValueError(f"{key} takes true or false")
        return replace(config, **{head: value == "true"})
    return replace(config, **{head: type(old)(value)})


def sweep(specs: list[str]) -> list[dict[str, str]]:
    """All combinations of specs like "key=v1,v2", the last key varying fastest."""
    out: list[dict[str, str]] = [{}]
    for spec in specs:
        key, _, values = spec.partition("=")
        if not values:
            raise ValueError(f"a sweep is written key=v1,v2, not {spec!r}")
        out = [combo | {key: v} for combo in out for v in values.split(",")]
    return out
