"""Load settings from a properties file and the command line."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass, field

from weftgraph.operators.index import IndexSpec, check_names

# The keys of a properties file.
GRAPH, NODES, RELS = "batch_import.graph_db", "batch_import.nodes_files", "batch_import.rels_files"
KEEP, QUOTES, DELIM, SEPARATOR = "batch_import.keep_db", "batch_import.csv.quotes", "batch_import.csv.delim", "batch_array_separator"


class ConfigError(ValueError):
    """Settings that don't make a load."""


def read_properties(path: str) -> dict[str, str]:
    """Entries of a properties file: ``key=value`` or ``key:value`` lines, # and ! begin comments; a missing file has none."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as lines:
        return parse_properties(lines)


def parse_properties(lines: Iterable[str]) -> dict[str, str]:
    """Entries of the lines of a properties file; of a key that stands twice the last."""
    out: dict[str, str] = {}
    for line in (x.strip("\r\n").lstrip() for x in lines):
        if not line or line[0] in "#!":
            continue
        at = next((i for i, c in enumerate(line) if c in "=:"), len(line))
        out[line[:at].strip()] = line[at + 1 :].lstrip(" ").replace("\\t", "\t")
    return out


def is_set(settings: dict[str, str], key: str, word: str) -> bool:
    """Only the exact words true and false count, in any case."""
    return (settings.get(key) or "").lower() == word


class NamedArgs:
    """Positional arguments by name, in any case of letters: ``NamedArgs(args, "file", "count")``."""

    def __init__(self, args: list[str], *names: str) -> None:
        self.names = [n.lower() for n in names]
        self.args = list(args)

    @property
    def invalid(self) -> bool:
        """Whether there are fewer or more arguments than names."""
        return len(self.args) != len(self.names)

    def text(self, name: str) -> str:
        if name.lower() not in self.names:
            raise ConfigError(f"no argument {name}")
        at = self.names.index(name.lower())
        if at >= len(self.args):
            raise ConfigError(f"argument {name} missing")
        return self.args[at]

    def number(self, name: str) -> int:
        return int(self.text(name))


@dataclass(frozen=True)
class LoadConfig:
    """What to load and how. ``separator`` is a pattern where ``regex`` holds, as in a properties file. ``settings`` holds every entry, those of other tools too."""

    graph: str
    nodes: str = ""
    rels: str = ""
    keep: bool = False
    quotes: bool = True
    delim: str = "\t"
    separator: str = ","
    regex: bool = True
    indexes: list[IndexSpec] = field(default_factory=list)
    settings: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_args(cls, args: list[str]) -> LoadConfig:
        """``[x.properties] graph nodes rels (kind name type [file])*``. The file wins for graph, nodes and rels, the arguments win for indexes."""
        rest = list(args)
        settings = read_properties(rest.pop(0)) if rest and rest[0].endswith(".properties") else {}
        for key in (GRAPH, NODES, RELS):
            if rest and rest[0] not in ("node_index", "relationship_index"):
                given = rest.pop(0)
                settings.setdefault(key, given)
        while rest:
            if len(rest) < 3:
                raise ConfigError(f"an index needs kind, name and type: {' '.join(rest)}")
            kind, name, mode = rest[:3]
            rest = rest[3:]
            file = rest.pop(0) if rest and rest[0] not in ("node_index", "relationship_index") else None
            spec = IndexSpec(kind, name, mode, file)
            settings[spec.key] = spec.value
        return cls.from_settings(settings)

    @classmethod
    def from_settings(cls, settings: dict[str, str]) -> LoadConfig:
        if not settings.get(GRAPH):
            raise ConfigError("graph directory missing")
        specs = [s for k, v in settings.items() if (s := IndexSpec.from_entry(k, v))]
        check_names(specs)
        delim = settings.get(DELIM) or "\t"
        return cls(
            settings[GRAPH],
            settings.get(NODES, ""),
            settings.get(RELS, ""),
            is_set(settings, KEEP, "true"),
            not is_set(settings, QUOTES, "false"),
            (delim.strip() or delim)[0],
            settings.get(SEPARATOR) or ",",
            True,
            specs,
            settings,
        )
