"""Layouts of scripted objects that a file doesn't carry (SRC-21, PRJ-05, JOIN-18, UDF-03)."""

from __future__ import annotations

import json
from dataclasses import dataclass

from assetlake.sources.binary import Budget, InvalidData
from assetlake.sources.serialized import Node, _check_levels


@dataclass(frozen=True)
class Limits:
    entries: int = 100_000
    nodes: int = 5_000_000
    string_bytes: int = 256 << 20


def _assembly(name: str) -> str:
    name = name.lower()
    return name[:-4] if name.endswith(".dll") else name


class Registry:
    """Layouts by (assembly without case and `.dll`, namespace, class) and version; the first document wins."""

    def __init__(self):
        self.exact: dict[tuple, list[Node]] = {}
        self.any: dict[tuple, list[Node]] = {}

    @classmethod
    def from_json(cls, document: str | bytes, limits: Limits = Limits()) -> Registry:
        """A list of entries, or an object with `entries`: assembly, namespace, class, unity_version, nodes."""
        registry = cls()
        registry.add(document, limits)
        return registry

    def add(self, document: str | bytes, limits: Limits = Limits()) -> None:
        try:
            data = json.loads(document)
        except ValueError as e:
            raise InvalidData(f"a schema document: {e}") from e
        entries = data.get("entries") if isinstance(data, dict) else data
        if not isinstance(entries, list):
            raise InvalidData("a schema document without entries")
        count, nodes, size = Budget("entries", limits.entries), Budget("nodes", limits.nodes), Budget("string bytes", limits.string_bytes)
        for e in entries:
            count.charge(1)
            try:
                key = (_assembly(e["assembly"]), e.get("namespace") or "", e["class"])
                tree = [Node(n["level"], n["type"], n["name"], n.get("byte_size", -1), n.get("index", 0), n.get("type_flags", 0), n.get("version", 1), n.get("meta_flags", 0)) for n in e["nodes"]]
            except (KeyError, TypeError, AttributeError) as error:
                raise InvalidData(f"a schema entry lacks {error}") from error
            nodes.charge(len(tree))
            size.charge(sum(len(n.type.encode()) + len(n.name.encode()) for n in tree))
            _check_levels(tree)
            if e.get("unity_version"):
                self.exact.setdefault((*key, e["unity_version"]), tree)
            else:
                self.any.setdefault(key, tree)

    def find(self, assembly: str, namespace: str, name: str, unity_version: str | None = None) -> list[Node] | None:
        """The layout of the exact version, else the one without a version."""
        key = (_assembly(assembly), namespace, name)
        return self.exact.get((*key, unity_version)) or self.any.get(key)
