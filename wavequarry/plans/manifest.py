"""Manifests: documents of global blocks and assets, resolved to one job an asset (C1 to C6, C16, IO14 to IO16, J4)."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_VERSION = re.compile(r"\d+\.\d+(\.\d+)?")


class ManifestError(ValueError):
    """A manifest that can't be used."""


def load_manifest(path: str) -> dict:
    """IO14: a JSON or YAML document by suffix; an empty one is ``{}``."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in (".json", ".yaml", ".yml"):
        raise ManifestError(f"unknown suffix {suffix!r}")
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    except FileNotFoundError as e:
        raise ManifestError(f"no such manifest: {path}") from e
    if not text.strip():
        return {}
    if suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ManifestError("YAML manifests need pyyaml") from e
    return yaml.safe_load(text) or {}


def merged(base: Any, override: Any) -> Any:
    """Objects merge key by key; anything else is replaced by the override."""
    if not (isinstance(base, dict) and isinstance(override, dict)):
        return override
    return base | {k: merged(base[k], v) if k in base else v for k, v in override.items()}


@dataclass(frozen=True)
class Field:
    """Where a dotted path of a manifest goes: a bucket and key, and the type that its text is turned into."""

    bucket: str
    key: str
    kind: type = str


@dataclass
class Registry:
    """The blocks that are known; others are left out."""

    fields: dict[str, Field] = field(default_factory=dict)

    def register(self, block: str, **keys: Field) -> None:
        for name, f in keys.items():
            self.fields[f"{block}.{name}"] = f

    def keys(self) -> list[str]:
        """C5."""
        return sorted(self.fields)

    def flatten(self, doc: dict, prefix: str = "") -> dict[str, dict[str, Any]]:
        out: dict[str, dict[str, Any]] = {}
        for name, value in doc.items():
            path = f"{prefix}{name}"
            if path in self.fields:
                if value is not None:
                    f = self.fields[path]
                    out.setdefault(f.bucket, {})[f.key] = coerced(f.kind, value, path)
            elif isinstance(value, dict):
                for bucket, own in self.flatten(value, f"{path}.").items():
                    out.setdefault(bucket, {}).update(own)
        return out


def coerced(kind: type, value: Any, path: str) -> Any:
    """C4: any non-empty text is true, as the kind's own constructor has it; a value that doesn't fit is an error."""
    try:
        return kind(value)
    except (TypeError, ValueError) as e:
        raise ManifestError(f"{path}: {value!r} isn't {kind.__name__}") from e


def validate(doc: dict, vocabulary: frozenset[str] = frozenset()) -> list[str]:
    """What is wrong with a manifest."""
    wrong = []
    if not _VERSION.fullmatch(str(doc.get("version", ""))):
        wrong.append("version")
    assets = doc.get("assets")
    if not isinstance(assets, list) or not all(isinstance(a, dict) for a in assets):
        return [*wrong, "assets"]
    for k, a in enumerate(assets):
        if not ("input" in a or "input_dir" in a):
            wrong.append(f"assets[{k}].input")
        wrong += [f"assets[{k}].stems: {s}" for s in a.get("stems", []) if vocabulary and s not in vocabulary]
    return wrong


def jobs(doc: dict, registry: Registry, listing: dict[str, list[str]] | None = None, cli: dict[str, Any] | None = None) -> list[dict]:
    """A job per asset: global blocks, the asset's own over them, what the command line sets over both.

    A directory asset stands for each file that ``listing`` has for it, sorted by base name, each with settings of its own.
    """
    wrong = validate(doc)
    if wrong:
        raise ManifestError(", ".join(wrong))
    common = {k: v for k, v in doc.items() if k not in ("version", "assets")}
    out = []
    for asset in doc["assets"]:
        own = {k: v for k, v in asset.items() if k not in ("input", "output", "input_dir")}
        settings = registry.flatten(merged(common, own))
        settings.setdefault("config", {}).update({k: v for k, v in (cli or {}).items() if v is not None})
        files = sorted((listing or {}).get(asset["input_dir"], []), key=os.path.basename) if "input_dir" in asset else [asset["input"]]
        out += [{"input": f, "output": asset.get("output"), **{b: dict(v) for b, v in settings.items()}} for f in files]
    return out


def job_table(spark: SparkSession, resolved: list[dict]) -> DataFrame:
    """Jobs as rows, their settings as maps of text."""
    rows = [(j["input"], j["output"], {k: json.dumps(v) for k, v in j.get("config", {}).items()}, {k: json.dumps(v) for k, v in j.get("engine", {}).items()}) for j in resolved]
    return spark.createDataFrame(rows, "input string, output string, config map<string,string>, engine map<string,string>")


def key_values(text: str) -> dict[str, str]:
    """``K=V,K=V``."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        key, sep, value = part.partition("=")
        if not sep or not key.strip():
            raise ManifestError(f"not K=V: {part!r}")
        out[key.strip()] = value.strip()
    return out
