"""Named sources: from a YAML or JSON file, or from the files of a directory."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import SparkSession

from ..plans.results import Database, data
from .resources import kind_of, resource


def _load(path: str) -> dict:
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError:
        return _plain_yaml(text)
    return yaml.safe_load(text) or {}


def _plain_yaml(text: str) -> dict:
    """Mappings of names to names or scalars, two levels deep: what a catalog needs, where no YAML library is there."""
    out: dict = {}
    inner = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        key, _, value = bare.strip().partition(":")
        value = value.strip().strip("'\"")
        if bare[0] in " \t":
            inner[key.strip("'\"")] = value
        elif value:
            out[key.strip("'\"")] = value
        else:
            inner = out[key.strip("'\"")] = {}
    return out


def from_file(path: str, spark: SparkSession, views: bool = False) -> Database:
    """Tables by name; an entry is a URI or ``{source: URI, dshape: ..., ...reader options}``.

    A directory as a source becomes a nested catalog.  With ``views`` they are temporary views too.
    """
    out = Database()
    for name, entry in _load(path).items():
        entry = dict(entry) if isinstance(entry, dict) else {"source": entry}
        source, shape = entry.pop("source"), entry.pop("dshape", None)
        if "://" not in source and not source.startswith(("/", "table:", "jdbc:")):
            source = str(Path(path).parent / source)
        if os.path.isdir(source) and not any(p.name.startswith(("part-", "_SUCCESS")) for p in Path(source).iterdir()):
            out[name] = from_directory(source, spark)
            continue
        df = resource(source, spark, **entry)
        out[name] = data(df, shape, name=name, spark=spark)
        if views:
            df.createOrReplaceTempView(name)
    return out


def from_directory(path: str, spark: SparkSession, ignore: tuple[str, ...] = (), hidden: bool = False, follow_links: bool = True) -> Database:
    """The readable files of a directory by name, its directories as nested catalogs."""
    out = Database()
    for p in sorted(Path(path).iterdir()):
        if p.name in ignore or (p.name.startswith(".") and not hidden) or (p.is_symlink() and not follow_links):
            continue
        try:
            kind_of(p.name)
        except NotImplementedError:
            if p.is_dir() and (below := from_directory(str(p), spark, ignore, hidden, follow_links)):
                out[p.name] = below
            continue
        name = p.name.split(".")[0]
        out[name] = data(resource(str(p), spark), name=name, spark=spark)
    return out
