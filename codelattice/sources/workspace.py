"""Workspaces: several repositories served as one, each with settings from four layers, and where a store lies."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from dataclasses import dataclass, field

from codelattice.sources.repository import MOST_KB

DEFAULTS = {
    "index": {"include": [], "exclude": [], "most_kb": MOST_KB, "frameworks": "auto"},
    "chunking": {"max_tokens": 512, "min_tokens": 64},
    "embed": {"driver": "fake", "dimension": 64},
    "retrieve": {"k": 8, "depth": 1, "rerank": "off"},
    "query": {"enabled": True, "max_rows": 1000, "timeout_ms": 5000, "max_expansions": 50_000},
    "temporal": {"enabled": True, "history": 50},
    "watch": {"policy": "on-save", "debounce_ms": 2000, "idle_ms": 30_000, "interval_ms": 300_000, "branches": [], "not_branches": []},
}
CONFIG = "lattice.yaml"


def merged(*layers: dict) -> dict:
    """Later layers win; mappings merge key by key, everything else is replaced."""
    out: dict = {}
    for layer in layers:
        for key, value in (layer or {}).items():
            out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def _yaml(path: str) -> dict:
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f)
    except OSError:
        return {}
    return data if isinstance(data, dict) else {}


@dataclass
class Member:
    name: str
    path: str
    url: str = ""
    ref: str = ""
    settings: dict = field(default_factory=dict)


def members(workspace: str) -> list[Member]:
    """The members that a workspace file lists, with their settings: defaults, the workspace's, the repository's own file, the member's entry."""
    data, base = _yaml(workspace), os.path.dirname(os.path.abspath(workspace))
    out = []
    for entry in data.get("members", []):
        entry = {"path": entry} if isinstance(entry, str) else dict(entry)
        path = os.path.normpath(os.path.join(base, entry.get("path") or entry.get("name", ".")))
        name = entry.get("name") or os.path.basename(path)
        if any(m.name == name for m in out):
            raise ValueError(f"two members are named {name}")
        settings = merged(DEFAULTS, data.get("defaults", {}), _yaml(os.path.join(path, CONFIG)), entry.get("settings", {}))
        out.append(Member(name, path, entry.get("url", ""), entry.get("ref", ""), settings))
    return out


def settings_of(root: str, **given: dict) -> dict:
    return merged(DEFAULTS, _yaml(os.path.join(root, CONFIG)), given)


def problems(settings: dict) -> list[str]:
    """What is wrong with settings, before anything runs on them."""
    from codelattice.extract.frameworks import PACKS

    out = [f"unknown section: {k}" for k in settings if k not in DEFAULTS]
    out += [f"unknown setting: {k}.{n}" for k, v in settings.items() if k in DEFAULTS and isinstance(v, dict) for n in v if n not in DEFAULTS[k]]
    at = merged(DEFAULTS, settings)
    if at["watch"]["policy"] not in ("on-commit", "on-save", "on-idle", "interval", "manual"):
        out.append(f"watch.policy: {at['watch']['policy']}")
    rerank = {True: "lexical", False: "off"}.get(at["retrieve"]["rerank"], at["retrieve"]["rerank"])
    if rerank not in ("off", "lexical", "cross"):
        out.append(f"retrieve.rerank: {rerank}")
    chosen = at["index"]["frameworks"]
    if chosen not in ("auto", "off") and (unknown := sorted(set(chosen) - PACKS.keys())):
        out.append(f"index.frameworks: {unknown}")
    numbers = [("index", "most_kb"), ("chunking", "max_tokens"), ("embed", "dimension"), ("query", "max_rows"), ("query", "timeout_ms")]
    return out + [f"{a}.{b} must be a positive number" for a, b in numbers if not isinstance(at[a][b], int) or at[a][b] <= 0]


def slug(text: str) -> str:
    return re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9._-]+", "-", text.lower()))


def repository_key(root: str) -> str:
    """A name for a repository: owner and name of its origin, or its folder and a hash of where that is."""
    done = subprocess.run(["git", "-C", root, "remote", "get-url", "origin"], capture_output=True, check=False)
    url = done.stdout.decode(errors="replace").strip() if not done.returncode else ""
    if m := re.search(r"[:/]([^/:]+)/([^/]+?)(?:\.git)?/?$", url):
        return slug(f"{m[1]}-{m[2]}")
    at = os.path.abspath(root)
    return f"{slug(os.path.basename(at))}-{hashlib.sha1(at.encode()).hexdigest()[:8]}"


def store_root(root: str, central: str = "") -> str:
    """Where the graph of a repository is kept: beside it, or in a central folder by its key."""
    return os.path.join(central, repository_key(root)) if central else os.path.join(root, ".lattice")


def is_read_only(root: str) -> bool:
    return os.path.exists(root) and not os.access(root, os.W_OK)
