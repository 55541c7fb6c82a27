"""What each language needs: its files, how its modules are named, and how an import as written becomes a module key."""

from __future__ import annotations

import hashlib
import posixpath
from dataclasses import astuple, dataclass

INIT_FILES = {"__init__.pyi", "__init__.py"}


@dataclass(frozen=True)
class Pack:
    """Rules of a language.

    ``style`` says what names a module: its dotted path, a path next to the importer, or a directory.  With a
    ``separator``, imports are fully qualified names instead; ``prefix`` means that they name a whole namespace, and
    ``by_path`` that the namespace is the file's path.  ``bare`` paths are relative without a leading dot, and a
    ``wildcard`` import without names brings in everything.
    """

    slug: str
    language: str
    endings: str
    style: str = "dotted"
    separator: str = ""
    prefix: bool = False
    by_path: bool = False
    bare: bool = False
    wildcard: bool = False

    @property
    def extensions(self) -> list[str]:
        return [f".{e}" for e in self.endings.split()]

    def stem(self, path: str) -> str:
        return next((path[: -len(e)] for e in sorted(self.extensions, key=len, reverse=True) if path.endswith(e)), path)

    def module(self, path: str) -> str:
        """The key under which a file (its path below the source root) is imported."""
        if self.style == "directory":
            return posixpath.dirname(path)
        if self.style == "path":
            return self.stem(path)
        parts = [p for p in self.stem(path).split("/") if p]
        return ".".join(parts[:-1] if parts[-1:] == ["__init__"] else parts)

    def target(self, path: str, written: str, module: str = "") -> str:
        """The module key that ``written`` means in the file ``path``, whose own key is ``module``."""
        if self.style == "directory":
            return written
        if self.style == "path":
            bare = self.stem(written)
            near = self.bare or bare.startswith(("./", "../"))
            return posixpath.normpath(f"{posixpath.dirname(path)}/{bare}".lstrip("/")) if near else bare
        name = written.lstrip(".")
        up = len(written) - len(name)
        if not up:
            return written
        package = [p for p in module.split(".") if p]
        if posixpath.basename(path) not in INIT_FILES:
            package = package[:-1]
        package = package[: max(0, len(package) - (up - 1))]
        return ".".join([*package, name] if name else package)

    def fingerprint(self) -> str:
        """Changes whenever the rules do, so that an index made by others is built anew."""
        return hashlib.sha256(repr((RULES, astuple(self))).encode()).hexdigest()[:16]


#: Version of the scanners; part of every fingerprint.
RULES = 1
PACKS = [
    Pack("py", "python", "py"),
    Pack("js", "javascript", "cjs js jsx mjs", "path"),
    Pack("ts", "typescript", "ts", "path"),
    Pack("go", "go", "go", "directory"),
    Pack("rb", "ruby", "rb", "path", bare=True, wildcard=True),
    Pack("cpp", "cpp", "cc cpp cxx h hh hpp hxx", "path", bare=True),
    Pack("java", "java", "java", separator="."),
    Pack("cs", "csharp", "cs", separator=".", prefix=True),
    Pack("php", "php", "php", separator="\\"),
    Pack("rs", "rust", "rs", separator="::", by_path=True),
]
BY_SLUG = {p.slug: p for p in PACKS}
BY_EXTENSION = {e: p for p in PACKS for e in p.extensions}
BY_LANGUAGE = {p.language: p for p in PACKS}


def pack_of(path: str) -> Pack | None:
    return BY_EXTENSION.get(posixpath.splitext(path)[1])


def path_namespace(path: str) -> str:
    """Where a file's items live when its path is its namespace: below the crate, without ``mod`` and the root files."""
    parts = path.removesuffix(".rs").split("/")
    parts = parts[1:] if parts[0] == "src" and len(parts) > 1 else parts
    if len(parts) > 1 and parts[-1] == "mod":
        parts.pop()
    return "" if parts in (["lib"], ["main"], ["mod"]) else "/".join(parts)


def fingerprints() -> dict[str, str]:
    return {p.slug: p.fingerprint() for p in PACKS}
