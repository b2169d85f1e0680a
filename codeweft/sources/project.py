"""Project configuration that import resolution reads: small files, parsed on the driver."""

from __future__ import annotations

import json
import re
import subprocess


def without_comments(text: str) -> str:
    """JSON without // and /* */ comments and trailing commas; strings are left as they are."""
    out = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r",(\s*[}\]])", r"\1", out)


def tsconfig_paths(text: str) -> tuple[str | None, list[tuple[str, str]]]:
    """(base folder where one is named, [(alias prefix, target prefix)]): longest alias first, then by name.

    Of an alias the first target counts; an alias that is `*` alone says nothing and is left out.
    """
    options = json.loads(without_comments(text)).get("compilerOptions", {})
    paths = {k.removesuffix("*"): v[0].removesuffix("*") for k, v in options.get("paths", {}).items() if v}
    return options.get("baseUrl"), sorted(((k, v) for k, v in paths.items() if k), key=lambda p: (-len(p[0]), p[0]))


def tsconfig_of(texts: list[str]) -> tuple[str | None, list[tuple[str, str]]]:
    """What several configurations say, in their order: the first with aliases, else the first that names a base folder."""
    named = None
    for text in texts:
        try:
            base, aliases = tsconfig_paths(text)
        except ValueError:
            continue
        if aliases:
            return base, aliases
        named = base if named is None else named
    return named, []


def go_module(text: str) -> str | None:
    m = re.search(r"(?m)^\s*module\s+(\S+)", text)
    return m[1] if m else None


def go_path(specifier: str, module: str) -> str | None:
    """The folder within the repo of an import of its own module."""
    return specifier[len(module) :].strip("/") if specifier.startswith(module) else None


def psr4_prefixes(text: str) -> list[tuple[str, str]]:
    """[(namespace prefix, folder)] of composer.json, longest first."""
    found = json.loads(text).get("autoload", {}).get("psr-4", {})
    return sorted(((k, (v[0] if isinstance(v, list) else v).rstrip("/")) for k, v in found.items() if k), key=lambda p: (-len(p[0]), p[0]))


def psr4_path(name: str, prefixes: list[tuple[str, str]]) -> list[str]:
    return [_normal(f"{d}/{name[len(p):]}".replace("\\", "/")) for p, d in prefixes if name.startswith(p)]


def csproj_namespace(path: str, text: str) -> tuple[str, str]:
    """(folder, root namespace) of a project file; without one, the file's name."""
    m = re.search(r"<RootNamespace>\s*([^<]+?)\s*</RootNamespace>", text)
    folder, _, name = path.rpartition("/")
    return folder, m[1] if m else name.removesuffix(".csproj")


def csharp_order(projects: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(folder, root namespace) once each, longest folder first."""
    return sorted(set(projects), key=lambda p: (-len(p[0]), p))


def csharp_path(name: str, projects: list[tuple[str, str]], own: str = "") -> list[str]:
    """Folders that a namespace may lie in: the project that holds the file `own` first, then those with longer folders."""
    ordered = csharp_order(projects)
    holds = [p for p in ordered if own and (not p[0] or own.startswith(p[0] + "/"))]
    if holds:
        first = max(holds, key=lambda p: (len(p[0]), p[1]))
        ordered = [first, *(p for p in ordered if p != first)]
    return [_normal(f"{d}/{name[len(ns):].strip('.').replace('.', '/')}") for d, ns in ordered if name == ns or name.startswith(ns + ".")]


def _normal(path: str) -> str:
    out: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def git_changed_files(root: str, scope: str = "unstaged", base: str | None = None) -> list[str]:
    """Names of changed files; scope is unstaged, staged, all or compare (with a base)."""
    extra = {"unstaged": [], "staged": ["--staged"], "all": ["HEAD"], "compare": [base or ""]}[scope]
    if scope == "compare" and not base:
        raise ValueError("compare needs a base")
    done = subprocess.run(["git", "-C", root, "diff", "--name-only", *extra], capture_output=True, text=True, check=True)
    return [x for x in done.stdout.splitlines() if x]


def git_commit(root: str) -> str:
    """The commit checked out, empty where there is none."""
    done = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else ""
