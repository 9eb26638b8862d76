"""Formatters of known commands' output: a registry by command and subcommand, applied as one vectorised UDF."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Formatter = Callable[[str], str]
_TABLE: dict[tuple[str, str], Formatter] = {}


def formatter(base: str, *subs: str) -> Callable[[Formatter], Formatter]:
    def add(f: Formatter) -> Formatter:
        _TABLE.update({(base, s): f for s in subs or ("",)})
        return f

    return add


def _some(title: str, items: list[str], most: int, shown: int) -> list[str]:
    if not items:
        return []
    return [f"{title}({len(items)}): " + ", ".join(items if len(items) <= most else [*items[:shown], f"...+{len(items) - shown}"])]


@formatter("git", "status")
def git_status(out: str) -> str:
    found: dict[str, list[str]] = {"staged": [], "modified": [], "untracked": []}
    section = ""
    for line in out.splitlines():
        t = line.strip()
        if t.startswith("Changes to be committed"):
            section = "staged"
        elif t.startswith("Changes not staged"):
            section = "modified"
        elif t.startswith("Untracked files"):
            section = "untracked"
        elif line.startswith("\t") and section and not t.startswith("(use"):
            found[section].append(t)
        elif m := re.match(r"(\?\?|[MADR ][MD ]) (.+)", line):
            code, name = m.groups()
            found["untracked" if code == "??" else "staged" if code[0] != " " else "modified"].append(name if code == "??" else f"{code.strip()[0]} {name}")
    if not any(found.values()):
        return "clean" if "nothing to commit" in out else out
    return "\n".join([*_some("staged", found["staged"], 1 << 30, 0), *_some("modified", found["modified"], 1 << 30, 0), *_some("untracked", found["untracked"], 5, 3)])


@formatter("git", "log")
def git_log(out: str) -> str:
    commits = re.findall(r"^commit ([0-9a-f]+).*\n((?:.*\n?)*?)(?=^commit |\Z)", out, re.M)
    if not commits:
        return out
    subject = lambda body: next((x.strip() for x in body.splitlines() if x.strip() and not re.match(r"(Author|Date|Merge):", x)), "")
    return "\n".join(f"{h[:7]} {subject(body)}".rstrip() for h, body in commits)


@formatter("git", "diff")
def git_diff(out: str) -> str:
    kept, context = [], 0
    for line in out.splitlines():
        context = 0 if line.startswith(("diff --git", "@@", "+", "-")) else context + 1
        if context <= 1:
            kept.append(line)
    return "\n".join(kept)


@formatter("git", "add", "commit", "push", "pull", "checkout", "switch", "branch")
def git_short(out: str) -> str:
    if not out.strip() or "Already up to date" in out:
        return "ok up-to-date" if out.strip() else "ok"
    if m := re.search(r"(\d+) files? changed(?:, (\d+) insertion[^,\n]*)?(?:, (\d+) deletion[^,\n]*)?", out):
        return f"ok {m[1]} files +{m[2] or 0} -{m[3] or 0}"
    line = next((x for x in out.splitlines() if "->" in x or ("[" in x and "]" in x)), None)
    return f"ok {line.strip()}" if line else "\n".join(out.splitlines()[:3])


@formatter("cargo", "build", "check")
def build_errors(out: str) -> str:
    lines = out.splitlines()
    problems = [x for x in lines if x.startswith(("error", "warning"))]
    if not problems:
        return next((x.strip() for x in reversed(lines) if "Finished" in x or "Compiling" in x), "ok")
    return "\n".join([f"ERRORS: {len(problems)}", *(x if x.startswith("error") else f"  {x.strip()}" for x in lines if x.startswith("error") or x.strip().startswith("-->"))])


@formatter("cargo", "test")
@formatter("npm", "test")
@formatter("go", "test")
@formatter("pytest")
def test_failures(out: str) -> str:
    lines = out.splitlines()
    summary = next((x for x in reversed(lines) if x.startswith(("test result:", "Tests:"))), "")
    failed = list(dict.fromkeys(x for x in lines if "FAIL" in x and x != summary))
    details = [d.strip() for d in re.findall(r"^---- .* ----\n(?:.+\n?)*", out, re.M)]
    if not failed and not details:
        passed = sum("... ok" in x or "PASSED" in x for x in lines)
        return summary or (f"ok: {passed} tests passed" if passed else out)
    return "\n".join([*([summary] if summary else []), f"FAILURES ({len(failed) + len(details)}):", *failed, *details])


@formatter("npm", "install", "i", "add")
def npm_install(out: str) -> str:
    line = next((x.strip() for x in out.splitlines() if "added" in x and "packages" in x), None)
    risk = next((x.strip() for x in out.splitlines() if "vulnerabilities" in x), None)
    return line or (f"ok ({risk})" if risk else "ok")


def _columns(out: str, head: str, row: Callable[[list[str]], str]) -> str:
    lines = out.splitlines()
    return "\n".join([head, *(row(re.split(r"\s{2,}", x.strip())) for x in lines[1:] if x.strip())]) if lines else out


@formatter("docker", "ps")
def docker_ps(out: str) -> str:
    return _columns(out, "NAME | IMAGE | STATUS", lambda c: f"{c[-1]} | {c[1]} | {c[4]}" if len(c) >= 6 else " ".join(c))


@formatter("docker", "images")
def docker_images(out: str) -> str:
    return _columns(out, "REPO:TAG | SIZE", lambda c: f"{c[0]}:{c[1]} | {c[-1]}" if len(c) >= 4 else " ".join(c))


@formatter("kubectl", "get")
def kubectl_get(out: str) -> str:
    return "\n".join(" ".join(x.split()) for x in out.splitlines())


@formatter("ls")
def ls(out: str) -> str:
    names = [x for x in out.splitlines() if x]
    if len(names) <= 20:
        return out
    folders = [x for x in names if x.endswith("/") or x.startswith("d")]
    return "\n".join([*_some("dirs", folders, 10, 10), *_some("files", [x for x in names if x not in folders], 5, 5)])


@formatter("find")
def find(out: str) -> str:
    paths = [PurePosixPath(x.strip()) for x in out.splitlines() if x.strip()]
    if len(paths) <= 20:
        return out
    by: dict[str, list[str]] = defaultdict(list)
    for p in paths:
        by[str(p.parent)].append(p.name)
    return "\n".join([f"{len(paths)} files found:", *(f"  {d}/ ({len(n)} files)" if len(n) > 5 else f"  {d}/ {', '.join(n)}" for d, n in sorted(by.items()))])


@formatter("tsc")
def tsc(out: str) -> str:
    by: dict[str, list[str]] = defaultdict(list)
    for line in out.splitlines():
        if re.search(r"\): (error|warning) TS", line):
            by[line.split("(")[0]].append(line)
    if not by:
        return "ok: 0 errors" if "Found 0 errors" in out or not out.strip() else out
    body = [y for f, e in sorted(by.items()) for y in (f"  {f} ({len(e)}):", *(f"    {x}" for x in e[:5]), *([f"    ...+{len(e) - 5} more"] if len(e) > 5 else []))]
    return "\n".join([f"ERRORS: {sum(map(len, by.values()))} in {len(by)} files", *body])


@formatter("eslint")
@formatter("biome")
@formatter("cargo", "clippy")
def lint(out: str) -> str:
    rules = Counter(x.split()[-1] for x in out.splitlines() if "error" in x or "warning" in x)
    if not rules:
        return "ok: 0 issues"
    top = sorted(rules.items(), key=lambda x: (-x[1], x[0]))
    return "\n".join([f"{sum(rules.values())} issues:", *(f"  {r} ({n}x)" for r, n in top[:10]), *([f"  ...+{len(top) - 10} more rules"] if len(top) > 10 else [])])


def format_output(command: str, out: str) -> str | None:
    """The formatted output, or None if the command has no formatter."""
    parts = command.split()
    base = PurePosixPath(parts[0]).name.lower() if parts else ""
    f = _TABLE.get((base, parts[1] if len(parts) > 1 else "")) or _TABLE.get((base, ""))
    return f(out) if f else None


@F.pandas_udf(StringType())
def _formatted(commands: pd.Series, outs: pd.Series) -> pd.Series:
    return pd.Series([format_output(c or "", o or "") for c, o in zip(commands, outs, strict=True)], dtype=object)


def formatted(command: Column, output: Column) -> Column:
    """The output formatted if that makes it shorter, else as it is."""
    f = _formatted(command, output)
    return F.coalesce(F.when(F.octet_length(f) < F.octet_length(output), f), output)
