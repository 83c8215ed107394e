"""Which repository a working directory belongs to: ``.git`` folders, pointers and worktrees, and their configuration."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTSIDE = "outside any repo"


def origin_url(config: str) -> str:
    """The last url of remote "origin" in a git configuration."""
    section, found = "", ""
    for line in config.splitlines():
        line = line.strip()
        if m := re.match(r'^\[\s*([^\s\]"]+)\s*(?:"((?:[^"\\]|\\.)*)")?\s*\]', line):
            section = m[1].lower() + (f".{re.sub(r'\\(.)', r'\1', m[2])}" if m[2] is not None else "")
        elif section == "remote.origin" and (m := re.match(r"(?i)^url\s*=\s*(.*)$", line)):
            found = unquoted(m[1])
    return found


def unquoted(value: str) -> str:
    """A configuration value without quotes, escapes resolved, a comment cut off."""
    out, quoted, i = [], False, 0
    while i < len(value):
        c = value[i]
        if c == "\\" and i + 1 < len(value):
            i += 1
            out.append({"n": "\n", "t": "\t", "b": "\b"}.get(value[i], value[i]))
        elif c == '"':
            quoted = not quoted
        elif c in "#;" and not quoted:
            break
        else:
            out.append(c)
        i += 1
    return "".join(out).strip()


def normalized(remote: str) -> str:
    """host/path of a remote; the same as ``functions.text.remote_id``."""
    u = remote.strip().rstrip("/")
    if "://" in u:
        host, _, path = u.split("://", 1)[1].partition("/")
        host = host.rpartition("@")[2]
        host = host.rpartition(":")[0] if ":" in host else host
    elif re.match(r"^[^/:]+:", u):
        host, _, path = u.partition(":")
        host = host.rpartition("@")[2]
    else:
        host, path = "", u
    path = path.strip("/").removesuffix(".git").strip("/")
    return (host + ("/" if host and path else "") + path).lower()


def git_dir(folder: str) -> str | None:
    """The common git directory of a folder that is a checkout, a linked worktree's included."""
    at = os.path.join(folder, ".git")
    if os.path.isdir(at):
        return at
    if not os.path.isfile(at) or os.path.getsize(at) > 4096:
        return None
    with open(at, encoding="utf-8", errors="replace") as f:
        m = re.match(r"gitdir:\s*(.+)", f.read().strip())
    if not m:
        return None
    target = os.path.normpath(os.path.join(folder, m[1].strip()))
    pointer = os.path.join(target, "commondir")
    if os.path.isfile(pointer):
        with open(pointer, encoding="utf-8", errors="replace") as f:
            return os.path.normpath(os.path.join(target, f.read().strip()))
    # A worktree whose entry was pruned: <common>/worktrees/<id>.
    parent = os.path.dirname(target)
    return os.path.dirname(parent) if os.path.basename(parent) == "worktrees" else target


def resolve(cwd: str) -> str:
    """The nearest ancestor with a remote; else the innermost repository's path; else outside."""
    inner = ""
    folder = cwd
    while folder:
        common = git_dir(folder)
        if common:
            config = os.path.join(common, "config")
            if os.path.isfile(config):
                with open(config, encoding="utf-8", errors="replace") as f:
                    if url := origin_url(f.read()):
                        return normalized(url)
            inner = inner or folder
        parent = os.path.dirname(folder)
        folder = parent if parent != folder else ""
    return inner or OUTSIDE


def with_repos(turns: DataFrame, resolver: Callable[[str], str] = resolve) -> DataFrame:
    """Turns with ``repo``: each distinct directory is resolved once and joined back."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(repo=[resolver(c) if c else "" for c in p["cwd"]])

    dimension = turns.select("cwd").distinct().mapInPandas(run, "cwd string, repo string")
    columns = turns.columns
    return turns.drop("repo").join(dimension, "cwd", "left").withColumn("repo", F.coalesce("repo", F.lit(""))).select(*columns)
