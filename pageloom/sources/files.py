"""Driver-side helpers over file names: shard globs, checkpoints, retention."""

from __future__ import annotations

import glob
import os
import re

# Fixed value: one range of numbers in braces, as shells write it.
BRACES = re.compile(r"\{(\d+)\.\.(\d+)\}")


def shard_paths(pattern: str) -> list[str]:
    """Existing files of a pattern, sorted. One {a..b} range is spelt out, zero-padded as its first number and in either direction."""
    found = BRACES.search(pattern)
    if not found:
        return sorted(glob.glob(pattern))
    a, b = found.groups()
    low, high = sorted((int(a), int(b)))
    width = len(a) if a.startswith("0") or len(a) == len(b) else 0
    names = (f"{pattern[: found.start()]}{k:0{width}d}{pattern[found.end() :]}" for k in range(low, high + 1))
    return sorted(p for n in names for p in glob.glob(n))


def numbered(folder: str, prefix: str = "ckpt_", suffix: str = ".pt") -> list[tuple[int, str]]:
    """(number, path) of files named by a number, ascending; others are ignored."""
    if not os.path.isdir(folder):
        return []
    names = (n for n in os.listdir(folder) if n.startswith(prefix) and n.endswith(suffix))
    return sorted((int(n[len(prefix) : -len(suffix)]), os.path.join(folder, n)) for n in names if n[len(prefix) : -len(suffix)].isdigit())


def latest(folder: str) -> str | None:
    found = numbered(folder)
    return found[-1][1] if found else None


def surplus(folder: str, keep: int) -> list[str]:
    """Numbered files beyond the newest ``keep``; unnumbered ones such as the best are never among them."""
    found = numbered(folder)
    return [p for _, p in found[: max(0, len(found) - keep)]]
