"""Which files of a corpus folder on this machine a search leaves out or Spark's listing would miss."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field


def pattern(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """An ignore file's line as a test of paths below its folder, whether it takes paths back in, and whether it is for folders alone."""
    line = line.rstrip("\n").rstrip("\r")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    out, i = "", 0
    line = line.removeprefix("/")
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            inside = line[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        else:
            i += line[i] == "\\" and i + 1 < len(line)
            out, i = out + re.escape(line[i]), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out, re.S), back, folder


@dataclass
class Rules:
    """Rules of one folder's ignore files; later ones win."""

    base: str
    tests: list[tuple[re.Pattern, bool, bool]] = field(default_factory=list)

    def verdict(self, path: str, folder: bool) -> bool | None:
        """True: ignored; False: taken back in; None: not told."""
        inside = os.path.relpath(path, self.base).replace(os.sep, "/")
        for test, back, folders in reversed(self.tests):
            if (folder or not folders) and test.fullmatch(inside):
                return not back
        return None


def rules_of(folder: str, names: tuple[str, ...]) -> Rules:
    out = Rules(folder)
    for name in names:
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                out.tests += [p for p in map(pattern, f) if p]
        except OSError:
            pass
    return out


def ignored(path: str, folder: bool, chain: list[Rules]) -> bool:
    """By the innermost folder's rules that tell."""
    return next((v for r in reversed(chain) if (v := r.verdict(path, folder)) is not None), False)


def special(root: str) -> tuple[list[str], list[str]]:
    """Paths below root, relative: files that ignore files exclude (or that lie in an excluded folder), and other visible files with a segment that begins with `_`.

    `.ignore` counts everywhere; `.gitignore` only within a git repository. Links aren't followed; names that begin with a dot are neither."""
    if not os.path.isdir(root):
        return [], []
    out, under = [], []
    chains: dict[str, tuple[list[Rules], bool, bool]] = {}  # rules, whether a repository holds the folder, whether the folder is excluded
    above, at = [], os.path.realpath(root)
    while os.path.dirname(at) != at:
        at = os.path.dirname(at)
        above.append(at)
    git = os.path.isdir(os.path.join(root, ".git")) or any(os.path.isdir(os.path.join(a, ".git")) for a in above)
    names = lambda in_git: (".gitignore", ".ignore") if in_git else (".ignore",)
    outer = [rules_of(a, names(git)) for a in reversed(above)]
    for folder, folders, files in os.walk(root):
        if folder == root:
            chain, in_git, gone = outer, git, False
        else:
            chain, in_git, gone = chains.pop(folder)
        in_git = in_git or os.path.isdir(os.path.join(folder, ".git"))
        real = os.path.realpath(folder)
        chain = [*chain, rules_of(real, names(in_git))]
        folders[:] = [f for f in folders if not f.startswith(".") and not os.path.islink(os.path.join(folder, f))]
        for f in folders:
            chains[os.path.join(folder, f)] = (chain, in_git, gone or ignored(os.path.join(real, f), True, chain))
        for f in files:
            if f.startswith(".") or os.path.islink(os.path.join(folder, f)):
                continue
            relative = os.path.relpath(os.path.join(folder, f), root)
            if gone or ignored(os.path.join(real, f), False, chain):
                out.append(relative)
            elif any(s.startswith("_") for s in relative.split(os.sep)):
                under.append(relative)
    return out, under
