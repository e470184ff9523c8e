"""Names of the markdown files of a local folder, as a person who lists it would name them: ignore files hold, hidden entries go."""

from __future__ import annotations

import os
import re
from pathlib import Path

IGNORE_FILES = (".gitignore", ".ignore")


class Ignored:
    """The patterns of one ignore file, for paths below its folder. The last pattern that fits decides; ! takes back."""

    def __init__(self, lines: list[str]):
        self.rules = []
        for line in lines:
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
            only_folders, line = line.endswith("/"), line.rstrip("/")
            here = "/" in line
            self.rules.append((re.compile(("" if here else "(?:.*/)?") + translate(line.lstrip("/"))), keep, only_folders))

    def says(self, path: str, folder: bool) -> bool | None:
        """True: ignored; False: taken back; None: no pattern fits."""
        return next((not keep for rx, keep, only in reversed(self.rules) if (folder or not only) and rx.fullmatch(path)), None)


def translate(glob: str) -> str:
    """A pattern of an ignore file as a regular expression: * stays in a name, ** crosses folders."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] == "[" and (end := glob.find("]", k + 2)) > 0:
            body = glob[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[k], re.escape(glob[k])), k + 1
    return out


def markdown_files(folder: str) -> list[str]:
    """Sorted paths below folder, beginning with it as given."""
    out: list[str] = []

    def walk(at: Path, above: list[tuple[str, Ignored]]) -> None:
        own = [Ignored((at / f).read_text(errors="replace").splitlines()) for f in IGNORE_FILES if (at / f).is_file()]
        rules = [*above, *(("", x) for x in own)]
        for entry in sorted(os.scandir(at), key=lambda e: e.name):
            if entry.name.startswith("."):
                continue
            is_folder = entry.is_dir(follow_symlinks=False)
            said = next((s for base, x in reversed(rules) if (s := x.says(base + entry.name, is_folder)) is not None), False)
            if said:
                continue
            if is_folder:
                walk(Path(entry.path), [(f"{base}{entry.name}/", x) for base, x in rules])
            elif entry.name.endswith(".md") and entry.is_file():
                out.append(os.path.normpath(entry.path))

    walk(Path(folder), [])
    return sorted(out)
