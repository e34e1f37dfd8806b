"""A data source of the files of source trees: spark.read.format("source_tree").option("root", ..).load().

One partition for each ``files_per_partition`` files; executors read the bytes. The folder must be one that executors
share. Names that begin with a dot or an underscore are files like others. Rules that cost least are applied first:
names before sizes, sizes before opening a file.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import DEFAULTS
from ..operators.paths import BINARY_EXTENSIONS, glob_regex

SCHEMA = "repo string, rel string, size bigint, text string, excluded string"


def covers(pattern: str, rel: str) -> bool:
    """The same test as operators.paths.path_matches, for one path."""
    if pattern.startswith("!"):
        return False
    inner = glob_regex(pattern.strip("/"))[1:-1]
    below = "/" if pattern.endswith("/") else "(?:/|$)"
    return re.search(("^" if "/" in pattern.strip("/") else "(?:^|/)") + inner + below, rel) is not None


def listed(root: str) -> list[str]:
    """The paths that git tracks or would track, else all files below root, in order."""
    if os.path.isdir(os.path.join(root, ".git")):
        try:
            out = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, timeout=60, check=True).stdout
            return sorted({x for x in out.decode("utf-8", "replace").split("\0") if x})
        except (OSError, subprocess.SubprocessError):
            pass  # without git the folder itself is walked
    found = []
    for top, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d != ".git")
        found += [os.path.relpath(os.path.join(top, n), root).replace(os.sep, "/") for n in names]
    return sorted(found)


class _Part(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["root"].rstrip("/")
        self.exclude = [x for x in options.get("exclude", "").split("\n") if x]
        self.include = [x for x in options.get("include", "").split("\n") if x]
        self.most = int(options.get("max_file_bytes", DEFAULTS["max_file_bytes"]))
        self.repo = options.get("repo") or os.path.basename(self.root)
        self.step = int(options.get("files_per_partition", "500"))

    def partitions(self) -> list[_Part]:
        kept = []
        for rel in listed(self.root):
            hit = [p for p in self.include if covers(p.lstrip("!"), rel)]
            if self.include and (not hit or hit[-1].startswith("!")):
                continue
            kept.append((rel, next((p for p in self.exclude if covers(p, rel)), "")))
        return [_Part(kept[i : i + self.step]) for i in range(0, len(kept), self.step)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for rel, reason in partition.files:
            path = os.path.join(self.root, rel)
            try:
                size = os.stat(path).st_size
            except OSError:
                continue
            text = ""
            if not reason and size > self.most:
                reason = "oversized"
            if not reason:
                data = b""
                if os.path.splitext(rel)[1].lower() in BINARY_EXTENSIONS:
                    reason = "binary"
                else:
                    try:
                        with open(path, "rb") as f:
                            data = f.read()
                    except OSError:
                        reason = "binary"
                    if b"\0" in data[:8192]:
                        reason = "binary"
                if not reason:
                    text = data.decode("utf-8", "replace")
            yield self.repo, rel, size, text, reason or None


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
