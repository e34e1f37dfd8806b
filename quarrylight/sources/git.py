"""Data sources of a repository's history: formats ``git_log`` and ``git_refs``, option root.

The option since (epoch seconds) reaches git, so that older history is not read at all. It is an option and not a pushed
filter because Spark keeps one reader for all queries of a DataFrame, and a bound of one would then hold for the others.
"""

from __future__ import annotations

import subprocess
import tempfile
import threading
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

UNIT = "\x1f"
LOG_SCHEMA = "repo string, sha string, author string, author_name string, ts bigint, subject string, parents array<string>, is_merge boolean, changes array<struct<path:string,added:bigint,deleted:bigint>>"
REF_SCHEMA = "repo string, branch string, sha string, ts bigint, is_current boolean"


def git(root: str, *args: str, timeout: int = 120) -> str:
    """What git prints, or "" if there is no git, no repository or no answer in time."""
    try:
        out = subprocess.run(["git", "-C", root, "-c", "core.quotePath=false", *args], capture_output=True, timeout=timeout, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return ""
    return out.decode("utf-8", "replace")


def pieces(root: str, *args: str, timeout: int = 3600) -> Iterator[str]:
    """What git prints, piece by piece between NULs, while it runs. Raises if it fails or does not end in time: that is no
    answer, and must not be taken for an empty history."""
    with tempfile.TemporaryFile() as said, subprocess.Popen(["git", "-C", root, "-c", "core.quotePath=false", *args], stdout=subprocess.PIPE, stderr=said) as run:
        guard = threading.Timer(timeout, run.kill)
        guard.start()
        try:
            rest = b""
            while block := run.stdout.read(1 << 20):
                *whole, rest = (rest + block).split(b"\0")
                yield from (x.decode("utf-8", "replace") for x in whole)
            yield rest.decode("utf-8", "replace")
        finally:
            guard.cancel()
            run.stdout.close()
        if code := run.wait():
            said.seek(0)
            raise RuntimeError(f"git {args[0]} ended with {code}: {said.read(500).decode('utf-8', 'replace').strip()}")


def cell(text: str) -> int | None:
    return 0 if text == "-" else int(text) if text.isdigit() else None


def parse_log(parts: Iterable[str]) -> Iterator[tuple]:
    """(sha, author, name, ts, subject, parents, is_merge, changes) of each commit of a log with numstat, given in the pieces
    between its NULs."""
    current: list | None = None
    for part in parts:
        for line in part.split("\n"):
            if UNIT in line:
                if current:
                    yield tuple(current)
                sha, name, mail, ts, parents, subject = (line.split(UNIT, 5) + [""] * 6)[:6]
                ancestors = parents.split()
                current = [sha, mail or name, name, int(ts) if ts.isdigit() else 0, subject, ancestors, len(ancestors) > 1, []]
            elif current and line.count("\t") >= 2:
                added, deleted, path = line.split("\t", 2)
                if path and (a := cell(added)) is not None and (b := cell(deleted)) is not None:
                    current[-1].append((path, a, b))
    if current:
        yield tuple(current)


class _LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.repo = options["root"], options.get("repo") or options["root"].rstrip("/").rsplit("/", 1)[-1]
        self.since = int(options.get("since", "0"))

    #: Commits that one task reads; git passes over those before them without looking into their changes.
    COMMITS = 20_000

    def partitions(self) -> list[InputPartition]:
        """One for every COMMITS commits of the window, none if there is no repository or no commit."""
        window = [f"--since=@{self.since}"] if self.since else []
        if not git(self.root, "rev-parse", "-q", "--verify", "HEAD"):
            return [InputPartition(None)]
        n = int("".join(pieces(self.root, "rev-list", "--count", *window, "HEAD")).strip() or 0)
        return [InputPartition(at) for at in range(0, max(n, 1), self.COMMITS)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        window = [f"--since=@{self.since}"] if self.since else []
        form = UNIT.join(("%H", "%an", "%ae", "%at", "%P", "%s"))
        part = [f"--skip={partition.value}", f"--max-count={self.COMMITS}"]
        for row in parse_log(pieces(self.root, "log", *window, *part, "--no-renames", "--numstat", "-z", f"--pretty=format:{form}", "HEAD")):
            yield (self.repo, *row)


class _RefReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.repo = options["root"], options.get("repo") or options["root"].rstrip("/").rsplit("/", 1)[-1]

    def read(self, partition) -> Iterator[tuple]:
        head = git(self.root, "rev-parse", "--abbrev-ref", "HEAD").strip()
        for line in git(self.root, "for-each-ref", "refs/heads", f"--format=%(refname:short){UNIT}%(objectname){UNIT}%(committerdate:unix)").splitlines():
            branch, sha, ts = line.split(UNIT)
            yield self.repo, branch, sha, int(ts), branch == head


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options)


class GitRefs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_refs"

    def schema(self) -> str:
        return REF_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _RefReader(self.options)


def register(spark) -> None:
    """Makes the formats source_tree, git_log and git_refs known to a session."""
    from .tree import SourceTree

    for source in (SourceTree, GitLog, GitRefs):
        spark.dataSource.register(source)
