"""A data source that writes a Markdown file for each page, ``<path>/<host>/<page>.md``, all of them or none.

Tasks write below a folder beside the target, each file under its page's name by way of a part file that is
renamed, so a task that runs again writes the same files again and leaves no other.  Committing renames that one folder; a job
that fails deletes it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Bytes of a name in a path; longer ones are cut and told apart by a digest.
LONGEST = 200


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def safe_name(name: str) -> str:
    """A name that stays in its folder and that file systems take."""
    raw = name.replace("\0", "_").encode()
    if name in ("", ".", ".."):
        return "_"
    return name if len(raw) <= LONGEST else raw[: LONGEST - 36].decode("utf-8", "ignore") + "-" + hashlib.md5(raw).hexdigest() + (".md" if name.endswith(".md") else "")


@dataclass
class Written(WriterCommitMessage):
    files: int


class MarkdownWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.aside = f"{self.path}.writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = opened(self.aside)
        made, count, mine = set(), 0, uuid.uuid4().hex
        for row in iterator:
            *folders, name = (safe_name(x) for x in row.file.split("/"))
            folder = "/".join([root, *folders])
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            part = f"{folder}/.{mine}"
            with files.open_output_stream(part) as out:
                out.write((row.markdown or "").encode("utf-8", "replace"))
            files.move(part, f"{folder}/{name}")
            count += 1
        return Written(count)

    def commit(self, messages: list) -> None:
        files, target = opened(self.path)
        _, aside = opened(self.aside)
        files.create_dir(aside, recursive=True)  # where there are no pages
        old = f"{target}.old-{uuid.uuid4().hex}"
        exists = files.get_file_info(target).type != fs.FileType.NotFound
        if exists and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        if exists:
            files.move(target, old)
        files.move(aside, target)
        if exists:
            files.delete_dir(old)

    def abort(self, messages: list) -> None:
        files, aside = opened(self.aside)
        if files.get_file_info(aside).type != fs.FileType.NotFound:
            files.delete_dir(aside)


class MarkdownPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown_pages"

    def schema(self) -> str:
        return "file string, markdown string"

    def writer(self, schema, overwrite: bool) -> MarkdownWriter:
        return MarkdownWriter(self.options["path"], overwrite)
