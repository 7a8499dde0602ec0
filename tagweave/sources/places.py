"""File systems of paths as users and Spark's readers write them."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyarrow import fs


def uri(path: str) -> str:
    """A local path, or a path as Spark's reader writes it (nothing escaped), as a URI."""
    local = re.match(r"(?:file:)?/+(?=[^/]|$)", path)
    if local:
        return "file:///" + quote(path[local.end() :])
    return quote(path, safe="/:?#[]@!$&'()*+,;=%")


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path on it."""
    return fs.FileSystem.from_uri(uri(path))
