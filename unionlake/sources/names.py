"""Names of tables, columns and files as the sources spell them."""

from __future__ import annotations

import re
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F


def _percent_decoded(name: Column) -> Column:
    """%xx decoded; a plus sign is itself."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def table_name_from_path(path: Column, encoded: bool = False) -> Column:
    """``.../table_name=<t>/part-*.csv`` -> t; ``.../<t>.csv`` -> t.  Partition
    folders are escaped by their writer; other names only in the URI that
    ``_metadata.file_path`` holds (``encoded``), where a folder's escapes are
    escaped again."""
    folder = _percent_decoded(path) if encoded else path
    part = F.regexp_extract(folder, r"table_name=([^/]+)/[^/]*$", 1)
    stem = F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)
    return F.when(part != "", _percent_decoded(part)).otherwise(_percent_decoded(stem) if encoded else stem)


def glob_escaped(path: str) -> str:
    """A path that readers take as it is, whatever pattern characters it holds."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def url_path(uri: str) -> str:
    """The path that a file URI stands for, with its scheme and host."""
    parts = urlsplit(uri)
    return f"{parts.scheme}://{parts.netloc}{unquote(parts.path)}" if parts.scheme else unquote(uri)


def quoted(name: str) -> str:
    """A column name for ``F.col``: dots and backticks are part of it."""
    return "`" + name.replace("`", "``") + "`"
