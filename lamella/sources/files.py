"""Files by URI, wherever Arrow can reach them: local and mounted folders, HDFS, object stores."""

from __future__ import annotations

import uuid
from urllib.parse import urlsplit

_systems: dict[tuple[str, str], tuple] = {}


def opened(uri: str):
    """(file system, path) of a URI or an absolute local path. A worker keeps its connections."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    parts = urlsplit(uri)
    key = parts.scheme, parts.netloc
    if key not in _systems:
        system, path = fs.FileSystem.from_uri(uri)
        _systems[key] = system, len(uri) - len(path)
    system, prefix = _systems[key]
    return system, uri[prefix:]


def put(uri: str, data: bytes) -> None:
    """Writes a file under a temporary name first, so that none is ever half there."""
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    system.move(temporary, path)
