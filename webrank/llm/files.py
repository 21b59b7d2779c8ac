"""Files in the shared folder, opened by URI on executors: local, object-store and HDFS paths alike."""

from __future__ import annotations

from pyarrow import fs


def where(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Output:
    """A file that appears under its name only when it is complete, so a lost or repeated task leaves none in parts."""

    def __init__(self, uri: str, attempt: int):
        self.fs, self.path = where(uri)
        self.temp = f"{self.path}.attempt-{attempt}"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream = self.fs.open_output_stream(self.temp)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.temp, self.path)
