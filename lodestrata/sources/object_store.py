"""Where a vault lives: any folder that Hadoop file systems open, among them s3://bucket/prefix."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import SparkSession


class NotFound(FileNotFoundError):
    """The vault, or an object in it, does not exist."""


def location(path: str) -> str:
    """A local path as it is, an s3 URL as Hadoop's s3a; an s3 URL without a bucket is an error."""
    if not path.startswith("s3://"):
        return path.rstrip("/") if len(path) > 1 else path
    url = urlparse(path)
    if not url.netloc:
        raise ValueError(f"no bucket in {path!r}")
    return f"s3a://{url.netloc}{url.path.rstrip('/')}"


def s3_settings(endpoint: str | None = None, region: str | None = None) -> dict[str, str]:
    """Hadoop settings for an endpoint and a region; by default those of the environment, then the public ones."""
    endpoint = endpoint or os.environ.get("AWS_ENDPOINT_URL") or "https://s3.amazonaws.com"
    region = region or os.environ.get("AWS_REGION") or "us-east-1"
    return {
        "fs.s3a.endpoint": endpoint,
        "fs.s3a.endpoint.region": region,
        "fs.s3a.path.style.access": str("amazonaws.com" not in endpoint).lower(),
        "fs.s3a.aws.credentials.provider": "software.amazon.awssdk.auth.credentials.EnvironmentVariableCredentialsProvider,software.amazon.awssdk.auth.credentials.ProfileCredentialsProvider",
    }


class Folder:
    """Small objects of a vault, read and written by the driver."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root, self._jvm = location(root), spark._jvm
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._gateway, self._conf = spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def at(self, key: str) -> str:
        return f"{self.root}/{key}"

    def exists(self, key: str = "") -> bool:
        return self._fs.exists(self._path(self.at(key) if key else self.root))

    def bucket_exists(self) -> bool:
        """Whether the bucket of an s3 location is there; a vault never makes one. True for other file systems."""
        url = urlparse(self.root)
        return url.scheme != "s3a" or self._fs.exists(self._path(f"s3a://{url.netloc}/"))

    def make(self, key: str = "") -> None:
        self._fs.mkdirs(self._path(self.at(key) if key else self.root))

    def get(self, key: str) -> bytes:
        if not self.exists(key):
            raise NotFound(self.at(key))
        stream = self._fs.open(self._path(self.at(key)))
        try:
            return bytes(self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream))
        finally:
            stream.close()

    def put(self, key: str, data: bytes) -> None:
        """Write beside the place and rename, so that a reader sees the old object or the new one."""
        beside = self._path(self.at(f"{key}.tmp"))
        stream = self._fs.create(beside, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        over = self._gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(beside.toUri() if beside.toUri().getScheme() else self._fs.getUri(), self._conf).rename(beside, self._path(self.at(key)), over)

    def drop(self, key: str) -> None:
        """Delete a folder and all below it, if it is there."""
        self._fs.delete(self._path(self.at(key)), True)

    def names(self, key: str) -> list[str]:
        """Names directly below a folder, sorted, without unfinished ones; none if the folder is absent."""
        if not self.exists(key):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(self.at(key)))) if not n.endswith(".tmp"))
