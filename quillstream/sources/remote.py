"""Python Data Sources for remote document trees and message queues.

A fetcher is any object with list() and read(path). FTP comes with the standard library; others plug in by a factory
named as module:function. One partition reads one slice of the listing.
"""

from __future__ import annotations

import importlib
import io
import ipaddress
import json
import socket
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "uri string, name string, rel_path string, content binary"


class FtpFetcher:
    def __init__(self, host: str, user: str = "anonymous", password: str = "", root: str = "/", port: int = 21):
        from ftplib import FTP

        self.ftp = FTP()  # noqa: S321
        self.ftp.connect(host, port, timeout=30)
        self.ftp.login(user, password)
        self.root = root.rstrip("/")

    def list(self) -> list[str]:
        out, stack = [], [self.root or "/"]
        while stack:
            folder = stack.pop()
            for name, facts in self.ftp.mlsd(folder):
                if facts["type"] == "dir":
                    stack.append(f"{folder}/{name}")
                elif facts["type"] == "file":
                    out.append(f"{folder}/{name}")
        return sorted(out)

    def read(self, path: str) -> bytes:
        held = io.BytesIO()
        self.ftp.retrbinary(f"RETR {path}", held.write)
        return held.getvalue()


def make_fetcher(options: dict):
    kind = options.get("kind", "ftp")
    args = {k: v for k, v in options.items() if k in ("host", "user", "password", "root")}
    if kind == "ftp":
        return FtpFetcher(**args, port=int(options.get("port", 21)))
    module, _, name = kind.partition(":")
    return getattr(importlib.import_module(module), name)(options)


class Slice(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class RemoteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        paths = make_fetcher(self.options).list()
        n = int(self.options.get("filesperpartition", 64))
        return [Slice(paths[i : i + n]) for i in range(0, len(paths), n)] or [Slice([])]

    def read(self, partition: Slice) -> Iterator[tuple]:
        root = self.options.get("root", "/").rstrip("/")
        if partition.paths:
            f = make_fetcher(self.options)
            for p in partition.paths:
                yield (p, p.rsplit("/", 1)[-1], p.removeprefix(root).lstrip("/"), f.read(p))


class RemoteDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RemoteReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RemoteDocuments)


# Fetching by URL

URL_BYTES = 64 << 20


def is_blocked_address(address: str) -> bool:
    """Addresses that a fetch must not reach: private, loopback, link-local, reserved, multicast, and their mapped forms."""
    ip = ipaddress.ip_address(address)
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified


def check_url(url: str, allowed_hosts: frozenset[str] | None = None) -> str:
    """The URL if its scheme is http or https and its host is allowed and resolves to no blocked address."""
    u = urlsplit(url)
    if u.scheme not in ("http", "https") or not u.hostname:
        raise ValueError(f"not fetched: {url}")
    if allowed_hosts is not None and u.hostname not in allowed_hosts:
        raise ValueError(f"host not allowed: {u.hostname}")
    for *_, (address, *_rest) in socket.getaddrinfo(u.hostname, u.port or (443 if u.scheme == "https" else 80)):
        if is_blocked_address(address):
            raise ValueError(f"address not allowed: {address}")
    return url


# Queue payloads


def encode_ref(uri: str, name: str, rel_path: str) -> bytes:
    return json.dumps({"uri": uri, "name": name, "rel_path": rel_path}).encode()


def decode_ref(payload: bytes) -> dict:
    return json.loads(payload)
