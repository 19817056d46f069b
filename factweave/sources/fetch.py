"""Fetching pages as a Spark data source, with the policy checks of a safe crawler.

``spark.read.format("pages").option("urls", path)`` fetches in parallel partitions.  Addresses are
resolved first and refused if any is reserved; redirects are followed by hand, each hop checked
again.  The transport is a parameter, so recorded routes serve tests and offline runs.
"""

from __future__ import annotations

import ipaddress
import json
import socket
import threading
from collections.abc import Callable, Iterable
from http.client import HTTPException
from queue import Empty, Queue
from urllib.parse import urljoin, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from factweave.functions.urls import RESERVED_V4, RESERVED_V6

MOST_HOPS, SECONDS, MOST_BYTES = 5, 15, 20_000_000
_NETS = [ipaddress.ip_network(n) for n in [*RESERVED_V4, *RESERVED_V6]]


def is_reserved(address: str) -> bool:
    """Reserved, or no address at all."""
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return True
    every = [ip, getattr(ip, "ipv4_mapped", None)]
    return any(i is not None and i.version == n.version and i in n for i in every for n in _NETS)


class TooLarge(Exception):
    """A body of more than ``MOST_BYTES``."""


def resolve(host: str, seconds: float = SECONDS) -> list[str]:
    """The host's addresses, or an ``OSError`` when a look-up takes longer than ``seconds``; the
    system's own call has no limit, so it runs in a thread that is left behind."""
    found: Queue = Queue()

    def look() -> None:
        try:
            found.put(list(dict.fromkeys(x[4][0] for x in socket.getaddrinfo(host, None))))
        except (OSError, UnicodeError) as e:
            found.put(e)

    threading.Thread(target=look, daemon=True).start()
    try:
        answer = found.get(timeout=seconds)
    except Empty:
        raise TimeoutError(host) from None
    if isinstance(answer, Exception):
        raise answer
    return answer


def http_get(url: str, address: str) -> tuple[int, dict[str, str], bytes]:
    """One request to the address that was checked, without following redirects."""
    import http.client
    import ssl

    parts = urlsplit(url)
    port = parts.port or (443 if parts.scheme == "https" else 80)
    sock = socket.create_connection((address, port), timeout=SECONDS)
    if parts.scheme == "https":
        sock = ssl.create_default_context().wrap_socket(sock, server_hostname=parts.hostname)
    connection = http.client.HTTPConnection(parts.hostname, port, timeout=SECONDS)
    connection.sock = sock
    try:
        connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"Host": parts.netloc, "User-Agent": "factweave"})
        answer = connection.getresponse()
        body = answer.read(MOST_BYTES + 1)
        if len(body) > MOST_BYTES:
            raise TooLarge(url)
        return answer.status, {k.lower(): v for k, v in answer.getheaders()}, body
    finally:
        connection.close()


def safe_fetch(url: str, lookup: Callable = resolve, get: Callable = http_get, kind: str = "text/html", refused: Callable = is_reserved) -> dict:
    """A fetch as a record: requested and final url, status, content type, body, failure (or None).
    Whatever goes wrong is a class of failure; nothing is raised."""
    record = {"requested_url": url, "final_url": url, "status": None, "content_type": None, "body": None, "hops": 0, "failure": None}
    current = url
    for hop in range(MOST_HOPS + 1):
        record |= {"final_url": current, "hops": hop}
        try:
            parts = urlsplit(current)
            host, _ = parts.hostname, parts.port  # a port out of range is an error as well
        except ValueError:
            return record | {"failure": "invalid_url"}
        if parts.scheme not in ("http", "https") or not host:
            return record | {"failure": "invalid_url"}
        try:
            addresses = lookup(host)
        except (OSError, UnicodeError):
            addresses = []
        if not addresses:
            return record | {"failure": "dns_resolution_failed"}
        if any(refused(a) for a in addresses):
            return record | {"failure": "redirect_target_blocked" if hop else "resolved_ip_blocked"}
        try:
            status, headers, body = get(current, addresses[0])
        except TooLarge:
            return record | {"failure": "body_too_large"}
        except (OSError, HTTPException, ValueError):  # bad status lines and bodies cut short included
            return record | {"failure": "unreachable"}
        if 300 <= status < 400 and headers.get("location"):
            try:
                current = urljoin(current, headers["location"])
            except ValueError:
                return record | {"failure": "invalid_url"}
            continue
        content = headers.get("content-type", "")
        record |= {"status": status, "content_type": content, "body": body}
        if not 200 <= status < 300:
            return record | {"failure": "http_error"}
        if kind not in content.lower():
            return record | {"failure": "non_html"}
        if not body.strip():
            return record | {"failure": "empty_body"}
        return record
    return record | {"failure": "too_many_redirects"}


def recorded(routes: dict[str, tuple[int, dict[str, str], bytes]]) -> Callable:
    """A transport over recorded routes; what isn't there can't be reached."""
    def get(url: str, address: str):
        if url not in routes:
            raise ConnectionError(url)
        return routes[url]

    return get


class _Part(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], parts: int, routes: dict | None) -> None:
        self.urls, self.parts, self.routes = urls, parts, routes

    def partitions(self):
        n = max(1, min(self.parts, len(self.urls)))
        return [_Part(self.urls[i::n]) for i in range(n)]

    def read(self, partition) -> Iterable[tuple]:
        extra = {} if self.routes is None else {
            "lookup": lambda host: ["192.0.32.8"], "get": recorded({u: (s, {k.lower(): v for k, v in h.items()}, b.encode()) for u, (s, h, b) in self.routes.items()})
        }
        for url in partition.urls:
            r = safe_fetch(url, **extra)
            yield r["requested_url"], r["final_url"], r["status"], r["content_type"], None if r["body"] is None else r["body"].decode("utf-8", "replace"), r["hops"], r["failure"]


class PageSource(DataSource):
    """Options: ``urls`` (a JSON list), ``parts`` (8), ``routes`` (JSON of recorded answers)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "requested_url string, final_url string, status int, content_type string, body string, hops int, failure string"

    def reader(self, schema) -> DataSourceReader:
        routes = self.options.get("routes")
        urls = list(dict.fromkeys(json.loads(self.options["urls"])))
        return _Reader(urls, int(self.options.get("parts", "8")), json.loads(routes) if routes else None)
