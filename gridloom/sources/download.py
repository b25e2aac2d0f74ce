"""Cached downloads with retries; the only part that touches a network, and never in a query."""

from __future__ import annotations

import json
import math
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

#: Status codes worth another try, those that only artifact downloads try again, and seconds before each new try.
AGAIN, ARTIFACT_AGAIN, WAITS = frozenset({408, 429, *range(500, 600)}), frozenset({400, 404}), (2, 4, 8, 16)
CHUNK = 1 << 20


def with_retries(call: Callable[[], bytes], *, artifact: bool = False, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """Call again after transient HTTP errors, waiting longer each time; other errors rise at once."""
    for wait in (*WAITS, None):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if wait is None or e.code not in (AGAIN | ARTIFACT_AGAIN if artifact else AGAIN):
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):  # the last two also while a body is read
            if wait is None:
                raise
        sleep(wait)
    raise AssertionError


def download(url: str, destination: str, *, opener: Callable = urllib.request.urlopen) -> bool:
    """Download in chunks to a ``.part`` file, then rename; False if the destination is there already."""
    if os.path.exists(destination):
        return False
    part = f"{destination}.part"
    try:
        with opener(url) as r, open(part, "wb") as f:
            while block := r.read(CHUNK):
                f.write(block)
        os.replace(part, destination)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return True


def parse_service(body: bytes) -> dict:
    """A service's JSON; an ``error`` in it raises although the status was fine."""
    record = json.loads(body)
    if "error" in record:
        raise ValueError(f"the service answered {record['error']}")
    return record


def request_json(url: str, parameters: dict | None = None, *, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A service's answer to a query, with retries; an error it reports itself is no transient one."""
    full = f"{url}?{urllib.parse.urlencode(parameters)}" if parameters else url

    def call() -> bytes:
        with opener(full) as r:
            return r.read()

    return parse_service(with_retries(call, sleep=sleep))


def image_request(origin: tuple[float, float], pixel: float, bounds: tuple[float, float, float, float], *, halo: int = 1, srid: int = 5070) -> dict[str, str]:
    """Parameters of an image export on the service's own lattice: the bounds grow outward to whole native pixels and ``halo`` more, and no renderer changes the values."""
    (x, y), (x0, y0, x1, y1) = origin, bounds
    c0, c1 = math.floor((x0 - x) / pixel) - halo, math.ceil((x1 - x) / pixel) + halo
    r0, r1 = math.floor((y - y1) / pixel) - halo, math.ceil((y - y0) / pixel) + halo
    box = (x + c0 * pixel, y - r1 * pixel, x + c1 * pixel, y - r0 * pixel)
    return {
        "bbox": ",".join(map(repr, box)), "size": f"{c1 - c0},{r1 - r0}", "bboxSR": str(srid), "imageSR": str(srid), "format": "tiff", "interpolation": "RSP_NearestNeighbor",
        "renderingRule": json.dumps({"rasterFunction": "None"}), "f": "json",
    }
