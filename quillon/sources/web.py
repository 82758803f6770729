"""Plain downloads and listings, outside Spark; what opens connections is passed in."""

from __future__ import annotations

import email.utils
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

# Answers after which a download is tried again, and how long to wait at most when told to.
AGAIN = (429, 500, 502, 503, 504)
LONGEST_WAIT = 900
WAITS = (30, 60, 120, 240, 300)
CHUNK = 1 << 20


class Listing(Protocol):
    """Pages of a category itself, of the main namespace, at most limit of them."""

    def articles(self, category: str, limit: int) -> Iterable[tuple[int, str]]: ...


class Paced:
    """A listing that is asked at most once an interval, and not at all for no pages."""

    def __init__(self, listing: Listing, interval: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if interval < 1:
            raise ValueError("requests have to be a second apart at least")
        self.listing, self.interval, self.clock, self.sleep, self.due = listing, interval, clock, sleep, 0.0

    def articles(self, category: str, limit: int) -> list[tuple[int, str]]:
        if limit <= 0:
            return []
        if (wait := self.due - self.clock()) > 0:
            self.sleep(wait)
        self.due = self.clock() + self.interval
        return [page for _, page in zip(range(limit), self.listing.articles(category, limit), strict=False)]


def agent(contact: str) -> str:
    """How a download names itself; ValueError where nobody can be reached."""
    contact = contact.strip()
    if "@" not in contact and not contact.startswith(("http://", "https://")):
        raise ValueError("contact must be an e-mail address or an address of the web")
    return f"quillon/1 ({contact})"


@dataclass(frozen=True)
class Download:
    path: Path
    size: int
    resumed: bool


class Broken(OSError):
    """A connection that ended early, or an answer that does not continue what is there."""


def _wait(error: Exception, usual: float, now: Callable[[], float]) -> float:
    said = error.headers.get("Retry-After") if isinstance(error, urllib.error.HTTPError) else None
    if not said:
        return usual
    seconds = float(said) if said.isdigit() else email.utils.parsedate_to_datetime(said).timestamp() - now()
    return min(max(seconds, 0), LONGEST_WAIT)


def _part(answer, part: Path, offset: int, rate: int | None, sleep: Callable[[float], None]) -> None:
    """Append an answer to what is there; it has to begin where that ends and be as long as it says."""
    span = answer.headers.get("Content-Range") or ""
    if offset and (getattr(answer, "status", 200) != 206 or not span.startswith(f"bytes {offset}-")):
        raise Broken("the answer does not go on where the download stopped")
    size, began = 0, time.monotonic()
    with part.open("ab") as out:
        while block := answer.read(CHUNK):
            out.write(block)
            size += len(block)
            if rate and (ahead := size / rate - (time.monotonic() - began)) > 0:
                sleep(ahead)
    said = answer.headers.get("Content-Length")
    if said is not None and int(said) != size:
        raise Broken(f"the answer ended after {size} of {said} bytes")


def download(url: str, target: Path, contact: str, open_: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep, waits: tuple[float, ...] = WAITS, rate: int | None = 16 << 20, now: Callable[[], float] = time.time) -> Download:
    """url at target, over one connection; goes on where an earlier try stopped, and leaves a whole file alone."""
    name = agent(contact)
    if target.name != url.rsplit("/", 1)[-1]:
        raise ValueError(f"{target} is not named as {url}")
    if target.exists():
        return Download(target, target.stat().st_size, False)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    resumed = part.exists() and part.stat().st_size > 0
    for wait in (*waits, None):
        offset = part.stat().st_size if part.exists() else 0
        asked = urllib.request.Request(url, headers={"User-Agent": name, "Accept-Encoding": "identity"} | ({"Range": f"bytes={offset}-"} if offset else {}))
        try:
            with open_(asked, timeout=120) as answer:
                _part(answer, part, offset, rate, sleep)
            part.replace(target)
            return Download(target, target.stat().st_size, resumed)
        except (urllib.error.URLError, Broken, ConnectionError, TimeoutError) as error:
            if wait is None or (isinstance(error, urllib.error.HTTPError) and error.code not in AGAIN):
                raise
            resumed = True
            sleep(_wait(error, wait, now))
    raise AssertionError
