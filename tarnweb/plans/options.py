"""Site context and audit options."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class SiteContext:
    """The site under audit, from its start page."""

    origin: str
    hostname: str
    scheme: str
    start_page: str

    @classmethod
    def of(cls, url: str) -> SiteContext:
        m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)", url)
        if not m:
            raise ValueError(f"not an absolute URL: {url!r}")
        scheme, authority = m[1].lower(), m[2].lower()
        host = re.sub(r":[0-9]+$", "", authority.rpartition("@")[2])
        page = url if re.match(r"[^:]+://[^/?#]*[/]", url) else f"{url}/"
        return cls(f"{scheme}://{authority}", host, scheme, page)


@dataclass(frozen=True)
class AuditOptions:
    ignore_robots: bool = False
    banned_strings: tuple[str, ...] = ("drupaldev",)
    ignore_banned: bool = False
    ignore_timer: bool = False
    recursive: bool = True
    disallow: tuple[str, ...] = ()
    selector: str | None = None
    exclude_related_links: bool = True
    max_depth: int | None = None
    #: Seconds after which a crawl ends incomplete, unless ignore_timer is set.
    timeout: float | None = None

    @property
    def deadline(self) -> float | None:
        return None if self.ignore_timer else self.timeout

    @property
    def banned(self) -> tuple[str, ...]:
        return () if self.ignore_banned else self.banned_strings


#: Spellings of the flags after their dash (fixed values); case does not matter.
SPELLINGS = {
    "ignore_robots": ("ignoreRobotsTxt", "ignoreRobots.Txt"),
    "ignore_banned": ("ignoreBannedStr", "ignoreBannedStrs", "ignoreBannedString", "ignoreBannedStrings"),
    "ignore_timer": ("ignoreTimer", "ignoreTimeout"),
    "one_page": ("singlePage", "singlePg", "onePage", "onePg", "1Page", "1Pg"),
    "disallow": ("disallow",),
    "select": tuple(f"{first}{between}{word}" for first in ("", "CSS") for between in ("", "-", "_") for word in ("Select", "Selector", "Selecter")),
}
#: What follows the flags that take a text: blanks before the first quote, if they
#: are passed over, and what may stand between the quotes.
ARGUMENTS = {"disallow": ("", r'[^"\n]+'), "select": (r"\s*", r".+?")}


def _flag(name: str, text: str) -> re.Match | None:
    """The first place of a flag anywhere in the text; group 2 is its argument."""
    words = "|".join(map(re.escape, SPELLINGS[name]))
    blanks, inside = ARGUMENTS.get(name, ("", ""))
    after = rf"{blanks}([\"'`])({inside})\1" if inside else r"\b"
    return re.search(rf"-(?:{words}){after}", text, re.I)


def parse_flags(text: str, **defaults) -> AuditOptions:
    """Options from a flag text; an unsupported selector raises."""
    found = {name: _flag(name, text) for name in SPELLINGS}
    options = dict(defaults)
    for name in ("ignore_robots", "ignore_banned", "ignore_timer"):
        if found[name]:
            options[name] = True
    if found["one_page"]:
        options["recursive"] = False
    if found["disallow"]:
        options["disallow"] = tuple(re.split(r"\s*,\s*", found["disallow"][2]))
    if found["select"]:
        from ..operators.selectors import compile_selector

        compile_selector(found["select"][2])
        options["selector"] = found["select"][2]
    return AuditOptions(**options)
