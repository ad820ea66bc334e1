"""Comparison keys that need Unicode tables: tokens, place keys, normalised URLs.

Arrow-batched scalar functions; everything that built-ins can do stays outside.
"""

from __future__ import annotations

import unicodedata
from urllib.parse import urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column

from .batches import each


def word_tokens(text: str | None) -> list[str]:
    """NFKC, lower case, Unicode words; runs of single letters become one token."""
    import regex

    if not text:
        return []
    plain = unicodedata.normalize("NFKC", text).lower()
    words = [w for w in regex.split(r"(?w)\b", plain, flags=regex.V1) if any(c.isalnum() for c in w)]
    out, run = [], ""
    for w in [*words, ""]:
        if len(w) == 1 and w.isalpha():
            run += w
            continue
        if run:
            out.append(run)
            run = ""
        if w:
            out.append(w)
    return out


def plain_place(text: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())


def place_keys(text: str | None) -> list[str]:
    """Lookup keys in order of precedence: umlauts spelt out, marks dropped, as written."""
    if not text or not plain_place(text):
        return []
    spelt = text.lower()
    #: Fixed values.
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        spelt = spelt.replace(a, b)
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return list(dict.fromkeys(k for k in map(plain_place, (spelt, bare, text)) if k))


def normal_url(url: str | None) -> str | None:
    """Scheme and host lower-cased, default port and dot segments gone; null unless http(s) with a host and no user info."""
    if not url:
        return None
    try:
        p = urlsplit(url.strip())
        port = p.port
    except ValueError:
        return None
    host = (p.hostname or "").rstrip(".")
    if p.scheme.lower() not in ("http", "https") or not host or "@" in p.netloc:
        return None
    default = {"http": 80, "https": 443}[p.scheme.lower()]
    kept: list[str] = []
    parts = p.path.split("/")[1:] if p.path.startswith("/") else [p.path]
    for i, s in enumerate(parts):
        last = i + 1 == len(parts)
        if s.lower().replace("%2e", ".") == "..":
            kept = kept[:-1] + [""] * last
        elif s.lower().replace("%2e", ".") == ".":
            kept += [""] * last
        else:
            kept.append(s)
    return urlunsplit((p.scheme.lower(), host + (f":{port}" if port and port != default else ""), "/" + "/".join(kept), p.query, p.fragment))


def tokens(c: Column) -> Column:
    return each(word_tokens, pa.list_(pa.string()), c)


def places(c: Column) -> Column:
    return each(place_keys, pa.list_(pa.string()), c)


def url_key(c: Column) -> Column:
    return each(normal_url, pa.string(), c)
