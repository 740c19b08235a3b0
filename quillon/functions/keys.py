"""Keys of memes and places, and hosts of addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def geo_cell(lon: Column, lat: Column) -> Column:
    """``lon_lat`` in hundredths of a degree, truncated toward zero, from single precision as it is read."""
    x, y = cell_index(lon), cell_index(lat)
    return F.concat_ws("_", x.cast("string"), y.cast("string"))


def cell_index(degrees: Column) -> Column:
    return (degrees.cast("float").cast("double") * 100).cast("int")


def hashtag(tag: Column) -> Column:
    return F.concat(F.lit("#"), F.lower(tag))


def mention(user_id: Column) -> Column:
    """The key of a mention is the user's id alone; names change."""
    return F.concat(F.lit("@"), user_id.cast("string"))


def kind(key: Column) -> Column:
    """hashtag, mention or url, by the key's beginning."""
    return F.when(key.startswith("#"), "hashtag").when(key.startswith("@"), "mention").otherwise("url")


def host(url: Column) -> Column:
    """Null for an address that can't be parsed."""
    return F.try_parse_url(url, F.lit("HOST"))


def prefix_range(prefix: str) -> tuple[str, str | None]:
    """[first, stop) of the keys with a prefix; no stop where none can be named."""
    for i in range(len(prefix) - 1, -1, -1):
        if ord(prefix[i]) < 0x10FFFF:
            after = ord(prefix[i]) + 1
            return prefix, prefix[:i] + chr(0xE000 if 0xD800 <= after < 0xE000 else after)
    return prefix, None


def expand_hosts(text: str, digits: int = 3) -> list[str]:
    """Names from a list such as ``a-[1,3-5],b``."""
    out = []
    for name, numbers, plain in re.findall(r"([^,\[\]]+)\[([^\]]*)\]|([^,\[\]]+)", text):
        if plain:
            out.append(plain.strip())
            continue
        for part in numbers.split(","):
            first, _, last = part.partition("-")
            lo, hi = int(first), int(last or first)
            if lo > hi:
                raise ValueError(f"{part!r} is no range")
            out += [f"{name.strip()}{i:0{digits}}" for i in range(lo, hi + 1)]
    return out
