"""Executable headers: entry point and sections of objects that start with MZ."""

from __future__ import annotations

import struct
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SECTIONS = 96
SCHEMA = "struct<ep_off:bigint,sections:array<struct<raw_ptr:bigint,raw_size:bigint,va:bigint,vsize:bigint,md5:string,sha256:string,size:bigint>>>"


class Section(NamedTuple):
    raw_ptr: int
    raw_size: int
    va: int
    vsize: int


class Image(NamedTuple):
    ep_off: int
    sections: list[Section]


def parse(data: bytes) -> Image | None:
    """The image's headers, or None if it is no such file. A cut section table ends the list."""
    if len(data) < 0x40 or data[:2] != b"MZ":
        return None
    (at,) = struct.unpack_from("<I", data, 0x3C)
    if at + 24 > len(data) or data[at : at + 4] != b"PE\0\0":
        return None
    count, size_of_options = struct.unpack_from("<2xH12xH", data, at + 4)
    options = at + 24
    if options + 20 > len(data) or struct.unpack_from("<H", data, options)[0] not in (0x10B, 0x20B):
        return None
    (entry,) = struct.unpack_from("<I", data, options + 16)
    table = options + size_of_options
    room = max(0, len(data) - table) // 40
    sections = []
    for i in range(min(count, MAX_SECTIONS, room)):
        vsize, va, raw_size, raw_ptr = struct.unpack_from("<8x4I", data, table + 40 * i)
        sections.append(Section(raw_ptr, raw_size, va, vsize))
    home = next((s for s in sections if s.va <= entry < s.va + max(s.vsize, s.raw_size)), None)
    return Image(entry if home is None else home.raw_ptr + entry - home.va, sections)


def describe(data: bytes | None) -> dict | None:
    """parse() with digests of each section's bytes, clipped to the object; null digests for an empty section."""
    import hashlib

    image = parse(bytes(data)) if data is not None else None
    if image is None:
        return None
    sections = []
    for s in image.sections:
        body = data[s.raw_ptr : s.raw_ptr + s.raw_size]
        more = {"md5": hashlib.md5(body).hexdigest(), "sha256": hashlib.sha256(body).hexdigest()} if body else {"md5": None, "sha256": None}
        sections.append(s._asdict() | more | {"size": len(body)})
    return {"ep_off": image.ep_off, "sections": sections}


def _describe(content: pd.Series) -> pd.DataFrame:
    rows = [describe(x) or {"ep_off": None, "sections": None} for x in content]
    return pd.DataFrame(rows, columns=["ep_off", "sections"])


def pe_info(content: Column) -> Column:
    """Struct of ep_off and sections; both null where the object is no such file."""
    return F.pandas_udf(_describe, SCHEMA)(content)
