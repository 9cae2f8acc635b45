"""File names for entities and concepts."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that a bundle keeps, names that some systems keep, and the longest base name.
CONCEPTS = {"index", "log"}
DEVICES = {"con", "prn", "aux", "nul"} | {f"{d}{n}" for d in ("com", "lpt") for n in range(1, 10)}
LONGEST = 200
WORD = 0xFFFFFFFF


def short_hash(text: str) -> str:
    """16 hex digits: two products over the UTF-16 units, each xored with the unit (start and factor 5381, 33 and 52711, 31)."""
    units = text.encode("utf-16-le", "surrogatepass")
    a, b = 5381, 52711
    for lo, hi in zip(units[::2], units[1::2]):
        unit = hi << 8 | lo
        a, b = a * 33 & WORD ^ unit, b * 31 & WORD ^ unit
    return f"{a:08x}{b:08x}"


def file_name(text: str, concept: bool = False) -> str:
    """Letters, digits, ".", "_" and "-" of the compatibility form; a name that had to change gets the hash of the original."""
    name = re.sub(r"[^A-Za-z0-9._-]+", "_", unicodedata.normalize("NFKC", text))
    name = re.sub(r"_+", "_", re.sub(r"^\.+", "_", name))
    name = re.sub(r"^[_-]+|[_-]+\Z", "", name)[:LONGEST] or "entity"
    name = name.rstrip(". ") or "entity"
    if name == text and name.split(".")[0].lower() not in DEVICES:
        return f"{name}-{short_hash(text)}" if concept and name.lower() in CONCEPTS else name
    return f"{name}-{short_hash(text)}"


def file_names(c: Column, concept: bool = False) -> Column:
    """NFKC is not among Spark's functions, so names come from an Arrow UDF; null stays null."""

    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        return pa.array([None if t is None else file_name(t, concept) for t in v.to_pylist()], pa.string())

    return run(c)
