"""Index definitions, compiled to DataFrames.

A definition names a source table, the column to index and how (its value type), and the expressions of the index
row's qualifier, timestamp and value: a constant, ``{source}.{rowkey}``, ``{source}.cf.q`` for a column's value or
``{source}.cf.q.{timestamp}`` for its time.  Or it names an indexer of one's own: a function from the source DataFrame to
index rows.  Definitions come as objects, as JSON, or as XML ``index-config`` elements.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import STOP_WORDS, terms

Indexer = Callable[[DataFrame], DataFrame]
_indexers: dict[str, Indexer] = {}


def register(name: str) -> Callable[[Indexer], Indexer]:
    """Decorator: an indexer under a name that definitions may use."""

    def keep(f: Indexer) -> Indexer:
        _indexers[name] = f
        return f

    return keep


@dataclass(frozen=True)
class IndexSpec:
    index_table: str
    source_table: str
    source_qualifier: str = ""
    value_type: str = "bytes"
    index_qualifier: str = "{source}.{rowkey}"
    index_timestamp: str = ""
    index_value: str = ""
    indexer: str = ""

    def build(self, source: DataFrame, rowkey: str, ts: str | None = None, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
        """Index rows (key, qual, ts, val) of the source; rows whose key is null have none."""
        if self.indexer:
            if self.indexer not in _indexers:
                raise ValueError(f"no indexer is called {self.indexer!r}")
            return _indexers[self.indexer](source)
        expression = lambda text: _expression(text, rowkey, ts)
        c = F.col(self.source_qualifier)
        if self.value_type == "bytes":
            key = c
        elif self.value_type == "white-spaced-text":  # tabs part the terms, blanks don't
            key = F.explode(F.filter(F.split(F.lower(c), "\t"), lambda t: t != ""))
        elif self.value_type == "full-text":
            key = F.explode(terms(c, stop_words))
        else:
            raise ValueError(f"unknown value type {self.value_type!r}")
        stamp = expression(self.index_timestamp) if self.index_timestamp else (F.col(ts) if ts else F.lit(None).cast("timestamp"))
        value = expression(self.index_value) if self.index_value else F.lit(None).cast("string")
        return source.select(key.alias("key"), expression(self.index_qualifier).alias("qual"), stamp.alias("ts"), value.alias("val")).where("key is not null")


def _expression(text: str, rowkey: str, ts: str | None) -> Column:
    parts = text.split(".")
    if parts[0] != "{source}":
        return F.lit(text)
    if parts[1:] == ["{rowkey}"]:
        return F.col(rowkey)
    if parts[-1] in ("{timestamp}", "ts") and len(parts) == 4:
        if ts is None:
            raise ValueError(f"the source has no time for {text!r}")
        return F.col(ts)
    if len(parts) == 3:
        return F.col(parts[2])
    raise ValueError(f"{text!r} is no expression")


def from_xml(text: str) -> list[IndexSpec]:
    """Definitions from a document of index-config elements."""
    names = {"index-table": "index_table", "source-table": "source_table", "source-qualifier": "source_qualifier", "source-value-type": "value_type", "index-qualifier": "index_qualifier", "index-timestamp": "index_timestamp", "index-value": "index_value", "indexer-class": "indexer"}
    out = []
    for element in ET.fromstring(text).iter("index-config"):
        found = {names[c.tag]: (c.text or "").strip() for c in element if c.tag in names}
        if "source_table" not in found:
            raise ValueError("an index-config without a source table")
        found.setdefault("index_table", found.get("indexer", ""))
        out.append(IndexSpec(**found))
    return out


def from_json(text: str) -> list[IndexSpec]:
    known = {f.name for f in fields(IndexSpec)}
    out = []
    for row in json.loads(text):
        if set(row) - known:
            raise ValueError(f"unknown settings {sorted(set(row) - known)}")
        out.append(IndexSpec(**row))
    return out


def to_json(specs: list[IndexSpec]) -> str:
    return json.dumps([asdict(s) for s in specs])


def build_all(specs: list[IndexSpec], sources: dict[str, DataFrame], rowkeys: dict[str, str], times: dict[str, str] | None = None, only: str | None = None) -> dict[str, DataFrame]:
    """Every index of the definitions (or the one named only), from one source each.  ValueError for a source that isn't there."""
    out: dict[str, DataFrame] = {}
    for spec in specs:
        if only and spec.index_table != only:
            continue
        if spec.source_table not in sources:
            raise ValueError(f"no source is called {spec.source_table!r}")
        rows = spec.build(sources[spec.source_table], rowkeys[spec.source_table], (times or {}).get(spec.source_table))
        out[spec.index_table] = out[spec.index_table].unionByName(rows) if spec.index_table in out else rows
    return out


def save(index: DataFrame, path: str, months: bool = True, files: int | None = None, mode: str = "overwrite") -> None:
    """Write an index: a folder a month, files ranged and sorted by key, so that key and prefix predicates skip row groups.
    Dynamic overwrite replaces only the months that are there."""
    spark = index.sparkSession
    rows = index.withColumn("month", F.date_format("ts", "yyyy-MM")) if months else index
    keys = (["month"] if months else []) + ["key"]
    rows = (rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    writer = rows.write.mode(mode).option("partitionOverwriteMode", spark.conf.get("spark.sql.sources.partitionOverwriteMode"))
    (writer.partitionBy("month") if months else writer).parquet(path)
