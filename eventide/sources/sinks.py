"""Writing and reading back: partitioned shards, CSV, DDL schemas, reports, destination guard."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_shards(df: DataFrame, path: str, partition: str, order: Sequence[str], files: int = 1) -> None:
    """One folder per partition value, rows sorted within files; ``files`` spreads a large partition over as many files by a hash of the first sort key."""
    spread = F.pmod(F.xxhash64(order[0]), F.lit(files))
    df.repartition(F.col(partition), spread).sortWithinPartitions(partition, *order).write.mode("overwrite").partitionBy(partition).parquet(path)


def read_shard(spark: SparkSession, path: str, partition: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Columns of one partition; only its files are listed and only these columns read."""
    return spark.read.parquet(path).where(F.col(partition) == value).select(*columns)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a declared schema; bad rows are an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


_DDL_TYPES = {"varchar": "string", "char": "string", "text": "string", "datetime": "timestamp", "timestamp": "timestamp", "date": "date", "float": "float", "double": "double", "decimal": "double", "int": "int", "integer": "int", "bigint": "bigint", "boolean": "boolean", "bool": "boolean"}


def ddl_schemas(text: str) -> dict[str, T.StructType]:
    """Spark schemas of the CREATE TABLE statements of a DDL text."""
    out = {}
    for name, body in re.findall(r"create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"]?(\w+)[`\"]?\s*\((.*?)\)\s*;", text, re.I | re.S):
        fields = []
        for line in re.split(r",(?![^(]*\))", body):
            m = re.match(r"\s*[`\"]?(\w+)[`\"]?\s+(\w+)", line)
            if m and m[2].lower() in _DDL_TYPES and m[1].lower() not in ("primary", "foreign", "key", "constraint"):
                fields.append(T.StructField(m[1], T._parse_datatype_string(_DDL_TYPES[m[2].lower()])))
        out[name.lower()] = T.StructType(fields)
    return out


def guard_destination(path: str, classification: str, allowed: Mapping[str, Sequence[str]]) -> str:
    """``path`` if its class of content may be written under it, else an error."""
    full = str(Path(path).resolve())
    if not any(full == str(Path(root).resolve()) or full.startswith(str(Path(root).resolve()) + "/") for root in allowed.get(classification, ())):
        raise PermissionError(f"{classification} data may not be written to {path}")
    return path


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def json_sha256(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def write_report(report: Mapping, path: str, identifiers: Sequence[str] = ()) -> str:
    """Aggregate report as JSON; refuses texts that hold one of the identifiers."""
    text = canonical_json(report)
    found = [i for i in identifiers if i and i in text]
    if found:
        raise ValueError(f"report holds {len(found)} identifiers")
    Path(path).write_text(text)
    return json_sha256(report)


def binding(**hashes: str) -> Column:
    """Struct of content hashes that rows carry."""
    return F.struct(*[F.lit(v).alias(k) for k, v in sorted(hashes.items())])


def check_binding(df: DataFrame, column: str, **hashes: str) -> DataFrame:
    """``df`` if all its rows carry exactly these hashes, else an error."""
    seen = [r[0].asDict() for r in df.select(column).distinct().limit(2).collect()]
    if seen and seen != [dict(sorted(hashes.items()))]:
        raise ValueError("rows are bound to other artifacts")
    return df
