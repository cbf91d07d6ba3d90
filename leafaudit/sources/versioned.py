"""Tables that change by whole versions.

Data files are written to folders that no reader knows, and a small pointer file then
names the folders of the new version. A pointer is moved to its final, numbered name in
one step and never changes, so a writer that dies leaves the last version in place, and of
two writers that began from the same version one fails (Conflict) and starts over."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer has published the version this one was about to."""


@dataclass(frozen=True)
class Version:
    """One version: its number, row type and data folders by part; the epoch of its writer and
    its rows (snapshots), or into how many buckets its keys are hashed (indexes)."""

    number: int
    schema: str
    parts: dict[str, str] = field(default_factory=dict)
    epoch: int | None = None
    rows: int | None = None
    buckets: int | None = None


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    target, fs = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def _pointers(path: str) -> str:
    return f"{path.rstrip('/')}/_pointers"


def new_folder(path: str) -> str:
    return f"{path.rstrip('/')}/data/{uuid.uuid4().hex}"


def current(spark: SparkSession, path: str) -> Version | None:
    """The last published version, None before the first."""
    found = [n for n in _names(spark, _pointers(path)) if n.isdigit()]
    if not found:
        return None
    text = spark.read.text(f"{_pointers(path)}/{found[-1]}", wholetext=True).first()[0]
    return Version(**json.loads(text))


def publish(spark: SparkSession, path: str, version: Version) -> None:
    """Make a version the current one; Conflict if its number is taken."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    draft, fs = _hadoop(spark, f"{_pointers(path)}/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(version.__dict__).encode()))
    out.close()
    final, _ = _hadoop(spark, f"{_pointers(path)}/{version.number:020d}")
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, final, no_options)
    except Exception as exc:
        fs.delete(draft, False)
        if fs.exists(final):
            raise Conflict(f"version {version.number} of {path} is already published") from exc
        raise


def read_parts(spark: SparkSession, version: Version, parts: list[str] | None = None) -> DataFrame:
    """Rows of a version, or of some of its parts only."""
    schema = T.StructType.fromJson(json.loads(version.schema))
    folders = [folder for part, folder in version.parts.items() if parts is None or part in parts]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    version = current(spark, path)
    return None if version is None else read_parts(spark, version)


def drop_old(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete data folders that none of the last `keep` versions names, and older pointers.

    Not to be run beside a writer, whose folder no version names yet."""
    names = [n for n in _names(spark, _pointers(path)) if n.isdigit()]
    used = set()
    for name in names[-keep:]:
        version = Version(**json.loads(spark.read.text(f"{_pointers(path)}/{name}", wholetext=True).first()[0]))
        used |= {folder.split("/data/")[1].split("/")[0] for folder in version.parts.values()}
    old = [n for n in _names(spark, f"{path.rstrip('/')}/data") if n not in used]
    drop_folders(spark, [f"{path.rstrip('/')}/data/{n}" for n in old] + [f"{_pointers(path)}/{n}" for n in names[:-keep]])
    return len(old)


def drop_folders(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        target, fs = _hadoop(spark, folder)
        fs.delete(target, True)


def bucket_of(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def written_parts(spark: SparkSession, folder: str, column: str) -> dict[str, str]:
    """Part folders that a partitioned write left in a folder."""
    prefix = f"{column}="
    return {n.removeprefix(prefix): f"{folder}/{n}" for n in _names(spark, folder) if n.startswith(prefix)}
