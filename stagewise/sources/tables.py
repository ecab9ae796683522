"""The five funnel tables as one value, plus reading and writing them."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .schemas import SCHEMAS, TABLE_NAMES


@dataclass(frozen=True)
class FunnelTables:
    app_downloads: DataFrame
    signups: DataFrame
    ride_requests: DataFrame
    transactions: DataFrame
    reviews: DataFrame

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    def items(self):
        return [(f.name, getattr(self, f.name)) for f in fields(self)]

    @property
    def ride_parts(self) -> tuple[DataFrame, ...]:
        """Ride facts that are stored with their ``paid`` and ``reviewed`` flags, if any (see ``buckets.py``)."""
        return ()


def conform(df: DataFrame, name: str) -> DataFrame:
    """Derived columns of table ``name`` in schema order and with its types."""
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])


class SchemaError(ValueError):
    """A stored table that lacks a column, or holds one of another type."""


def check_schema(df: DataFrame, name: str) -> DataFrame:
    """Table ``name`` in schema order; raises if a column is missing or has another type.

    Further columns are dropped (pruned at the scan).
    """
    found = {f.name: f.dataType for f in df.schema.fields}
    for want in SCHEMAS[name].fields:
        if want.name not in found:
            raise SchemaError(f"table {name}: column {want.name} is missing")
        if found[want.name] != want.dataType:
            raise SchemaError(
                f"table {name}: column {want.name} is {found[want.name].simpleString()}, not {want.dataType.simpleString()}"
            )
    return df.select(*[f.name for f in SCHEMAS[name].fields])


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path`` as it is stored, or None where nothing is.

    Any other failure (no permission, a store that does not answer, files that
    are not Parquet) is raised: it does not mean that the table is absent.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _present(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    stored = {n: _stored(spark, f"{base}/{n}.parquet") for n in TABLE_NAMES}
    return {n: df for n, df in stored.items() if df is not None}


def has_funnel_tables(spark: SparkSession, base: str) -> bool:
    """Whether ``base`` holds the five tables; raises if it holds only some of them."""
    found = _present(spark, base)
    if found and len(found) < len(TABLE_NAMES):
        raise FileNotFoundError(f"{base} lacks {', '.join(n for n in TABLE_NAMES if n not in found)}")
    return bool(found)


def read_tables(spark: SparkSession, base: str) -> FunnelTables:
    """Read and check ``{base}/{table}.parquet`` for the five tables."""
    found = _present(spark, base)
    missing = [n for n in TABLE_NAMES if n not in found]
    if missing:
        raise FileNotFoundError(f"{base} lacks {', '.join(missing)}")
    return FunnelTables(**{n: check_schema(found[n], n) for n in TABLE_NAMES})


def write_tables(tables: FunnelTables, base: str, mode: str = "overwrite") -> None:
    """Write the five tables as Parquet under ``base``."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{base}/{name}.parquet")


def load_tables(spark: SparkSession, base: str) -> FunnelTables:
    """Funnel tables for a data folder.

    A folder holding the five funnel tables is read directly. A folder of the
    driver's generated tables (customer, orders, lineitem, ...) is turned into
    the five tables by :func:`stagewise.sources.derive.derive_tables`.
    """
    if has_funnel_tables(spark, base):
        return read_tables(spark, base)
    from .derive import derive_tables

    return derive_tables(spark, base)


def materialize_tables(spark: SparkSession, source: str, dest: str | None = None) -> tuple[FunnelTables, str]:
    """Write the funnel tables of ``source`` as Parquet and read them back.

    ``dest`` defaults to a fresh folder under the session's
    ``spark.checkpoint.dir`` (the shared folder a cluster names; without it,
    only a local master has a folder of its own), so later
    jobs read stored tables instead of re-running the derivation, and a lost
    executor costs a re-read rather than a recomputation of the lineage.
    """
    import uuid

    from ..session import ensure_checkpoint_dir

    if dest is None:
        dest = f"{ensure_checkpoint_dir(spark).rstrip('/')}/funnel-tables-{uuid.uuid4().hex[:12]}"
    write_tables(load_tables(spark, source), dest)
    return read_tables(spark, dest), dest
