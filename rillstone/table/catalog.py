"""A catalogue of tables in folders: namespaces, listing, loading, creation, removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .log import Table


class Catalog:
    """Tables under ``root``/namespace/name; loaded tables are kept, their metadata is always read anew."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.loaded = spark, root.rstrip("/"), {}

    def path(self, ident: str) -> str:
        """Folder of a table such as ``shop.public.users``."""
        if "." not in ident:
            raise ValueError(f"a table needs a namespace: {ident!r}")
        return f"{self.root}/{ident.replace('.', '/')}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, ident: str) -> bool:
        fs, p = self._fs(f"{self.path(ident)}/metadata")
        return fs.exists(p)

    def create_namespace(self, namespace: str) -> None:
        """Make a namespace; one that exists stays."""
        fs, p = self._fs(f"{self.root}/{namespace.replace('.', '/')}")
        fs.mkdirs(p)

    def create(self, ident: str, schema: T.StructType, keys: list[str], spec: list[str] | None = None, properties: dict[str, str] | None = None) -> Table:
        self.create_namespace(ident.rpartition(".")[0])
        self.loaded[ident] = Table.create(self.spark, self.path(ident), schema, keys, spec, properties)
        return self.loaded[ident]

    def load(self, ident: str) -> Table:
        if ident not in self.loaded:
            if not self.exists(ident):
                raise FileNotFoundError(ident)
            self.loaded[ident] = Table(self.spark, self.path(ident))
        return self.loaded[ident]

    def tables(self, namespace: str) -> list[str]:
        """Tables directly in a namespace."""
        fs, p = self._fs(f"{self.root}/{namespace.replace('.', '/')}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        return sorted(f"{namespace}.{n}" for n in names if self.exists(f"{namespace}.{n}"))

    def drop(self, ident: str) -> None:
        """Remove a table with all its files."""
        fs, p = self._fs(self.path(ident))
        fs.delete(p, True)
        self.loaded.pop(ident, None)

    def view(self, ident: str, name: str | None = None, **at) -> DataFrame:
        """The table as a temporary view for SQL, at a snapshot, tag or time if one is given."""
        df = self.load(ident).read(**at)
        df.createOrReplaceTempView(name or ident.replace(".", "_"))
        return df
