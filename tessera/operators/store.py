"""Versioned tables on a shared folder: upsert, prune, both in one swap, with work in proportion to what changes.

A table's base is split by a hash of its key into parts, each a folder of Parquet. A load adds a delta, one folder with
the new rows and the keys of those that are gone; readers take a key's row from the last delta that has it, and the
base's rows of other keys (a delta is small beside the base, so Spark broadcasts its keys). Deltas are merged by sizes:
when FAN neighbours are of one magnitude, the newest takes the others in, and when all deltas together are a quarter of
the base, they go into those parts of the base that they touch. So a row is written again some log4(rows) times.

A version is a list: which version wrote each part of the base, and the deltas in order with the parts that they
concern, by which a reader of some parts skips the others. A writer claims the number after the last commit by making a
file, which only one can, writes its files and the list and then makes its commit, so readers see the old rows or all of
the new ones and no writer's rows are lost. All files are reached through Hadoop's file systems, so the folder can be on
any of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Collection, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.shared import kept
from tessera.schemas import Table, violations

PARTS = 16
FAN = 4


@dataclass
class Delta:
    """Rows of one folder: how many, and of which parts."""

    version: int
    rows: int
    parts: list[int]

    @property
    def magnitude(self) -> int:
        return (max(self.rows, 1).bit_length() - 1) // 2


@dataclass
class Layout:
    """parts: how many; base: for each part that has rows the version that wrote it; rows: of the base when it was written."""

    parts: int
    base: dict[int, int] = field(default_factory=dict)
    deltas: list[Delta] = field(default_factory=list)
    rows: int = 0


class Store:
    """`parts`: into how many parts a new table's base is split, best some 256 MB each; `commit` with another number splits anew."""

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self, table: Table) -> list[int]:
        """Numbers of the committed versions: a version's commit is a file of its name, which is made last."""
        files, path = self._path(table.name, "commits")
        return sorted(int(s.getPath().getName()) for s in files.listStatus(path)) if files.exists(path) else []

    def layout(self, table: Table, version: int | None = None) -> Layout:
        """A version's list, by default the last one's; version 0 has no rows."""
        version = (self.versions(table) or [0])[-1] if version is None else version
        if not version:
            return Layout(self.parts)
        found = json.loads(self.spark.read.text(f"{self.root}/{table.name}/lists/{version}", wholetext=True).first()[0])
        return Layout(found["parts"], {int(p): v for p, v in found["base"].items()}, [Delta(**d) for d in found["deltas"]], found["rows"])

    def _base(self, table: Table, at: Layout, parts: Collection[int] | None) -> DataFrame:
        paths = [f"{self.root}/{table.name}/v{v}/part__={p}" for p, v in sorted(at.base.items()) if parts is None or p in parts]
        return self.spark.read.schema(table.schema).parquet(*paths) if paths else self.spark.createDataFrame([], table.schema)

    def _deltas(self, table: Table, deltas: Sequence[Delta], parts: Collection[int] | None) -> DataFrame | None:
        """The last row of each key in the deltas, with part__ and gone__; deltas without any of the parts aren't opened."""
        out = None
        for seq, d in enumerate(deltas):
            if parts is None or set(parts) & set(d.parts):
                rows = self.spark.read.schema(_delta_schema(table)).parquet(f"{self.root}/{table.name}/d{d.version}")
                rows = (rows if parts is None else rows.where(F.col("part__").isin(*parts))).withColumn("seq__", F.lit(seq))
                out = rows if out is None else out.unionByName(rows)
        return None if out is None else _last(table, out)

    def read(self, table: Table, version: int | None = None, parts: Collection[int] | None = None) -> DataFrame:
        """A version's rows, by default the last one's; with `parts` only those of these parts."""
        at = self.layout(table, version)
        base, changed = self._base(table, at, parts), self._deltas(table, at.deltas, parts)
        if changed is None:
            return base
        stay = base.join(changed.select(*table.key), list(table.key), "left_anti")
        return stay.select(*base.columns).unionByName(changed.where("not gone__").select(*base.columns))

    def lookup(self, table: Table, **key) -> DataFrame:
        """The rows of a whole key, from its part alone."""
        if set(key) != set(table.key):
            raise ValueError(f"{table.name}: a key has {', '.join(table.key)}")
        one = self.spark.createDataFrame([tuple(key[k] for k in table.key)], T.StructType([T.StructField(k, table.schema[k].dataType) for k in table.key]))
        rows = self.read(table, parts=self.touched(table, one))
        for k in table.key:
            rows = rows.where(F.col(k) == F.lit(key[k]))
        return rows

    def touched(self, table: Table, rows: DataFrame, version: int | None = None) -> set[int]:
        """The parts in which the keys of rows fall; no more numbers come to the driver than there are parts."""
        return set(self._sizes(rows.select(_part(table, self.layout(table, version).parts).alias("part__"))))

    def _sizes(self, rows: DataFrame) -> dict[int, int]:
        return {r[0]: r[1] for r in rows.groupBy("part__").count().collect()}

    def _claimed(self, table: Table, base: int | None, write: Callable[[int, Layout], Layout]) -> int:
        """A version after `base` (by default the last); fails if another writer has made or claimed it. A failed write gives its claim back."""
        last = base if base is not None else (self.versions(table) or [0])[-1]
        number = last + 1
        files, claim = self._path(table.name, "claims", str(number))
        if not files.createNewFile(claim):
            raise RuntimeError(f"{table.name}: version {number} belongs to another writer")
        try:
            made = write(number, self.layout(table, last))
            out = files.create(self._path(table.name, "lists", str(number))[1], True)
            try:
                out.write(json.dumps(asdict(made)).encode())
            finally:
                out.close()
        except BaseException:
            files.delete(claim, False)
            raise
        files.createNewFile(self._path(table.name, "commits", str(number))[1])
        return number

    def _write_base(self, table: Table, rows: DataFrame, number: int, parts: int) -> dict[int, int]:
        """Writes rows by part; a part is as many files, by as many tasks, as its bytes ask for."""
        typed = rows.select(*(F.col(f.name).cast(f.dataType) for f in table.schema)).withColumn("part__", _part(table, parts))
        typed.hint("rebalance", "part__").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part__").parquet(f"{self.root}/{table.name}/v{number}")
        files, pattern = self._path(table.name, f"v{number}", "part__=*")
        return dict.fromkeys((int(s.getPath().getName().split("=")[1]) for s in files.globStatus(pattern) or []), number)

    def commit(self, table: Table, rows: DataFrame, base: int | None = None, parts: int | None = None) -> int:
        """A version that has these rows and no others, all in its base."""

        def write(number: int, old: Layout) -> Layout:
            new = Layout(parts or old.parts, self._write_base(table, rows, number, parts or old.parts))
            new.rows = self._base(table, new, None).count()
            return new

        return self._claimed(table, base, write)

    def change(self, table: Table, changed: DataFrame, base: int | None = None) -> int:
        """A version with these rows, one for a key at most, in place of the ones before with their keys; gone__ marks keys that go.

        What is written is in proportion to the changes, over time with the factor that the merging of deltas has.
        """

        def write(number: int, old: Layout) -> Layout:
            new = changed.withColumn("part__", _part(table, old.parts))
            sizes = self._sizes(new)
            deltas, merged = list(old.deltas), [Delta(number, sum(sizes.values()), sorted(sizes))]
            while len([d for d in deltas[1 - FAN :] if d.magnitude <= merged[0].magnitude]) >= FAN - 1:
                merged = [*deltas[1 - FAN :], *merged]
                deltas = deltas[: 1 - FAN]
                merged = [Delta(number, sum(d.rows for d in merged), sorted({p for d in merged for p in d.parts}))]
            taken = old.deltas[len(deltas) :]
            fold = FAN * (merged[0].rows + sum(d.rows for d in deltas)) > old.rows
            taken = old.deltas if fold else taken
            rows = new.select(*(F.col(f.name).cast(f.dataType) for f in table.schema), "part__", "gone__").withColumn("seq__", F.lit(len(old.deltas)))
            for seq, d in enumerate(taken):
                rows = rows.unionByName(self.spark.read.schema(_delta_schema(table)).parquet(f"{self.root}/{table.name}/d{d.version}").withColumn("seq__", F.lit(seq)))
            last = _last(table, rows) if taken else rows.drop("seq__")
            if not fold:
                last.repartitionByRange("part__").sortWithinPartitions("part__", *table.key).write.mode("overwrite").parquet(f"{self.root}/{table.name}/d{number}")
                return Layout(old.parts, old.base, [*deltas, *merged], old.rows)
            parts = {*sizes, *(p for d in old.deltas for p in d.parts)}
            stay = self._base(table, old, parts).join(last.select(*table.key), list(table.key), "left_anti")
            names = table.schema.fieldNames()
            written = self._write_base(table, stay.select(*names).unionByName(last.where("not gone__").select(*names)), number, old.parts)
            made = Layout(old.parts, {p: v for p, v in old.base.items() if p not in parts} | written)
            made.rows = self._base(table, made, None).count()
            return made

        return self._claimed(table, base, write)

    def release(self, table: Table) -> None:
        """Takes back the claim of a writer that has died without a commit."""
        files, claim = self._path(table.name, "claims", str((self.versions(table) or [0])[-1] + 1))
        files.delete(claim, False)

    def expire(self, table: Table, keep: int = 1) -> list[int]:
        """Forgets all versions but the last `keep`, and removes the parts and deltas that none of these has; who still reads one fails."""
        known = self.versions(table)
        gone, stay = known[:-keep] if keep > 0 else [], [self.layout(table, v) for v in known[-keep:]]
        used = {f"v{v}/part__={p}" for at in stay for p, v in at.base.items()} | {f"d{d.version}" for at in stay for d in at.deltas}
        for version in gone:
            for place in ("commits", "lists"):
                files, path = self._path(table.name, place, str(version))
                files.delete(path, False)
        for version in range(1, gone[-1] + 1 if gone else 1):
            files, folder = self._path(table.name, f"v{version}")
            held = [s.getPath() for s in files.globStatus(self._path(table.name, f"v{version}", "part__=*")[1]) or []]
            old = [path for path in held if f"v{version}/{path.getName()}" not in used]
            for path in old if len(old) < len(held) else [folder]:
                files.delete(path, True)
            if f"d{version}" not in used:
                files.delete(self._path(table.name, f"d{version}")[1], True)
        return gone


def _part(table: Table, count: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k).cast(table.schema[k].dataType) for k in table.key)), F.lit(count)).cast("int")


def _delta_schema(table: Table) -> T.StructType:
    """Keys that are gone have no other values, so nulls may be anywhere."""
    return T.StructType([*(T.StructField(f.name, f.dataType) for f in table.schema), T.StructField("part__", T.IntegerType()), T.StructField("gone__", T.BooleanType())])


def _last(table: Table, rows: DataFrame) -> DataFrame:
    """The row of each key with the greatest seq__, which goes."""
    rest = [f.name for f in table.schema if f.name not in table.key] + ["part__", "gone__"]
    return rows.groupBy(*table.key).agg(F.max_by(F.struct(*rest), "seq__").alias("r")).select(*table.key, "r.*").select(*table.schema.fieldNames(), "part__", "gone__")


def upsert_rows(target: DataFrame, staged: DataFrame, key: Sequence[str], preserve: Sequence[str] = ()) -> DataFrame:
    """The columns of target, and action: inserted, updated (even if nothing differs) or kept.

    A staged row replaces every column that staged has, but for the key, nulls included, and `preserve`d ones where the new value is null.
    """
    has = [c for c in target.columns if c in staged.columns]
    old, new = target.withColumn("__old", F.lit(True)), staged.withColumn("__new", F.lit(True))
    both = old.alias("o").join(new.alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full_outer")
    staged_row = F.col("n.__new").isNotNull()

    def value(c: str):
        if c not in has:
            return F.current_timestamp() if c == "updated_at" and c not in has else F.col(f"o.{c}")
        return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in preserve else F.col(f"n.{c}")

    columns = [F.when(staged_row, value(c)).otherwise(F.col(f"o.{c}")).alias(c) for c in target.columns]
    action = F.when(staged_row & F.col("o.__old").isNotNull(), "updated").when(staged_row, "inserted").otherwise("kept")
    return both.select(*columns, action.alias("action"))


def check(table: Table, staged: DataFrame) -> None:
    """Raises on repeated keys, on nulls where none may be and on texts that are too long."""
    twice = staged.groupBy(*table.key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{table.name}: a key is staged twice: {twice[0].asDict()}")
    here = [f for f in table.schema.fieldNames() if f in staged.columns]
    missing = staged.select(*here, *(F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in here))
    bad = missing.select(violations(table).alias("why")).where(F.size("why") > 0).limit(1).collect()
    if bad:
        raise ValueError(f"{table.name}: {', '.join(bad[0].why)}")


def pruned(rows: DataFrame, source: str, keep: DataFrame) -> DataFrame:
    """The rows without those of a source whose source_id isn't among keep's; other sources stay."""
    wanted = keep.select(F.col("source_id").alias("__id")).distinct()
    other = rows.where(~F.col("source").eqNullSafe(F.lit(source)))
    return other.unionByName(rows.where(F.col("source") == source).join(wanted, F.col("source_id") == F.col("__id"), "left_semi"))


def load(store: Store, table: Table, staged: DataFrame, *, prune_source: str | None = None, preserve: Sequence[str] = ()) -> dict[str, int]:
    """Upserts staged rows, and with prune_source drops that source's other rows, in one version. Counts of inserted, updated and pruned rows.

    Of the table, the parts with staged keys are read (for a prune the keys of all), and the changes are written.
    """
    staged = kept(staged)
    check(table, staged)
    if not staged.limit(1).count():
        if prune_source is not None:
            raise ValueError(f"refusing to prune every row of {prune_source}: nothing is staged")
        return {"inserted": 0, "updated": 0}
    base = (store.versions(table) or [0])[-1]
    keys = staged.select(*(F.col(k).cast(table.schema[k].dataType).alias(k) for k in table.key))
    known = store.read(table, base, store.touched(table, staged, base)).join(keys, list(table.key), "left_semi").select(*table.schema.fieldNames())
    marked = upsert_rows(known, staged, table.key, preserve).withColumn("gone__", F.lit(False))
    if prune_source is not None:
        old = store.read(table, base).where(F.col("source") == prune_source).select(*table.key).join(keys, list(table.key), "left_anti")
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in table.key]
        marked = marked.unionByName(old.select(*table.key, *rest, F.lit("pruned").alias("action"), F.lit(True).alias("gone__")))
    marked = kept(marked)
    counts = {r.action: r["count"] for r in marked.groupBy("action").count().collect()}
    store.change(table, marked.drop("action"), base)
    return {k: counts.get(k, 0) for k in (("inserted", "updated", "pruned") if prune_source is not None else ("inserted", "updated"))}
