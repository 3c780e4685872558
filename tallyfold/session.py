"""Session settings, the shared scratch location, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables of the scopes that are open, innermost last.
_SCOPES: ContextVar[tuple[dict[str, SparkSession], ...]] = ContextVar("scopes", default=())


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyfold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call sites are not recorded for every expression: that doubles the time to build a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder named by ``spark.checkpoint.dir``.

    That folder is shared by all executors. Only a local master, where driver
    and executors are one process, may fall back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tallyfold-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes an intermediate table once and reads it back.

    For results that several later steps read: without it each step would compute the whole
    chain again. Also for group values about to meet their rows: the planner then knows their
    size from the file and can broadcast them, where it would else shuffle the rows before it
    finds out that the other side is small. The table lives in the shared scratch folder, so
    losing an executor loses nothing. Writing it runs a job. The innermost open
    ``scratch_scope`` owns the table; without one it stays. ``options`` go to the writer.
    """
    path = scratch_path(df.sparkSession, name)
    _write(df, path, options)
    scopes = _SCOPES.get()
    if scopes:
        scopes[-1][path] = df.sparkSession
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write(df: DataFrame, path: str, options: dict[str, str]) -> None:
    """Writes the rows; the shuffle files of this write go with its end, not when the driver happens to collect garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def settle_computed(df: DataFrame, name: str) -> DataFrame:
    """``settle``, unless the rows come straight from files: those are as cheap to read again."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = [line.lstrip(" +-:").split(" ", 1)[0].split("[", 1)[0] for line in plan.splitlines() if line.strip()]
    plain = {"Project", "Filter", "Relation", "LocalRelation", "Range"}
    return df if all(n in plain for n in nodes) else settle(df, name)


def _deleted(path: str, spark: SparkSession) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scope:
    """Tables settled since it was opened."""

    def __init__(self, owned: dict[str, SparkSession]):
        self._owned = owned

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """Settles what is handed out; it belongs to the next outer scope, not to this one."""
        scopes = _SCOPES.get()
        inner = next((i for i, s in enumerate(scopes) if s is self._owned), len(scopes))
        place = _SCOPES.set(scopes[:inner])
        try:
            return settle(df, name)
        finally:
            _SCOPES.reset(place)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Settles a table that belongs to this scope, also while inner ones are open."""
        scopes = _SCOPES.get()
        own = next(i for i, s in enumerate(scopes) if s is self._owned)
        place = _SCOPES.set(scopes[: own + 1])
        try:
            return settle(df, name)
        finally:
            _SCOPES.reset(place)

    def free(self) -> None:
        """Deletes the tables so far. No frame that reads them may be used afterwards."""
        while self._owned:
            _deleted(*self._owned.popitem())


@contextmanager
def scratch_scope() -> Iterator[Scope]:
    """Owns the tables settled within, and deletes them at its end.

    Frames that read them must have been used by then; one to be handed out goes through ``result``.
    The tables of a scope that fails are deleted too.
    """
    owned: dict[str, SparkSession] = {}
    place = _SCOPES.set((*_SCOPES.get(), owned))
    scope = Scope(owned)
    try:
        yield scope
    finally:
        _SCOPES.reset(place)
        scope.free()
