"""Stores, model versions and assertions: small tables of one tenant directory, kept as Parquet."""

from __future__ import annotations

import datetime as dt
import json
import secrets as _random
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import check_model, from_json, to_json
from ..model.ast import Model
from . import changes, tuples

STORES = "id string, name string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted boolean"
MODELS = "id string, store_id string, schema_version string, model_json string, created_at timestamp_ntz"
ASSERTIONS = "store_id string, model_id string, position int, user string, relation string, object string, expectation boolean, context string, contextual_tuples string"
#: Digits of sortable ids, largest sizes.
_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
MAX_WRITES, MAX_MODEL_BYTES, MAX_NAME = 100, 1 << 20, 256
#: Parsed models that are remembered.
KEPT_MODELS = 1000


def new_id() -> str:
    """26 characters that sort by time."""
    value = int(time.time() * 1000) << 80 | _random.randbits(80)
    return "".join(_DIGITS[value >> 5 * i & 31] for i in reversed(range(26)))


def latest_models(models: DataFrame) -> DataFrame:
    """Each store's newest model: by time, then by id."""
    newest = Window.partitionBy("store_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return models.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


class Catalog:
    """Stores below one folder. Tables are appended to or replaced as a whole; the last parsed models are remembered by id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._models = spark, path.rstrip("/"), {}

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    # stores

    def stores(self) -> DataFrame:
        """Those that exist, newest first."""
        last = Window.partitionBy("id").orderBy(F.col("updated_at").desc(), F.col("deleted").desc())
        out = self._read("stores", STORES).withColumn("_n", F.row_number().over(last)).filter("_n = 1 AND NOT deleted")
        return out.drop("_n", "deleted").orderBy(F.col("created_at").desc(), F.col("id").desc())

    def create_store(self, name: str, id_: str | None = None) -> str:
        if not name or len(name.encode()) > MAX_NAME:
            raise ValueError("a store's name has 1 to 256 bytes")
        id_ = id_ or new_id()
        if not self.stores().filter(F.col("id") == id_).isEmpty():
            raise ValueError(f"store {id_} exists")
        now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
        self._append("stores", [(id_, name, now, now, False)], STORES)
        return id_

    def _store(self, id_: str):
        got = self.stores().filter(F.col("id") == id_).head()
        if got is None:
            raise KeyError(f"store {id_} does not exist")
        return got

    def update_store(self, id_: str, name: str) -> None:
        old = self._store(id_)
        self._append("stores", [(id_, name, old["created_at"], dt.datetime.now(dt.UTC).replace(tzinfo=None), False)], STORES)

    def delete_store(self, id_: str) -> None:
        """The store goes, and with it what is kept under it: a store made again under its id starts empty.

        Models and log rows count only from their store's creation on.
        """
        old = self._store(id_)
        self._append("stores", [(id_, old["name"], old["created_at"], dt.datetime.now(dt.UTC).replace(tzinfo=None), True)], STORES)

    # models

    def write_model(self, store_id: str, model: Model) -> str:
        self._store(store_id)
        text = to_json(check_model(model))
        if len(text.encode()) > MAX_MODEL_BYTES:
            raise ValueError("the model is larger than 1 MB")
        id_ = new_id()
        self._append("models", [(id_, store_id, model.schema_version, text, dt.datetime.now(dt.UTC).replace(tzinfo=None))], MODELS)
        return id_

    def models(self, store_id: str) -> DataFrame:
        since = self._store(store_id)["created_at"]
        gone = self._read("deleted_models", "id string, store_id string").filter(F.col("store_id") == store_id)
        own = self._read("models", MODELS).filter((F.col("store_id") == store_id) & (F.col("created_at") >= F.lit(since)))
        return own.join(gone.select("id"), "id", "left_anti").orderBy(F.col("created_at").desc(), F.col("id").desc())

    def model(self, store_id: str, id_: str | None = None) -> Model:
        """A version, or the latest."""
        rows = self.models(store_id)
        row = (rows if id_ is None else rows.filter(F.col("id") == id_)).head()
        if row is None:
            raise KeyError(f"store {store_id} has no model {id_ or ''}".strip())
        if row["id"] not in self._models:
            if len(self._models) >= KEPT_MODELS:
                self._models.pop(next(iter(self._models)))
            self._models[row["id"]] = from_json(row["model_json"])
            self._models[row["id"]].id = row["id"]
        return self._models[row["id"]]

    def delete_model(self, store_id: str, id_: str) -> None:
        """The version goes; the latest of the others takes its place."""
        self.model(store_id, id_)
        self._append("deleted_models", [(id_, store_id)], "id string, store_id string")
        self._models.pop(id_, None)

    # tuples

    def tuples(self, store_id: str) -> DataFrame:
        return changes.state(self.log(store_id)).select(*tuples.COLUMNS)

    def log(self, store_id: str) -> DataFrame:
        since = self._store(store_id)["created_at"]
        schema = ", ".join(f"{c} string" for c in tuples.COLUMNS) + ", operation string, changed_at timestamp_ntz, seq bigint"
        return self._read(f"log/{store_id}", schema).filter(F.col("changed_at") >= F.lit(since))

    def write(self, store_id: str, writes: DataFrame | None = None, deletes: DataFrame | None = None, limit: int | None = MAX_WRITES) -> None:
        """Deletes, then writes, as one appended set of log rows; nothing is written if any tuple is refused."""
        model = self.model(store_id)
        given = [tuples.with_columns(df) for df in (writes, deletes) if df is not None]
        if limit is not None and sum(df.count() for df in given) > limit:
            raise ValueError(f"more than {limit} tuples in one request")
        if deletes is not None and (bad := tuples.problems(tuples.with_columns(deletes)).filter("problem IS NOT NULL").head()) is not None:
            raise ValueError(bad["problem"])
        if writes is not None:
            writes = tuples.with_columns(writes).dropDuplicates(list(tuples.KEY))
            bad = tuples.problems(writes, model).filter("problem IS NOT NULL").head()
            if bad is not None:
                raise ValueError(bad["problem"])
            # only the log of the written keys decides
            stored = changes.state(tuples.with_keys(self.log(store_id), writes)).select(*tuples.COLUMNS)
            if deletes is not None:
                stored = tuples.merged(stored, None, tuples.with_columns(deletes))
            if (found := tuples.conflicts(stored, writes).head()) is not None:
                raise tuples.ConditionConflict(str(tuple(found)))
        now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
        rows = changes.log_of(writes, None if deletes is None else tuples.with_columns(deletes), now, time.time_ns())
        rows.write.mode("append").parquet(f"{self.path}/log/{store_id}")

    # assertions

    def write_assertions(self, store_id: str, model_id: str, rows: list[dict]) -> None:
        """The assertions of a model, in place of earlier ones."""
        self.model(store_id, model_id)
        data = [(store_id, model_id, i, r["user"], r["relation"], r["object"], bool(r["expectation"]), json.dumps(r["context"]) if r.get("context") else None, json.dumps(r["contextual_tuples"]) if r.get("contextual_tuples") else None) for i, r in enumerate(rows)]
        self.spark.createDataFrame(data, ASSERTIONS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/assertions/{store_id}/{model_id}")

    def assertions(self, store_id: str, model_id: str) -> DataFrame:
        return self._read(f"assertions/{store_id}/{model_id}", ASSERTIONS).orderBy("position")


__all__ = ["Catalog", "latest_models", "new_id"]
