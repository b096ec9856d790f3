"""Where tables come from and go to: Parquet folders, databases, and question-answer datasets."""

from __future__ import annotations

import os
from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemosa.functions.keys import first_per_key, norm_key
from mnemosa.functions.vectors import decode_vector, encode_vector
from mnemosa.operators.scans import insert_or_ignore
from mnemosa.schema import TABLES, evolve


#: What names a row of each table.
KEYS = {t: "uuid" for t in TABLES} | {"slot_canonical": "name"}
#: Columns that hold keys; they are stored as they are compared.
REFERENCES = ("uuid", "entity_id", "conversation_id", "session_id", "process_id", "superseded_by")


class Store(Protocol):
    """What the library needs of a store: tables of rows with a key, of which the newest version counts."""

    def read(self, table: str, columns: Sequence[str] | None = None) -> DataFrame: ...

    def append(self, table: str, rows: DataFrame) -> None: ...

    def delete(self, table: str, keys: DataFrame) -> None: ...


class LogStore:
    """Tables as logs: every write adds versions of rows with the next change number, and a deleted row is a version that says so.

    A row's state is its version with the latest updated_at, where the table has that, and
    then the latest change. One process writes at a time; readers may be many.
    """

    def log(self, table: str) -> DataFrame:
        """All versions, with change_no and deleted."""
        raise NotImplementedError

    def write(self, table: str, rows: DataFrame, change: int) -> None:
        raise NotImplementedError

    def last_change(self, table: str) -> int:
        raise NotImplementedError

    def read(self, table: str, columns: Sequence[str] | None = None) -> DataFrame:
        """The rows as they are now, with `columns` (by default all); no other column but those that tell versions apart is read."""
        log, key = self.log(_known(table)), KEYS[table]
        keep = list(columns) if columns is not None else [c for c in log.columns if c not in ("change_no", "deleted")]
        order = [F.col(c).desc_nulls_last() for c in ("updated_at", "change_no") if c in log.columns]
        slim = log.filter(F.col(key).isNotNull()).select(*dict.fromkeys([key, *keep, *(c for c in ("updated_at", "change_no", "deleted") if c in log.columns)]))
        return first_per_key(slim, [key], order).filter("NOT coalesce(deleted, false)").select(*keep)

    def append(self, table: str, rows: DataFrame) -> None:
        """Adds rows, or new versions of rows that are there. A version is whole: columns it lacks are null."""
        self._write(table, evolve(rows, _known(table)).withColumn("deleted", F.lit(False)))

    def append_new(self, table: str, rows: DataFrame, key: str) -> None:
        """Adds rows whose `key` isn't there yet."""
        self.append(table, insert_or_ignore(self.read(table), _keyed(evolve(rows, _known(table))), key))

    def delete(self, table: str, keys: DataFrame) -> None:
        """Deletes the rows that `keys` names; unknown keys change nothing."""
        key = KEYS[_known(table)]
        named = keys.select(norm_key(key).alias(key) if key in REFERENCES else key).distinct()
        there = self.read(table, [c for c in TABLE_COLUMNS[table] if c in (key, "updated_at")]).join(named, key, "left_semi")
        self._write(table, evolve(there, table).withColumn("deleted", F.lit(True)))

    def _write(self, table: str, rows: DataFrame) -> None:
        self.write(table, _keyed(rows), self.last_change(table) + 1)


TABLE_COLUMNS = {t: [c.strip().split(" ")[0] for c in columns.split(",") if " " in c.strip()] for t, columns in TABLES.items()}


def _known(table: str) -> str:
    if table not in TABLES:
        raise ValueError(f"no table {table}")
    return table


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: norm_key(c) for c in rows.columns if c in REFERENCES})


class ParquetStore(LogStore):
    """One folder per table and in it one per change; a change's files appear all at once when its job commits."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{_known(table)}"

    def log(self, table: str) -> DataFrame:
        schema = f"{TABLES[table]}, deleted boolean, change_no bigint"
        return self.spark.read.schema(schema).parquet(self.path(table)) if self.last_change(table) else self.spark.createDataFrame([], schema)

    def write(self, table: str, rows: DataFrame, change: int) -> None:
        rows.write.parquet(f"{self.path(table)}/change_no={change}")

    def last_change(self, table: str) -> int:
        """From the folders' names; no file is read."""
        path, files = self._fs(self.path(table))
        if not files.exists(path):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return max([int(n.split("=")[1]) for n in names if n.startswith("change_no=")], default=0)

    def compact(self, table: str) -> None:
        """Writes the table's state as one change and drops the versions before it."""
        change = self.last_change(table) + 1
        fresh = f"{self.folder}/_{table}-{change}"
        self.write_at(f"{fresh}/change_no={change}", self.read(table).withColumn("deleted", F.lit(False)))
        (old, files), (new, _) = self._fs(self.path(table)), self._fs(fresh)
        files.delete(old, True)
        files.rename(new, old)

    @staticmethod
    def write_at(path: str, rows: DataFrame) -> None:
        rows.write.parquet(path)

    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


class JdbcStore(LogStore):
    """Tables of a relational database; needs the database's driver on Spark's class path.

    Filters and columns are pushed into the database. Give `bounds` to read a table by ranges
    of a numeric or time column in parallel; without them one task reads it. Vectors are
    stored as bytes, lists as JSON. A table without change numbers can be read as it is.
    """

    def __init__(self, spark: SparkSession, url: str, prefix: str = "", bounds: dict[str, tuple[str, str, str, int]] | None = None, **properties: str):
        self.spark, self.url, self.prefix, self.bounds, self.properties = spark, url, prefix, bounds or {}, properties

    def _reader(self, **options: str):
        return self.spark.read.format("jdbc").options(url=self.url, **options, **self.properties)

    def _there(self, table: str) -> bool:
        try:
            return bool(self._reader(dbtable=self.prefix + table).load().columns)
        except Exception as e:  # noqa: BLE001
            if any(w in str(e).lower() for w in ("exist", "not found", "no such table", "unknown table")):
                return False
            raise

    def log(self, table: str) -> DataFrame:
        schema = f"{TABLES[table]}, deleted boolean, change_no bigint"
        if not self._there(table):
            return self.spark.createDataFrame([], schema)
        reader = self._reader(dbtable=self.prefix + table)
        if table in self.bounds:
            column, low, high, n = self.bounds[table]
            reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=str(n))
        df = reader.load()
        df = self.decoded(df.toDF(*[c.lower() for c in df.columns]), table)
        for c, kind in (("deleted", "boolean"), ("change_no", "bigint")):
            df = df if c in df.columns else df.withColumn(c, F.lit(None).cast(kind))
        return df

    def write(self, table: str, rows: DataFrame, change: int) -> None:
        numbered = self.encoded(rows).withColumn("change_no", F.lit(change).cast("bigint"))
        numbered.write.format("jdbc").options(url=self.url, dbtable=self.prefix + table, **self.properties).mode("append").save()

    def last_change(self, table: str) -> int:
        if not self._there(table):
            return 0
        return self.log(table).agg(F.max("change_no")).first()[0] or 0

    @staticmethod
    def encoded(df: DataFrame) -> DataFrame:
        """Vectors as bytes, lists as JSON text."""
        out = {n: encode_vector(n) if k == "array<float>" else F.to_json(n) for n, k in df.dtypes if k.startswith("array")}
        return df.withColumns(out) if out else df

    @staticmethod
    def decoded(df: DataFrame, table: str) -> DataFrame:
        """Stored bytes as vectors, stored JSON text as lists."""
        out = {}
        for name, kind in df.dtypes:
            if kind == "binary":
                out[name] = decode_vector(name)
            elif name == "entity_mentions" and kind == "string":
                out[name] = F.coalesce(F.from_json(name, "array<string>"), F.array().cast("array<string>"))
        return df.withColumns(out) if out else df


def read_qa_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """turns and questions of a JSON array of conversations with sessions `session_1`, `session_2`, ...

    turns: conv_idx, session_no, session_date, turn_no, speaker, role, text. questions:
    conv_idx, question_idx, question, ground_truth, category, evidence.
    """
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("entry")) if os.path.isfile(path) else spark.read.text(path).select(F.col("value").alias("entry"))
    entry = text.withColumn("conv_idx", F.get_json_object("entry", "$.conv_idx").cast("int"))
    numbered = entry if entry.filter("conv_idx IS NOT NULL").limit(1).count() else _number(text)
    talk = numbered.withColumns({"_c": F.from_json(F.get_json_object("entry", "$.conversation"), "map<string,string>"), "_qa": F.from_json(F.get_json_object("entry", "$.qa"), "array<struct<question:string,answer:string,adversarial_answer:string,evidence:array<string>,category:int>>")})
    sessions = talk.select("conv_idx", F.col("_c")["speaker_a"].alias("_a"), "_c", F.explode("_c").alias("_key", "_value")).filter(F.col("_key").rlike(r"^session_\d+$"))
    dated = sessions.withColumns({"session_no": F.regexp_extract("_key", r"(\d+)$", 1).cast("int"), "session_date": session_date(F.try_element_at("_c", F.concat("_key", F.lit("_date_time"))))})
    turn = F.from_json("_value", "array<struct<speaker:string,dia_id:string,text:string>>")
    turns = dated.select("conv_idx", "session_no", "session_date", "_a", F.posexplode(turn).alias("_i", "_t"))
    turns = turns.select("conv_idx", "session_no", "session_date", (F.col("_i") + 1).alias("turn_no"), "_t.speaker", F.when(F.col("_t.speaker") == F.col("_a"), "user").otherwise("assistant").alias("role"), "_t.text")
    questions = talk.select("conv_idx", F.posexplode("_qa").alias("question_idx", "q")).select("conv_idx", "question_idx", "q.question", F.coalesce("q.answer", "q.adversarial_answer").alias("ground_truth"), "q.category", "q.evidence")
    return turns, questions


def _number(entries: DataFrame) -> DataFrame:
    """Entries with a number by their text's hash, the same on every run."""
    return entries.withColumn("conv_idx", F.pmod(F.xxhash64("entry"), F.lit(1 << 30)).cast("int"))


def session_date(text):
    """`4:04 pm on 20 January, 2023` as a date; null where it doesn't read."""
    return F.to_date(F.try_to_timestamp(F.regexp_extract(text, r"on (\d{1,2} [A-Za-z]+),? (\d{4})", 0), F.lit("'on' d MMMM, yyyy")))


def write_run(scores: DataFrame, folder: str, run_id: str) -> None:
    """Result rows of a run as JSON lines."""
    scores.write.mode("overwrite").json(f"{folder}/run_id={run_id}")


def list_runs(spark: SparkSession, folder: str) -> DataFrame:
    """run_id, n_results of the runs in a folder, the newest id first."""
    return spark.read.json(folder).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_results")).orderBy(F.desc("run_id"))


def read_run(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    return spark.read.json(f"{folder}/run_id={run_id}")
