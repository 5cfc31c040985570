"""Batch source for recorded message logs kept as SQLite files.

    spark.dataSource.register(MessageLogSource)
    spark.read.format("message_log").load("/shared/run_1/log.db3").where("topic = '/lidar'")

Each input partition reads one range of message ids through the id index, so a
large log is read by many tasks; a filter on ``topic`` reaches the SQL query.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

SCHEMA = "topic string, type string, message_id bigint, recorded_ns bigint, payload binary"
IDS_PER_PARTITION = 20_000


@dataclass
class IdRange(InputPartition):
    path: str
    low: int
    high: int


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class MessageLogReader(DataSourceReader):
    def __init__(self, paths: list[str], per_partition: int):
        self.paths, self.per_partition, self.topic = paths, per_partition, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("topic",):
                self.topic = f.value
            else:
                yield f

    def partitions(self) -> list[IdRange]:
        out = []
        for path in self.paths:
            with _open(path) as db:
                if self.topic is not None and not db.execute(
                    "SELECT 1 FROM topics WHERE name = ?", (self.topic,)
                ).fetchone():
                    raise ValueError(f"missing topic {self.topic} in {path}")
                low, high = db.execute("SELECT min(id), max(id) FROM messages").fetchone()
            if low is not None:
                step = self.per_partition
                out += [IdRange(path, a, min(a + step, high + 1)) for a in range(low, high + 1, step)]
        return out

    def read(self, partition: IdRange) -> Iterator[tuple]:
        sql = (
            "SELECT t.name, t.type, m.id, m.timestamp, m.data FROM messages m JOIN topics t ON t.id = m.topic_id"
            " WHERE m.id >= ? AND m.id < ?"
        )
        args: list = [partition.low, partition.high]
        if self.topic is not None:
            sql += " AND t.name = ?"
            args.append(self.topic)
        with _open(partition.path) as db:
            yield from db.execute(sql + " ORDER BY m.id", args)


class MessageLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MessageLogReader:
        paths = [p for p in self.options["path"].split(",") if p]
        return MessageLogReader(paths, int(self.options.get("idsPerPartition", IDS_PER_PARTITION)))
