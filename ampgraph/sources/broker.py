"""A message broker as a streaming source, by Spark's Python data source API; needs the paho client."""

from __future__ import annotations

import queue

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class BrokerSource(DataSource):
    """spark.readStream.format("broker").option("host", ...).option("topic", ...): rows of (topic, value, arrival_us).

    The subscription lives on the driver and hands each micro-batch what came in since the last one. Delivery is
    at most once, as the broker's quality of service 0 is; use Kafka where replays are needed.
    """

    @classmethod
    def name(cls) -> str:
        return "broker"

    def schema(self) -> str:
        return "topic string, value string, arrival_us long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        try:
            import paho.mqtt.client as mqtt
        except ImportError as e:
            raise RuntimeError("the broker source needs the paho client on the driver") from e
        import time

        self.waiting: queue.Queue = queue.Queue()
        self.kept: dict[int, list] = {}
        self.client = mqtt.Client(mqtt.CallbackAPIVersion.VERSION2)
        self.client.on_message = lambda c, u, m: self.waiting.put((m.topic, m.payload.decode("utf-8", "replace"), time.time_ns() // 1000))
        self.client.connect(options["host"], int(options.get("port", "1883")))
        self.client.subscribe(options.get("topic", "#"), qos=0)
        self.client.loop_start()

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict):
        rows = []
        while not self.waiting.empty():
            rows.append(self.waiting.get_nowait())
        self.kept[start["n"]] = rows
        return iter(rows), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self.kept.get(start["n"], []))

    def commit(self, end: dict) -> None:
        self.kept = {n: rows for n, rows in self.kept.items() if n >= end["n"]}
