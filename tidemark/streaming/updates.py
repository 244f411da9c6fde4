"""A streaming source over a polling service of messages, with offsets.

The service (one address for each bot) hands out waiting updates from the earliest one that is not confirmed,
a page at a time, and forgets for good what lies before an offset that is asked for. So a batch is what one
page holds beyond the last offset, it is read without an offset, and only after Spark has logged the
batch as done is its end confirmed. A failed or restarted batch is read again from the service.

Between the log of a batch and its confirmation a run may die. The next run reads the end of the last logged
batch from the checkpoint (:func:`follow`) and confirms that first, so a page of updates that are done never
hides new ones.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode, urlparse
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

SCHEMA = "bot string, update_id long, chat_id string, text string, sent_at timestamp"
PAGE, TRIES, SECONDS = 100, 3, 25.0


class Waiting(InputPartition):
    """The updates of one bot from ``low`` up to, not including, ``high``."""

    def __init__(self, bot: str, low: int, high: int) -> None:
        self.bot, self.low, self.high = bot, low, high


def _called(url: str, bot: str, **parameters: int | str) -> list[dict]:
    """One call of the service; a few tries, with growing pauses, for what may pass."""
    request = Request(f"{url}/{bot}/getUpdates?{urlencode(parameters)}", headers={"Accept": "application/json"})
    for n in range(TRIES):
        try:
            with urlopen(request, timeout=SECONDS) as answer:
                said = json.load(answer)
            if not said.get("ok"):
                raise RuntimeError(f"updates of a bot were refused: {said.get('description', '')[:200]}")
            return said.get("result") or []
        except HTTPError as e:
            if e.code not in (429, 500, 502, 503, 504) or n == TRIES - 1:
                raise RuntimeError(f"updates of a bot answered {e.code}") from None  # the address holds a secret
        except (URLError, TimeoutError):
            if n == TRIES - 1:
                raise RuntimeError("updates of a bot cannot be reached") from None
        time.sleep(0.2 * 2 ** n)
    return []


class Updates(DataSource):
    """Options: url, bots (separated by commas), chat (the only one that is answered; empty: all), page, and from
    (JSON of bot to offset: what earlier runs have done)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark-updates"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return Reader(dict(self.options))


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url = options["url"].rstrip("/")
        if urlparse(self.url).scheme not in ("http", "https"):
            raise ValueError("the address of updates must be http or https")
        self.bots = [b for b in options["bots"].split(",") if b]
        self.chat = options.get("chat", "")
        self.page = int(options.get("page", PAGE))
        self.done = {b: int(n) for b, n in json.loads(options.get("from") or "{}").items() if b in self.bots}
        self.planned: dict[str, int] = {}
        for bot, offset in self.done.items():
            self._confirm(bot, offset)

    def _confirm(self, bot: str, offset: int) -> None:
        if offset > 0:
            _called(self.url, bot, offset=offset, limit=1, timeout=0)

    def initialOffset(self) -> dict:
        return {b: 0 for b in self.bots}

    def latestOffset(self) -> dict:
        """What one page of each bot holds beyond what was planned. Spark asks again only when the planned
        batch is logged as done, so that is confirmed here at the latest: else the page would still show it."""
        self.commit(self.planned)
        self.planned = {}
        for bot in self.bots:
            last = max((int(u["update_id"]) for u in _called(self.url, bot, limit=self.page, timeout=0)), default=-1) + 1
            self.planned[bot] = max(last, self.done.get(bot, 0))
        return dict(self.planned)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Waiting(b, int(start.get(b, 0)), int(end[b])) for b in self.bots if int(end.get(b, 0)) > int(start.get(b, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        assert isinstance(partition, Waiting)
        from datetime import datetime, timezone

        for u in _called(self.url, partition.bot, limit=self.page, timeout=0):
            said = u.get("message") or {}
            n, chat = int(u["update_id"]), str((said.get("chat") or {}).get("id") or "")
            if partition.low <= n < partition.high and (not self.chat or chat == self.chat):
                at = datetime.fromtimestamp(said["date"], timezone.utc) if said.get("date") is not None else None
                yield partition.bot, n, chat, said.get("text"), at

    def commit(self, end: dict) -> None:
        for bot, offset in end.items():
            if int(offset) > self.done.get(bot, 0):
                self._confirm(bot, int(offset))
                self.done[bot] = int(offset)

    def stop(self) -> None:
        """Nothing is held open."""


def done(spark: SparkSession, checkpoint: str) -> dict[str, int]:
    """The end of the last batch that a checkpoint logs as done, by bot; read through Spark's file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def logged(what: str) -> list[int]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path, what)
        return [int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit()] if files.exists(folder) else []

    last = max(set(logged("commits")) & set(logged("offsets")), default=None)
    if last is None:
        return {}
    lines = [r.value for r in spark.read.text(f"{checkpoint}/offsets/{last}", wholetext=True).collect()][0].strip().splitlines()
    return {b: int(n) for b, n in json.loads(lines[-1]).items()} if lines[-1].startswith("{") else {}


def follow(spark: SparkSession, url: str, bots: Sequence[str], checkpoint: str, chat: str = "", page: int = PAGE) -> DataFrame:
    """The updates of ``bots`` as a stream that goes on where ``checkpoint`` ends."""
    spark.dataSource.register(Updates)
    return (spark.readStream.format(Updates.name()).option("url", url).option("bots", ",".join(bots)).option("chat", chat)
            .option("page", page).option("from", json.dumps(done(spark, checkpoint))).load())


def collected(stream: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Routed requests (bot, update_id, chat_id, command, argument, sent_at) in a folder of Parquet: a batch has a folder
    of its own that a replay overwrites, so nothing is lost or doubled. Updates without text are passed over."""
    from tidemark.operators import serve

    said = serve.route(F.col("text"))
    rows = stream.where("coalesce(text, '') <> ''").select("bot", "update_id", "chat_id", said["command"].alias("command"), said["argument"].alias("argument"), "sent_at")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={n}")

    to = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (to.trigger(availableNow=True) if once else to.trigger(processingTime="2 seconds")).start()
