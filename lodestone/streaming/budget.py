"""A token budget for each source as the state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CUT = "source string, doc_id long, n_tokens long, start long, kept long, tokens binary"
#: Bytes of a token.
WIDE = 2


def state_store(spark: SparkSession) -> None:
    """Operators with state of their own need the store that keeps it on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Budget(StatefulProcessor):
    """Of each source documents in order until their tokens sum up to the target exactly; the last one is cut.

    The state of a source is what it has been given, and how much of its open document was left out; and, where rows
    have keys, which keys it has accepted, for ever. Documents of a batch are taken by doc_id, batches as they come. A
    source whose budget is full costs a look at its state; its rows are not read."""

    def __init__(self, target: int):
        self.target = target

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.given = handle.getValueState("given", "given long, documents long, left_out long")
        self.keys = handle.getMapState("keys", "key string", "doc_id long")

    def fresh(self, batch: pd.DataFrame) -> pd.DataFrame:
        """Without documents whose key an earlier one of the source has."""
        first = batch[batch["key"].isna() | ~batch["key"].duplicated()]
        return first[[pd.isna(k) or not self.keys.containsKey((k,)) for k in first["key"]]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given, documents, _ = self.given.get() if self.given.exists() else (0, 0, 0)
        if given >= self.target:
            for _ in rows:
                pass
            return
        batch = self.fresh(pd.concat(list(rows), ignore_index=True).sort_values("doc_id", kind="stable"))
        ahead = given + batch["n_tokens"].cumsum() - batch["n_tokens"]
        kept = (self.target - ahead).clip(lower=0).clip(upper=batch["n_tokens"])
        out = batch.assign(source=key[0], start=ahead, kept=kept)[kept > 0]
        for k, doc in zip(out["key"], out["doc_id"], strict=True):
            if not pd.isna(k):
                self.keys.updateValue((k,), (int(doc),))
        if len(out):
            last = out.iloc[-1]
            self.given.update((int(last["start"] + last["kept"]), documents + len(out), int(last["n_tokens"] - last["kept"])))
        yield out.assign(tokens=[t if t is None else t[: WIDE * k] for t, k in zip(out["tokens"], out["kept"], strict=True)])[[c.split()[0] for c in CUT.split(", ")]]

    def close(self) -> None:
        pass


def budget_stream(rows: DataFrame, target: int) -> DataFrame:
    """rows: a stream of source, doc_id, key (null: no duplicate of any), n_tokens and tokens (two bytes each, or null).
    Adds start (tokens of the source before) and kept, and cuts tokens to those kept. A batch's rows of a source meet in
    one task, as an order needs; the size of batches bounds it."""
    state_store(rows.sparkSession)
    return rows.select("source", "doc_id", "key", "n_tokens", "tokens").groupBy("source").transformWithStateInPandas(statefulProcessor=Budget(target), outputStructType=CUT, outputMode="append", timeMode="none")
