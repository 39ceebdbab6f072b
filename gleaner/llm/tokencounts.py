"""Token counts: rollups kept by signed deltas.

A change (op insert, delete or revise, doc_id, source, lang, text) becomes signed
contributions: an insert adds its counts, a delete takes the ledger's counts back, and
a revision does both.  Contributions are summed by (source, lang, tokenizer) before
they are stored, so a rollup is the sum over batches and never rescans documents.

The store is a folder.  ``data/<unique>/ledger`` has the counts each document has from a
batch on, ``data/<unique>/delta`` the summed contributions, and ``commits/<number>``,
created last and never overwritten, says that they count: its number is the batch's place
in the order, its text the batch id and the folder.  Committing an id again does nothing;
what a lost driver left has no commit and is never read; of two drivers that commit at
once, one gets the number and the other starts again from what is then there.  ``compact``
commits the live ledger and the totals as one, so later batches read only what came after.

Defined results: a null text has no tokens; null source or lang is a group of its own;
an insert of a document that the ledger has revises it; a delete of an unknown document
changes nothing; of several changes to a document in one batch the last ``seq`` counts
(ties: inserts and revisions over deletes, then the larger text, source and lang);
changes with null doc_id are counted by insert only and can't be revised.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import Words, slices, text_bytes
from .shared import Scratch, fresh_dir
from .tokenbits import ENCODE_BYTES, WordEncoder

#: Version label of the plain word count.
WORDS = "words-1"
#: One in PARTS documents is revised, and one in PARTS deleted, before they are restored.
PARTS = 16
KEYS = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, source string, lang string, tokenizer string, n_tokens long, live boolean"
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(rows: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """rows without text but with (tokenizer, n_tokens), a row for each version; a path of "" counts words."""
    keep = [c for c in rows.columns if c != "text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = words = None
        for batch in batches:
            for part in slices(batch, most=ENCODE_BYTES):
                if encoders is None:
                    encoders = {k: WordEncoder(p) for k, p in tokenizers.items() if p}
                    words = Words(lower=False)
                for version in tokenizers:
                    if version in encoders:
                        n = encoders[version].counts(part.column("text"))
                    else:
                        n = np.diff(words.spans(*text_bytes(part.column("text")))[2])
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([version] * len(n), pa.string()), pa.array(n.astype(np.int64))], [*keep, "tokenizer", "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(count, f"{fields}, tokenizer string, n_tokens long")


class Rollup:
    """Totals of documents and tokens by source, language and tokenizer version."""

    def __init__(self, spark: SparkSession, folder: str, tokenizers: dict[str, str]):
        self.spark, self.folder, self.tokenizers = spark, folder, tokenizers

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _commits(self) -> list[dict]:
        """What is committed, in order: {number, batch, data, covers}; a number without text counts for nothing."""
        fs, top, out = self._fs(), self._path("commits"), []
        if not fs.exists(top):
            return out
        for status in sorted(fs.listStatus(top), key=lambda s: s.getPath().getName()):
            stream = fs.open(status.getPath())
            text = bytes(stream.readAllBytes()).decode()
            stream.close()
            out.append({"number": int(status.getPath().getName()), **(json.loads(text) if text else {"batch": None, "data": None, "covers": None})})
        return out

    def batches(self) -> list[str]:
        """Committed batch ids in order of commit."""
        return [b for c in self._live() for b in ([c["batch"]] if c["covers"] is None else c["covers"])]

    def _live(self) -> list[dict]:
        """The last compaction, if any, and the batches after it."""
        commits = [c for c in self._commits() if c["data"]]
        last = max((i for i, c in enumerate(commits) if c["covers"] is not None), default=0)
        return commits[last:]

    def _claim(self, number: int, batch: str | None, data: str, covers: list[str] | None) -> bool:
        """Create the commit of this number; False if it is there already."""
        fs, path = self._fs(), self._path("commits", f"{number:012d}")
        fs.mkdirs(self._path("commits"))
        try:
            stream = fs.create(path, False)
        except Py4JJavaError:
            return False
        stream.write(bytearray(json.dumps({"batch": batch, "data": data, "covers": covers}).encode()))
        stream.close()
        return True

    def _read(self, kind: str, schema: str, commits: list[dict]) -> DataFrame:
        out = self.spark.createDataFrame([], f"{schema}, at int")
        for i, c in enumerate(commits):
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.folder}/data/{c['data']}/{kind}").withColumn("at", F.lit(i)))
        return out

    def _ledger(self, commits: list[dict], changed: DataFrame | None = None) -> DataFrame:
        rows = self._read("ledger", LEDGER, commits).where("doc_id is not null")
        if changed is not None:
            rows = rows.join(changed, "doc_id", "left_semi")  # first, so only what changes is grouped
        last = rows.groupBy("doc_id", "tokenizer").agg(F.max(F.struct("at", "live", "n_tokens", "source", "lang")).alias("r"))
        return last.select("doc_id", "r.source", "r.lang", "tokenizer", "r.n_tokens", "r.live").where("live")

    def ledger(self) -> DataFrame:
        """The live counts of each document with an id."""
        return self._ledger(self._live()).drop("live")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes (seq, op, doc_id, source, lang, text) once; False if the batch is there already."""
        if batch in self.batches():
            return False
        at = uuid.uuid4().hex
        scratch = Scratch(self.spark)
        changes = changes.select(F.col("seq").cast("long"), "op", F.col("doc_id").cast("long"), "source", "lang", "text")
        named = scratch.cut(count_tokens(changes.withColumn("text", F.when(F.col("op") != "delete", F.col("text"))), self.tokenizers))
        order = F.struct("seq", (F.col("op") != "delete").alias("live"), "n_tokens", "source", "lang")
        last = named.where("doc_id is not null").groupBy("doc_id", "tokenizer").agg(F.max(order).alias("r"))
        new = last.select("doc_id", "r.source", "r.lang", "tokenizer", "r.n_tokens", "r.live")
        new = new.unionByName(named.where("doc_id is null and op = 'insert'").select("doc_id", "source", "lang", "tokenizer", "n_tokens", F.lit(True).alias("live")))
        new.write.parquet(f"{self.folder}/data/{at}/ledger")
        scratch.clear()
        new = self.spark.read.schema(LEDGER).parquet(f"{self.folder}/data/{at}/ledger")
        plus = new.where("live").select(*KEYS, F.lit(1).alias("n_docs"), "n_tokens")
        while True:
            commits = self._commits()
            if batch in self.batches():
                return False
            old = self._ledger(self._live(), new.where("doc_id is not null").select("doc_id").distinct())
            signed = plus.unionByName(old.select(*KEYS, F.lit(-1).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))) if commits else plus
            delta = signed.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            delta.where("n_docs != 0 or n_tokens != 0").write.mode("overwrite").parquet(f"{self.folder}/data/{at}/delta")
            if self._claim(commits[-1]["number"] + 1 if commits else 0, batch, at, None):
                return True

    def compact(self) -> bool:
        """Commit the live ledger and totals as one, for all batches so far; False if another commit came between."""
        commits, at = self._commits(), uuid.uuid4().hex
        if not commits:
            return False
        live = self._live()
        kept = self._ledger(live).select(*(f.split()[0] for f in LEDGER.split(", ")))
        kept.write.parquet(f"{self.folder}/data/{at}/ledger")
        self._totals(live).write.parquet(f"{self.folder}/data/{at}/delta")
        return self._claim(commits[-1]["number"] + 1, None, at, self.batches())

    def _totals(self, commits: list[dict]) -> DataFrame:
        return self._read("delta", DELTA, commits).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """Rows (source, lang, tokenizer, n_docs, n_tokens) with at least one document."""
        return self._totals(self._live()).where("n_docs != 0")


def changes(docs: DataFrame, op: str, text: Column | None = None) -> DataFrame:
    return docs.select(F.lit(0).alias("seq"), F.lit(op).alias("op"), "doc_id", "source", "lang", (F.col("text") if text is None else text).alias("text"))


def token_totals(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """Totals after all docs are loaded, one PART of them is revised and another deleted, both are restored, and batches are replayed.

    The totals are those of all documents; they are reached through signed deltas.
    """
    rollup = Rollup(docs.sparkSession, fresh_dir(docs.sparkSession, "rollup"), tokenizers)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    some, others = docs.where("doc_id is not null").where(part == 0), docs.where("doc_id is not null").where(part == 1)
    rollup.commit("load", changes(docs, "insert"))
    rollup.commit("revise", changes(some, "revise", F.expr("substr(text, 1, length(text) div 2)")))
    rollup.commit("delete", changes(others, "delete"))
    rollup.compact()
    rollup.commit("restore", changes(some, "revise").unionByName(changes(others, "insert")))
    for batch in ("load", "delete"):
        rollup.commit(batch, changes(docs, "delete"))
    return rollup.totals()
