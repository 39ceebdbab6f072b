"""Extractions: concept keys, parsing of model answers, and the keyed cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import concept_key, unfenced
from gleaner.schemas import ENTITIES, EVENTS

#: What an answer must look like; shown to the model.
ANSWER = '{"events": [{"event_id", "summary", "actor", "action", "modality", "trigger", "source_span"}], "entities": [{"name", "type", "aliases"}]}'


def concept_keys(extractions: DataFrame) -> DataFrame:
    """Rows (chunk_id, keys): each entity's name, then its aliases, as ordered distinct concept keys."""
    names = F.transform("entities", lambda e: F.concat(F.array(e["name"]), F.coalesce(e["aliases"], F.array().cast("array<string>"))))
    keys = F.filter(F.transform(F.flatten(names), concept_key), lambda k: k.isNotNull())
    return extractions.select("chunk_id", F.coalesce(F.array_distinct(keys), F.array().cast("array<string>")).alias("keys"))


def prompt(text: Column, document_id: Column | None = None, citation: Column | None = None) -> Column:
    """A request to extract at most one event and its entities from a chunk or a question."""
    head = F.lit("Extract at most one event (the main duty or fact) and the entities tied to it. Answer with one JSON object of this shape, nothing else:\n" + ANSWER + "\n")
    place = F.lit("") if document_id is None else F.concat(F.lit("document: "), document_id, F.lit("\ncitation: "), citation, F.lit("\n"))
    return F.concat(head, place, F.lit("text:\n"), text)


def parse(answers: DataFrame) -> DataFrame:
    """Answers (chunk_id, content) as extractions with ``error``, null where the answer is a JSON object.

    At most the first event stays; entities without a name and empty aliases go; missing
    event ids become event_<position>, missing types ``other``.
    """
    raw = F.from_json(unfenced(F.col("content")), f"events {EVENTS}, entities {ENTITIES}, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    rows = answers.withColumn("j", raw)
    bad = F.col("j").isNull() | F.col("j.__bad").isNotNull() | ~unfenced(F.col("content")).startswith("{")
    filled = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), default)
    event = lambda e, i: F.struct(
        filled(e["event_id"], F.concat(F.lit("event_"), i.cast("string"))).alias("event_id"), F.coalesce(e["summary"], F.lit("")).alias("summary"),
        *(e[c].alias(c) for c in ("actor", "action", "modality", "trigger", "source_span")),
    )
    real = F.filter(F.coalesce("j.events", F.array().cast(EVENTS)), lambda e: e.isNotNull())
    entities = F.filter(F.coalesce("j.entities", F.array().cast(ENTITIES)), lambda e: F.coalesce(e["name"], F.lit("")) != "")
    aliases = lambda e: F.filter(F.coalesce(e["aliases"], F.array().cast("array<string>")), lambda a: a.isNotNull() & (a != ""))
    tidy = F.transform(entities, lambda e: F.struct(e["name"].alias("name"), filled(e["type"], F.lit("other")).alias("type"), aliases(e).alias("aliases")))
    return rows.select(
        "chunk_id", F.when(~bad, F.slice(F.transform(real, event), 1, 1)).alias("events"), F.when(~bad, tidy).alias("entities"),
        F.when(bad, "not a JSON object").alias("error"),
    )


def upsert(cached: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Cached rows and new ones; a new row replaces the cached one of its key, none is lost."""
    return cached.join(new.select(key), key, "left_anti").unionByName(new)


def extract(chunks: DataFrame, cached: DataFrame, extract_text: Callable[[str], str]) -> DataFrame:
    """Extractions of chunks: from the cache where it has the chunk, else by the injected model, in Arrow batches.

    An answer that does not parse is an error, as in ``parse`` its row would be.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "content": [extract_text(t) for t in b["text"]]})

    missing = chunks.join(cached.select("chunk_id"), "chunk_id", "left_anti").dropDuplicates(["chunk_id"])
    answers = missing.select("chunk_id", "text").mapInPandas(run, "chunk_id string, content string")
    hits = cached.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    parsed = parse(answers)
    failed = F.raise_error(F.concat(F.lit("no extraction for "), "chunk_id", F.lit(": "), "error"))
    return hits.unionByName(parsed.withColumn("events", F.when(F.col("error").isNotNull(), failed.cast(EVENTS)).otherwise(F.col("events"))).drop("error"))
