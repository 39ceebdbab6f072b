"""Draft answers: prompts, and validation of a model's answer against its evidence."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import strip, unfenced

#: Error labels of a rejected answer.
ERRORS = ("invalid json", "not an object", "missing key", "ids not a list", "empty answer", "uncited")


class InvalidDraftError(ValueError):
    """A model's answer can't be used."""


@dataclass
class Draft:
    answer: str
    cited_chunk_ids: list[str] = field(default_factory=list)
    abstained: bool = False


def validate_rows(answers: DataFrame) -> DataFrame:
    """Answers (query_id, content, allowed) with answer, cited_chunk_ids, abstained and error, the first rule that is broken.

    A usable answer is a JSON object, fenced or not, that has an answer which is not blank
    and ``abstained``, and cites an allowed id unless it abstains.  Ids that are not allowed
    are dropped; values of other types than expected count as their text.
    """
    rows = answers.withColumn("__t", unfenced(F.coalesce("content", F.lit(""))))
    value = lambda path, kind: F.try_variant_get(F.try_parse_json("__t"), path, kind)
    rows = rows.withColumns({
        "__json": F.try_parse_json("__t").isNotNull(), "__keys": F.json_object_keys("__t"), "__ids": F.get_json_object("__t", "$.cited_chunk_ids"),
        "__answer": strip(F.coalesce(value("$.answer", "string"), F.lit(""))), "__raw": F.get_json_object("__t", "$.abstained"),
        "__text": F.schema_of_variant(value("$.abstained", "variant")) == "STRING",
    })
    no = F.col("__raw").isin("false", "0", "0.0", "[]", "{}")
    abstained = F.coalesce(F.when(F.col("__text"), F.col("__raw") != "").otherwise(~no), F.lit(False))
    listed = F.coalesce(F.from_json("__ids", "array<string>"), F.array().cast("array<string>"))
    cited = F.filter(listed, lambda i: F.array_contains(F.coalesce("allowed", F.array().cast("array<string>")), i))
    missing = ~F.array_contains("__keys", "answer") | ~F.array_contains("__keys", "abstained")
    rules = (~F.col("__json"), F.col("__keys").isNull(), missing, ~F.col("__ids").startswith("["), F.col("__answer") == "", (F.size(cited) == 0) & ~abstained)
    error = F.coalesce(*(F.when(F.coalesce(rule, F.lit(False)), label) for rule, label in zip(rules, ERRORS, strict=True)))
    good = lambda c, name: F.when(F.col("error").isNull(), c).alias(name)
    return rows.withColumn("error", error).select("query_id", good(F.col("__answer"), "answer"), good(cited, "cited_chunk_ids"), good(abstained, "abstained"), "error")


def parse(content: str, allowed: Sequence[str]) -> Draft:
    """One model answer as a draft; InvalidDraftError names the rule that it breaks."""
    rows = SparkSession.active().createDataFrame([(0, content, sorted(allowed))], "query_id int, content string, allowed array<string>")
    got = validate_rows(rows).first()
    if got["error"]:
        raise InvalidDraftError(got["error"])
    return Draft(got["answer"], got["cited_chunk_ids"], got["abstained"])


def known_ids(rows: DataFrame) -> DataFrame:
    """Rows (query_id, cited, allowed) with the cited ids that are allowed, and those that are not, in order, repeats kept."""
    return rows.select("query_id", F.filter("cited", lambda c: F.array_contains("allowed", c)).alias("known"), F.filter("cited", lambda c: ~F.array_contains("allowed", c)).alias("unknown"))


#: Chunks that an answer without citations is taken to rest on.
FIRST = 5


def cited_or_first(cited: Sequence[str], abstained: bool, allowed: Sequence[str]) -> list[str]:
    """The cited ids, or the first of the evidence where an answer cites none and does not abstain."""
    return list(cited) or ([] if abstained else list(allowed[:FIRST]))


def default_citations(rows: DataFrame) -> DataFrame:
    """Rows (query_id, cited_chunk_ids, abstained, allowed) with the citations that the answer is shown with."""
    none = F.size(F.coalesce("cited_chunk_ids", F.array().cast("array<string>"))) == 0
    return rows.withColumn("cited_chunk_ids", F.when(none & ~F.col("abstained"), F.slice("allowed", 1, FIRST)).when(none, F.array().cast("array<string>")).otherwise(F.col("cited_chunk_ids")))


def prompt(query: str, evidence: str) -> str:
    return (
        "Bạn là trợ lý pháp lý. Chỉ dựa vào bằng chứng dưới đây, trả lời bằng tiếng Việt, nêu kết luận, điều kiện chính và trích dẫn.\n"
        'Chỉ trả về một JSON: {"answer": chuỗi, "cited_chunk_ids": [chunk_id đã dùng], "abstained": true nếu bằng chứng không đủ}.\n\n'
        f"Câu hỏi: {query}\n\nBằng chứng:\n{evidence}\n"
    )


#: A prompt's answer as text, or a draft, which is taken as it is.
Generate = Callable[[str], "str | Draft"]
#: Model families that name the answer's length limit max_completion_tokens.
COMPLETION_KIND = ("gpt-5", "o1", "o3", "o4")


def length_limit(model: str, tokens: int = 1200) -> dict[str, int]:
    return {"max_completion_tokens" if model.lower().startswith(COMPLETION_KIND) else "max_tokens": tokens}
