"""Query facade: one answer with or without expansion, and a budget-matched comparison.

Models are injected: an encoder of the query, a reranker of a hit list and a generator.
What they see is a list of tens of chunks; everything before stays in DataFrames.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import dense, drafts, entities, evidence, expand, extract, fusion, lexical, numbering, orgs
from gleaner.operators.chat import UnavailableError
from gleaner.sources import corpus as dumps
from gleaner.sources import stores
from gleaner.storage import work_dir, written

ABSTAIN = "Câu hỏi trống."
NO_EVIDENCE = "Không tìm thấy bằng chứng để trả lời."
#: Least similarity of stored edges, when they are built and when they are walked.
MIN_SIM = 0.6


def status_of(error: Exception | None) -> int:
    """The HTTP status that a service gives for the outcome of a query."""
    if error is None:
        return 200
    return 422 if isinstance(error, drafts.InvalidDraftError) else 503 if isinstance(error, UnavailableError | FileNotFoundError) else 500


@dataclass
class Corpus:
    """Warm tables: chunks (each chunk_id once, with seq), lexical index, vectors (id, seq, embedding), keys, edges, titles, organisations."""

    chunks: DataFrame
    index: lexical.LexicalIndex
    vectors: DataFrame
    keys: DataFrame
    edges: DataFrame | None
    titles: DataFrame
    catalog: DataFrame
    org_docs: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.chunks.sparkSession

    def counts(self) -> dict[str, int]:
        return {"events": self.chunks.count(), "entities": self.keys.select("key").distinct().count()}


@dataclass
class Models:
    """Injected models.  ``generate`` gives an answer's text, which is validated, or a draft, which is taken as it is;
    ``retrieve`` (query, corpus) gives the evidence's chunk_ids in order, in place of retrieval, rerank and expansion."""

    encode: Callable[[str], Sequence[float]]
    generate: drafts.Generate
    rerank: fusion.Reranker | None = None
    concepts: Callable[[str], list[str]] | None = None
    retrieve: Callable[[str, Corpus], Sequence[str]] | None = None


@dataclass
class Budget:
    """Depths of a query; ``literal`` drafts from 10 chunks at most, so organisation chunks may be cut."""

    hybrid_k: int = 20
    rerank_k: int = 5
    extra: int = 10
    hops: int = 1
    min_sim: float = MIN_SIM
    max_org: int = orgs.MAX_ORG
    rag_k: int | None = None
    literal: bool = False


@dataclass
class Result:
    answer: str
    cited: list[Row] = field(default_factory=list)
    abstained: bool = False
    stats: dict[str, int] = field(default_factory=dict)
    arm: str = ""


def build(chunks: DataFrame, vectors: DataFrame, titles: DataFrame, catalog: DataFrame, concepts: DataFrame | None = None, edges: DataFrame | None = None, org_docs: DataFrame | None = None) -> Corpus:
    """A corpus from chunks (repeats of a chunk_id dropped) and vectors (chunk_id, embedding); a chunk without vector is a KeyError."""
    once = written(entities.events(chunks))
    lost = dense.missing(once.select(F.col("chunk_id").alias("id"), "seq"), vectors.select(F.col("chunk_id").alias("id"))).orderBy("seq").limit(5).collect()
    if lost:
        raise KeyError(f"chunks without a vector: {[r['id'] for r in lost]}, and maybe more")
    index = lexical.save(lexical.build(once), f"{work_dir(once.sparkSession)}/bm25-{uuid.uuid4().hex}")
    own = once.select(F.col("chunk_id").alias("id"), "seq").join(vectors.select(F.col("chunk_id").alias("id"), "embedding"), "id")
    return Corpus(once, index, written(own), written(entities.key_rows(once, concepts)), edges, titles, catalog, org_docs)


def load(spark: SparkSession, path: str, vector_path: str, make: Callable[[], stores.Encode], catalog: DataFrame, extraction_path: str | None = None, edges: bool = True, org_docs: DataFrame | None = None) -> Corpus:
    """A warm corpus from a JSON dump: ingested, encoded unless the vectors of these chunks are stored, with edges and the concepts of an extraction cache."""
    if not dumps._exists(spark, path):
        raise UnavailableError(f"no corpus at {path}")
    docs, chunks = dumps.ingest(spark, path, all_docs=True)
    chunks = written(chunks)
    vectors = stores.cached_vectors(chunks, vector_path, make)
    concepts = extract.concept_keys(stores.load_extractions(spark, extraction_path)) if extraction_path else None
    near = None
    if edges:
        by_id = vectors.select(F.col("chunk_id").alias("id"), "seq", "embedding").dropDuplicates(["id"])
        near = written(dense.semantic_edges(by_id, min_sim=MIN_SIM))
    return build(chunks, vectors.dropDuplicates(["chunk_id"]), docs.select("document_id", "title"), catalog, concepts, near, org_docs)


def retrieve(corpus: Corpus, query: str, models: Models, budget: Budget, depth: int) -> DataFrame:
    """The reranked hits (chunk_id, ord), depth at most."""
    hits = fusion.hybrid(corpus.index, corpus.vectors, query, models.encode(query), budget.hybrid_k)
    texts = corpus.chunks.select(F.col("chunk_id").alias("id"), "text").join(F.broadcast(hits), "id")
    ranked = fusion.rerank(query, texts, depth, models.rerank) if models.rerank else fusion.rerank_lexical(query, texts, depth)
    return written(ranked.select(F.col("id").alias("chunk_id"), F.col("rank").cast("long").alias("ord")))


def with_concepts(corpus: Corpus, query: str, seeds: DataFrame, models: Models) -> DataFrame:
    """Seeds, then all chunks that hold one of the query's concepts (chunk_id, ord)."""
    keys = models.concepts(query) if models.concepts else []
    if not keys:
        return seeds
    return joined_seeds(seeds, entities.lookup_by_concepts(entities.query_key_rows(corpus.spark, keys), corpus.keys))


def joined_seeds(seeds: DataFrame, found: DataFrame) -> DataFrame:
    """Seeds (chunk_id, ord), then what concepts found (chunk_id, ord with pos and seq) besides: (chunk_id, ord)."""
    zero = F.lit(0).cast("long")
    first = seeds.select("chunk_id", F.struct(zero.alias("src"), F.col("ord").cast("long").alias("at"), zero.alias("seq")).alias("o"))
    more = found.select("chunk_id", F.struct(F.lit(1).cast("long").alias("src"), F.col("ord.pos").cast("long").alias("at"), F.col("ord.seq").cast("long").alias("seq")).alias("o"))
    both = first.unionByName(more).groupBy("chunk_id").agg(F.min("o").alias("o"))
    return numbering.numbered(both, "o", "chunk_id").select("chunk_id", (F.col("n") + 1).alias("ord"))


def lexical_order(rows: DataFrame, *keys: str) -> DataFrame:
    from pyspark.sql import Window

    return rows.select("chunk_id", F.row_number().over(Window.orderBy(*keys, "chunk_id")).cast("long").alias("ord"))


def _sources(corpus: Corpus, query: str) -> tuple[DataFrame | None, str]:
    """Organisation chunks for the query, or the question that clarifies which is meant."""
    named = orgs.resolve(corpus.spark.createDataFrame([(0, query)], "query_id long, query string"), corpus.catalog)
    rows = named.select("needs_clarify", "clarify_prompt", "org_id").collect()  # at most the catalog
    if any(r["needs_clarify"] for r in rows):
        return None, rows[0]["clarify_prompt"]
    if not rows or corpus.org_docs is None:
        return None, ""
    return orgs.org_chunks(corpus.org_docs.join(named.select("org_id"), "org_id", "left_semi")), ""


def _finish(corpus: Corpus, query: str, picked: DataFrame, seeds: DataFrame, org: DataFrame | None, models: Models, budget: Budget, most: int, arm: str) -> Result:
    merged = orgs.merge_evidence(picked, org, budget.max_org) if org is not None else picked.select("chunk_id", F.lit(0).alias("part"), "ord")
    columns = ["chunk_id", "document_id", "article", "clause", "point", "effective_date", "text"]
    texts = corpus.chunks.select(*columns)
    if org is not None:
        texts = texts.unionByName(org.select("chunk_id", "document_id", "text"), allowMissingColumns=True)
    listed = written(texts.join(F.broadcast(lexical_order(merged, "part", "ord")), "chunk_id"))
    n, n_seeds = listed.count(), seeds.count()
    stats = {"seed_count": n_seeds, "context_count": n, "added_count": max(0, n - n_seeds)}
    if not n:
        return Result(NO_EVIDENCE, abstained=True, stats=stats, arm=arm)
    chosen = written(evidence.select(listed, seeds, most))
    text = evidence.formatted(chosen).first()["evidence"]
    allowed = [r["chunk_id"] for r in chosen.orderBy("pick").select("chunk_id").collect()]
    said = models.generate(drafts.prompt(query, text))
    draft = said if isinstance(said, drafts.Draft) else drafts.parse(said, allowed)
    cited = drafts.cited_or_first(draft.cited_chunk_ids, draft.abstained, allowed)
    wanted = corpus.spark.createDataFrame([(c, i) for i, c in enumerate(cited)], "chunk_id string, pos int")
    return Result(draft.answer, evidence.cards(wanted, listed, corpus.titles).orderBy("pos").collect(), draft.abstained, stats, arm)


def answer(corpus: Corpus, query: str, models: Models, mode: str = "expanded", budget: Budget | None = None) -> Result:
    """An answer in mode ``expanded`` (seeds, concepts, expansion) or ``plain`` (retrieval only, as deep as both)."""
    budget, query = budget or Budget(), query.strip()
    if not query:
        return Result(ABSTAIN, abstained=True, arm=mode)
    plain = mode == "plain"
    depth = (budget.rag_k or budget.rerank_k + budget.extra) if plain else budget.rerank_k
    if models.retrieve:
        picked = _given(corpus, models.retrieve(query, corpus))
        seeds = picked.where(F.col("ord") <= depth)
    else:
        seeds = retrieve(corpus, query, models, budget, depth)
        if plain:
            picked = seeds
        else:
            seeds = written(with_concepts(corpus, query, seeds, models))
            picked = _expanded(corpus, seeds, budget)
    org, ask = _sources(corpus, query)
    if ask:
        return Result(ask, abstained=True, stats={"seed_count": seeds.count(), "context_count": picked.count(), "added_count": 0}, arm=mode)
    most = evidence.MAX_EVIDENCE if budget.literal else budget.rerank_k + budget.extra + budget.max_org
    return _finish(corpus, query, picked, seeds, org, models, budget, most, mode)


def _given(corpus: Corpus, ids: Sequence[str]) -> DataFrame:
    rows = corpus.spark.createDataFrame([(c, i) for i, c in enumerate(dict.fromkeys(ids), 1)], "chunk_id string, ord long")
    return rows.join(corpus.chunks.select("chunk_id"), "chunk_id", "left_semi")


def _expanded(corpus: Corpus, seeds: DataFrame, budget: Budget) -> DataFrame:
    found = expand.expand(seeds, corpus.chunks, budget.extra, budget.hops, corpus.keys, corpus.edges, budget.min_sim)
    return written(lexical_order(found, "hop", "ord"))


def compare(corpus: Corpus, query: str, models: Models, budget: Budget | None = None) -> list[Result]:
    """Both arms over one retrieval and one rerank, with the same budget of chunks; plain first."""
    budget, query = budget or Budget(), query.strip()
    if not query:
        return [Result(ABSTAIN, abstained=True, arm=a) for a in ("plain", "expanded")]
    size = budget.rag_k or budget.rerank_k + budget.extra
    hits = retrieve(corpus, query, models, budget, max(size, budget.rerank_k))
    org, ask = _sources(corpus, query)
    if ask:
        return [Result(ask, abstained=True, arm=a) for a in ("plain", "expanded")]
    plain, seeds = hits.where(F.col("ord") <= size), hits.where(F.col("ord") <= budget.rerank_k)
    most = size + budget.max_org
    grown = written(with_concepts(corpus, query, seeds, models))
    return [
        _finish(corpus, query, plain, plain, org, models, budget, most, "plain"),
        _finish(corpus, query, _expanded(corpus, grown, budget), grown, org, models, budget, most, "expanded"),
    ]


def arm(result: Result) -> dict:
    """A result as the plain data of an API answer."""
    label = {"expanded": "with expansion", "plain": "without expansion"}.get(result.arm, result.arm)
    return {"label": label, "answer": result.answer, "abstained": result.abstained, "cited": [r.asDict() for r in result.cited], "stats": result.stats}
