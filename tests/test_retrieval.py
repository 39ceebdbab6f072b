"""Behaviour of the retrieval operators on small hand-made inputs."""

import json
import random
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import chunking, dense, drafts, entities, evidence, expand, extract, fusion, lexical, metrics, orgs
from gleaner.plans import engine
from gleaner.sources import corpus, stores

LAW = """LUẬT MẪU

Điều 1. Phạm vi
Luật này quy định.
Điều 2. Giải thích
1. Khoản một:
a) điểm a;
đ) điểm đ.
2. Khoản hai.
Điều 3a. Không có khoản
a) không tách điểm này.
"""


@pytest.mark.parametrize("name", ["Straße", "STRASSE", "ΟΔΟΣ", "ﬁn", "Công Ty", "É", "ſ", "µϐϑǰΐ", "ꭰᏸ", "ᾳ𝒳ß𐐀"])
def test_entity_names_fold_case(spark, name):
    assert spark.createDataFrame([(f" {name}\t x",)], "c string").select(text.entity_name(F.col("c"))).first()[0] == f"{name.casefold()} x"


def docs(spark, *contents):
    return spark.createDataFrame([(i, f"L{i}", c) for i, c in enumerate(contents)], "seq long, document_id string, content string")


def test_chunk_levels(spark):
    rows = chunking.numbered(chunking.chunk_documents(docs(spark, LAW, "no headings", "  \n "))).orderBy("seq").collect()
    assert [r["chunk_id"] for r in rows] == [
        "L0::body", "L0::Điều1", "L0::Điều2", "L0::Điều2::Khoản1", "L0::Điều2::Khoản1::Điểma", "L0::Điều2::Khoản1::Điểmđ", "L0::Điều2::Khoản2", "L0::Điều3a", "L1::body",
    ]
    assert rows[7]["point"] is None and "không tách" in rows[7]["text"]


@pytest.mark.parametrize(("content", "expected"), [
    ("Luật này có hiệu lực thi hành từ ngày 01 tháng 07 năm 2024.", date(2024, 7, 1)),
    ("LUẬT NÀY CÓ HIỆU LỰC THI HÀNH TỪ NGÀY 1 tháng 7 năm 2024.", date(2024, 7, 1)),
    ("Luật này có hiệu lực thi hành từ ngày 31 tháng 2 năm 2024.", None),
    ("Luật này có hiệu lực thi hành từ ngày 1 tháng 7 năm 2024. Luật này có hiệu lực thi hành từ ngày 2 tháng 7 năm 2024.", None),
    ("Nghị định này có hiệu lực thi hành từ ngày 1 tháng 7 năm 2024", None),
    ("", None),
])
def test_effective_date(spark, content, expected):
    assert spark.createDataFrame([(content,)], "c string").select(text.effective_date(F.col("c"))).first()[0] == expected


@pytest.mark.parametrize("s", ["", "Điều 1, khoản 2!", "a_b c-d", " x y z", "Mixed ÉCOLE 12a"])
def test_tokens(spark, s):
    import re

    expected = re.sub(r"[^\s\w]", " ", s.lower()).split()
    assert spark.createDataFrame([(s,)], "c string").select(text.tokens(F.col("c"))).first()[0] == expected


def test_names_and_fences(spark):
    row = spark.createDataFrame([("  Đơn  VỊ\tkế toán ", "```json\n{\"a\": 1}\n```")], "n string, f string").select(text.concept_key(F.col("n")), text.unfenced(F.col("f"))).first()
    assert tuple(row) == ("concept::đơn vị kế toán", '{"a": 1}')


def corpus_file(tmp_path, rows):
    path = tmp_path / "corpus.json"
    path.write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    return f"file://{path}"


def test_corpus(spark, tmp_path):
    rows = [{"id": "a", "title": "", "type": " LAW ", "content": LAW}, 3, {"id": "b", "content": "  "}, {"id": "a", "content": "again"}, {"id": "c", "title": "T", "type": "code", "content": "x"}]
    path = corpus_file(tmp_path, rows)
    read = corpus.read_corpus(spark, path)
    assert [r["id"] for r in corpus.usable(read).orderBy("seq").collect()] == ["a", "c"]
    found, chunks = corpus.ingest(spark, path, ids=["c", "a"])
    assert [(r["document_id"], r["title"], r["document_type"]) for r in found.orderBy("seq").collect()] == [("c", "T", "other"), ("a", "a", "other")]
    assert [r["chunk_id"] for r in chunks.orderBy("seq").collect()] == ["c::body", "a::body"]
    assert corpus.ingest(spark, path, all_docs=True)[1].count() == 2  # of an id the last row's content
    (tmp_path / "broken.json").write_text('[{"id": "a"}, oops', encoding="utf-8")
    with pytest.raises(ValueError):
        corpus.read_corpus(spark, f"file://{tmp_path}/broken.json")
    with pytest.raises(KeyError):
        corpus.keyed_select(read, ["a", "zz"])
    with pytest.raises(ValueError):
        corpus.ingest(spark, path, ids=["a"], all_docs=True)
    with pytest.raises(ValueError):
        corpus.ingest(spark, path, ids=["b"])
    with pytest.raises(FileNotFoundError):
        corpus.read_corpus(spark, f"file://{tmp_path}/none.json")
    with pytest.raises(ValueError):
        corpus.read_corpus(spark, corpus_file(tmp_path, {"id": "a"}))


def test_bm25_by_hand(spark):
    import math

    texts = ["a b b c", "a c", "d", "a"]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "chunk_id long, seq long, text string")
    got = {r["id"]: r["score"] for r in lexical.top_k(lexical.build(rows), "b d d", 4).collect()}
    words = [t.split() for t in texts]
    df = {w: sum(w in t for t in words) for w in "abcd"}
    raw = {w: math.log(4 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / 4 for w, x in raw.items()}
    mean = sum(map(len, words)) / 4
    expected = [sum(idf[q] * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for q in "bdd") for t in words]
    assert got == pytest.approx(dict(enumerate(expected)))
    assert lexical.top_k(lexical.build(rows), "?!", 4).count() == 0 == lexical.top_k(lexical.build(rows), "a", 0).count()


def test_fusion_ties_and_ranks(spark):
    a = spark.createDataFrame([("x", 1, 1), ("y", 2, 2)], "id string, seq long, rank int")
    b = spark.createDataFrame([("y", 2, 1), ("z", 3, 2), ("x", 1, 2)], "id string, seq long, rank int")
    got = fusion.top_k(fusion.fuse(a, b), 3).orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 9)) for r in got] == [("x", round(1 / 61 + 1 / 62, 9)), ("y", round(1 / 61 + 1 / 62, 9)), ("z", round(1 / 62, 9))]
    assert fusion.pool_size(5) == 200 and fusion.pool_size(20) == 400 and fusion.pool_size(5, 2) == 5


def test_near_duplicate_frees_a_slot(spark):
    v = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [1.0, 0.001]), ("c", 2, [0.8, 0.6]), ("z", 3, [0.0, 0.0])], "id string, seq long, embedding array<double>")
    got = dense.semantic_edges(v, top_n=1, min_sim=0.6, max_sim=0.99).where("src = 'a'").collect()
    assert [(r["dst"], round(r["sim"], 6)) for r in got] == [("c", 0.8)]


def chunk_rows(spark, rows):
    return spark.createDataFrame([(r[0], i, *r[1:]) for i, r in enumerate(rows)], "chunk_id string, seq long, document_id string, article string, clause string, point string")


def test_kinship_reaches_a_deep_clause_first(spark):
    rows = [("d::A", "d", "A", None, None)] + [(f"d::A::{n}", "d", "A", f"K{n}", None) for n in range(1, 40)] + [("d::A::30::a", "d", "A", "K30", "a"), ("d::A::30::b", "d", "A", "K30", "b")]
    chunks = chunk_rows(spark, rows)
    seeds = spark.createDataFrame([("d::A::30::a", 1)], "chunk_id string, ord int")
    got = expand.expand(seeds, chunks, max_extra=3).orderBy("hop", "ord").collect()
    assert [r["chunk_id"] for r in got] == ["d::A::30::a", "d::A", "d::A::30", "d::A::30::b"]


def model_expand(seeds, chunks, keys, edges, most, hops):
    """The definition, one candidate at a time."""
    by = {c[0]: (n, *c[1:]) for n, c in enumerate(chunks)}
    seen, extras, frontier = set(seeds), [], list(seeds)
    for _ in range(hops):
        lists = []
        for cid in frontier:
            n, doc, art, cl, _ = by[cid]
            kin = [(0 if b[3] is None and b[4] is None else 1 if b[3] == cl and b[4] is None else 2 if b[3] == cl else 3, b[0], i) for i, b in by.items() if art and b[1:3] == (doc, art)]
            one = [i for *_, i in sorted(kin)]
            shared = []
            for k in keys.get(cid, []):
                shared += [i for i in by if k in keys.get(i, []) and i not in shared]
            lists.append(one + shared + [d for d, _ in edges.get(cid, [])])
        new = []
        for column in range(max(map(len, lists), default=0)):
            for one in lists:
                if column < len(one) and one[column] not in seen and len(extras) < most and one[column] in by:
                    seen.add(one[column])
                    extras.append(one[column])
                    new.append(one[column])
        if not new:
            break
        frontier = new
    return list(seeds) + extras


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hops", [1, 2])
def test_expand_equals_the_definition(spark, seed, hops):
    rng = random.Random(seed)
    chunks = [(f"c{i:02}", f"d{rng.randrange(3)}", rng.choice(["A", "B", None]), rng.choice([None, "K1", "K2"]), rng.choice([None, "a"])) for i in range(24)]
    keys = {c[0]: [f"concept::{k}" for k in rng.sample(range(6), rng.randrange(3))] for c in chunks}
    edges = {c[0]: [(d, 0.9 - i / 10) for i, d in enumerate(rng.sample([x[0] for x in chunks if x[0] != c[0]] + ["gone"], 2))] for c in chunks}
    seeds = rng.sample([c[0] for c in chunks], 3)
    concepts = spark.createDataFrame(list(keys.items()), "chunk_id string, keys array<string>")
    table = chunk_rows(spark, chunks)
    links = spark.createDataFrame([(a, d, s, r) for a, ds in edges.items() for r, (d, s) in enumerate(ds, 1)], "src string, dst string, sim double, rank int")
    start = spark.createDataFrame([(c, i) for i, c in enumerate(seeds)], "chunk_id string, ord int")
    got = expand.expand(start, table, 7, hops, entities.key_rows(table, concepts), links).orderBy("hop", "ord").collect()
    assert [r["chunk_id"] for r in got] == model_expand(seeds, chunks, keys, edges, 7, hops)


def test_lookup_and_merge(spark):
    table = chunk_rows(spark, [("x", "d", "A", None, None), ("y", "d", "A", "K", None), ("z", "e", None, None, None)])
    keys = entities.key_rows(table, spark.createDataFrame([("z", ["concept::q", "concept::p"]), ("x", ["concept::p"])], "chunk_id string, keys array<string>"))
    found = entities.lookup_by_concepts(entities.query_key_rows(spark, ["law::d", "concept::p", "concept::q"]), keys).orderBy("ord").collect()
    assert [r["chunk_id"] for r in found] == ["x", "z"]
    index = {r["key"]: r["chunk_ids"] for r in entities.inverted_index(keys).collect()}
    assert index["art::d::A"] == ["x", "y"] and "cls::d::A::K" in index


def test_orgs(spark, tmp_path):
    catalog = orgs.catalog(spark)
    ask = lambda q: orgs.resolve(spark.createDataFrame([(1, q)], "query_id long, query string"), catalog).orderBy("seq").collect()
    assert [r["org_id"] for r in ask("thông tin TÍN VIỆT?")] == ["VCC"]
    both = ask("vietcredit hay waka")
    assert [r["needs_clarify"] for r in both] == [True, True] and both[0]["clarify_prompt"].endswith("Waka?")
    assert not ask("không có ai")
    folder = tmp_path / "org" / "VCC"
    folder.mkdir(parents=True)
    (folder / "b.md").write_text("hai", encoding="utf-8")
    (folder / "a.md").write_text("một", encoding="utf-8")
    named = orgs.resolve(spark.createDataFrame([(1, "VietCredit")], "query_id long, query string"), catalog)
    found = corpus.read_org_docs(spark, f"file://{tmp_path}/org", named)
    assert [tuple(r) for r in found.collect()] == [("VCC", "a", "một"), ("VCC", "b", "hai")]
    assert orgs.org_chunks(found).orderBy("ord").first()["chunk_id"] == "org:VCC:a::body"
    assert corpus.read_org_docs(spark, f"file://{tmp_path}/none", named).count() == 0


GOOD = {"answer": "có", "cited_chunk_ids": ["a", "x"], "abstained": False}


@pytest.mark.parametrize(("content", "error"), [
    (json.dumps(GOOD), None), ("```json\n" + json.dumps(GOOD) + "\n```", None), ('{"answer": ', "invalid json"), ("[1]", "not an object"),
    ('{"answer": "x"}', "missing key"), (json.dumps(GOOD | {"cited_chunk_ids": "a"}), "ids not a list"), (json.dumps(GOOD | {"answer": " "}), "empty answer"),
    (json.dumps(GOOD | {"cited_chunk_ids": ["x"]}), "uncited"), (json.dumps(GOOD | {"cited_chunk_ids": [], "abstained": True}), None),
])
def test_draft_validation(spark, content, error):
    rows = spark.createDataFrame([(1, content, ["a", "b"])], "query_id long, content string, allowed array<string>")
    got = drafts.validate_rows(rows).first()
    assert got["error"] == error
    if error:
        with pytest.raises(drafts.InvalidDraftError):
            drafts.parse(content, {"a", "b"})
    else:
        assert got["answer"] == "có" and got["cited_chunk_ids"] == ([] if got["abstained"] else ["a"])


def test_evidence_tiers(spark):
    rows = [("h", "d", "A", None, None), ("other", "e", "B", None, None), ("k2", "d", "A", "K2", None), ("k1", "d", "A", "K1", None), ("p", "d", "A", "K1", "a"), ("s", "f", "C", "K9", None), ("f2", "f", "C", "K8", None)]
    table = chunk_rows(spark, rows).withColumn("ord", F.col("seq"))
    seeds = spark.createDataFrame([("p",), ("s",)], "chunk_id string")
    pick = lambda n: [r["chunk_id"] for r in evidence.select(table, seeds, n).orderBy("pick").collect()]
    assert pick(6) == ["p", "s", "k1", "h", "k2", "f2"]
    assert pick(7) == [r[0] for r in rows] and pick(0) == []
    assert [r["chunk_id"] for r in evidence.select(table, None, 2).orderBy("pick").collect()] == ["h", "other"]


def test_extraction_cache(spark, tmp_path):
    answers = spark.createDataFrame([("a", '{"events": [{"summary": "s"}, {"summary": "t"}], "entities": [{"name": "N", "aliases": ["", "M"]}, {"name": ""}]}'), ("b", "not json"), ("c", "{}")], "chunk_id string, content string")
    parsed = extract.parse(answers)
    rows = {r["chunk_id"]: r for r in parsed.collect()}
    assert rows["a"]["events"][0]["event_id"] == "event_0" and len(rows["a"]["events"]) == 1 and rows["a"]["entities"][0]["aliases"] == ["M"]
    assert rows["b"]["error"] and rows["c"]["error"] is None
    keys = {r["chunk_id"]: r["keys"] for r in extract.concept_keys(parsed.where("error is null")).collect()}
    assert keys == {"a": ["concept::n", "concept::m"], "c": []}
    path = tmp_path / "cache.json"
    path.write_text(json.dumps({"z": {"events": [{"event_id": "1", "summary": "x"}, {"event_id": "2"}], "entities": []}}), encoding="utf-8")
    cached = stores.load_extractions(spark, f"file://{path}")
    assert len(cached.first()["events"]) == 1
    stores.save_extractions(cached, parsed.where("error is null").drop("error"), f"file://{tmp_path}/merged")
    merged = stores.load_extractions(spark, f"file://{tmp_path}/merged")
    assert merged.count() == 3
    stores.save_extractions(merged, merged.where("chunk_id = 'z'").withColumn("events", F.slice("events", 1, 0)), f"file://{tmp_path}/merged")
    again = {r["chunk_id"]: r["events"] for r in stores.load_extractions(spark, f"file://{tmp_path}/merged").collect()}
    assert len(again) == 3 and again["z"] == [] and len(again["a"]) == 1
    chunks = spark.createDataFrame([("q", "text")], "chunk_id string, text string")
    with pytest.raises(Exception, match="no extraction for q"):
        extract.extract(chunks, merged, lambda t: "not json").collect()
    assert stores.load_extractions(spark, f"file://{tmp_path}/none").count() == 0


def test_vector_store_follows_the_ids(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, "x"), ("b", 1, "yy")], "chunk_id string, seq long, text string")
    calls = spark.sparkContext.accumulator(0)

    def make():
        def encode(texts):
            calls.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    path = f"file://{tmp_path}/vectors"
    for _ in range(2):
        assert stores.cached_vectors(chunks, path, make).count() == 2
    assert calls.value == 2
    stores.cached_vectors(chunks.withColumn("seq", 1 - F.col("seq")), path, make)
    assert calls.value == 4
    index = stores.load_or_build_index(stores.cached_vectors(chunks, path, make), f"file://{tmp_path}/index")
    got = dense.inner_product_top_k(index.withColumnRenamed("chunk_id", "id"), [1.0, 1.0], 2).collect()
    assert got[0]["id"] == "a" and got[0]["score"] == pytest.approx(1.0)


@pytest.fixture
def warm(spark):
    chunks = chunking.numbered(chunking.chunk_documents(docs(spark, LAW, "Điều 1. Thuế\n1. thuế thu nhập\n2. thuế khác")))
    vectors = chunks.select("chunk_id", F.array(F.length("text").cast("double"), F.lit(1.0)).alias("embedding"))
    titles = spark.createDataFrame([("L0", "Luật mẫu")], "document_id string, title string")
    org = spark.createDataFrame([("VCC", "profile", "hồ sơ")], "org_id string, doc_type string, text string")
    return engine.build(chunks, vectors, titles, orgs.catalog(spark), org_docs=org)


def models(cite=1):
    def generate(prompt):
        import re

        return json.dumps({"answer": "trả lời", "cited_chunk_ids": re.findall(r"chunk_id=(\S+)", prompt)[:cite], "abstained": False})

    return engine.Models(encode=lambda q: [1.0, 1.0], generate=generate)


def test_injected_retrieval_and_draft(spark, warm):
    given = models()
    given.retrieve = lambda query, corpus: ["L1::Điều1::Khoản2", "unknown", "L0::Điều1"]
    given.generate = lambda prompt: drafts.Draft("nguyên văn", ["not in evidence"])
    got = engine.answer(warm, "thuế", given, budget=engine.Budget(rerank_k=1))
    assert got.answer == "nguyên văn" and got.stats == {"seed_count": 1, "context_count": 2, "added_count": 1}
    given.generate = lambda prompt: "no json"
    with pytest.raises(drafts.InvalidDraftError) as error:
        engine.answer(warm, "thuế", given)
    assert engine.status_of(error.value) == 422 and engine.status_of(None) == 200 and engine.status_of(engine.UnavailableError()) == 503 and engine.status_of(KeyError()) == 500


def test_concept_seeds_are_seeds(spark, warm):
    with_concepts = models()
    with_concepts.concepts = lambda query: ["concept::none", "law::L1"]
    assert engine.answer(warm, "thuế thu nhập", with_concepts, budget=engine.Budget(hybrid_k=4, rerank_k=2, extra=1)).stats["seed_count"] == 2
    keys = warm.keys.unionByName(spark.createDataFrame([("L0::Điều3a", 99, "concept::x", 9)], "chunk_id string, seq long, key string, key_pos int"))
    with_concepts.concepts = lambda query: ["concept::x"]
    got = engine.answer(replace(warm, keys=keys), "thuế thu nhập", with_concepts, budget=engine.Budget(hybrid_k=4, rerank_k=2, extra=1))
    assert got.stats["seed_count"] == 3


def test_missing_vectors_are_an_error(spark):
    chunks = chunking.numbered(chunking.chunk_documents(docs(spark, LAW)))
    with pytest.raises(KeyError, match="Điều1"):
        engine.build(chunks, chunks.where("article is null").select("chunk_id", F.array(F.lit(1.0)).alias("embedding")), docs(spark), orgs.catalog(spark))


def test_warm_load(spark, tmp_path):
    path = corpus_file(tmp_path, [{"id": "L0", "title": "T", "type": "law", "content": "first"}, {"id": "L0", "title": "U", "type": "law", "content": LAW}, {"id": "L1", "content": "Điều 1. Thuế"}])
    make = lambda: lambda texts: [[1.0, float(len(t) % 7)] for t in texts]
    warm = engine.load(spark, path, f"file://{tmp_path}/vectors", make, orgs.catalog(spark))
    assert warm.counts()["events"] == 9 and warm.edges.count() > 0 and {r["title"] for r in warm.titles.collect()} == {"U", "L1"}  # of an id the last row
    assert engine.answer(warm, "thuế", models()).answer == "trả lời"
    with pytest.raises(engine.UnavailableError):
        engine.load(spark, f"file://{tmp_path}/none.json", f"file://{tmp_path}/vectors", make, orgs.catalog(spark))


def test_metrics(spark):
    hits = spark.createDataFrame([("q", "a", "d", 1), ("q", "b", "e", 2), ("q", "c", "f", 3), ("q", "a", "d", 4)], "query_id string, chunk_id string, document_id string, rank int")
    gold = spark.createDataFrame([("q", "a", "d"), ("q", "z", "e"), ("r", "y", "g")], "query_id string, chunk_id string, document_id string")
    got = {r["query_id"]: tuple(r)[1:] for r in metrics.retrieval_metrics(hits, gold, 2).collect()}
    assert got == {"q": (1.0, 0.5, 0.5, 0.5), "r": (0.0, 0.0, 0.0, 0.0)}
    assert metrics.means(metrics.retrieval_metrics(hits, gold, 2)).first()["doc_recall"] == 0.5


def test_stored_index(spark, tmp_path):
    rows = spark.createDataFrame([(i, i, " ".join(random.Random(i).choices(["a", "b", "cd", "é", "e_f"], k=i % 9))) for i in range(60)], "chunk_id long, seq long, text string")
    built = lexical.build(rows)
    stored = lexical.save(built, f"file://{tmp_path}/index")
    for q in ("a cd CD", "é", "none", ""):
        assert lexical.top_k(stored, q, 20).collect() == lexical.top_k(built, q, 20).collect()


def test_engine(spark, warm):
    budget = engine.Budget(hybrid_k=4, rerank_k=2, extra=3)
    assert engine.answer(warm, "  ", models()).abstained
    got = engine.answer(warm, "thuế thu nhập", models(), budget=budget)
    assert got.answer == "trả lời" and got.stats["seed_count"] == 2 and got.stats["context_count"] <= 5 and got.cited[0]["chunk_id"] == "L1::Điều1::Khoản1"
    assert "VCC" in engine.answer(warm, "VietCredit thuế", models(9), budget=budget).cited[-1]["chunk_id"]
    assert engine.answer(warm, "vietcredit hay waka", models()).answer.startswith(orgs.ASK)
    plain, grown = engine.compare(warm, "thuế thu nhập", models(), budget)
    assert (plain.arm, grown.arm) == ("plain", "expanded") and plain.stats["context_count"] == 4 or plain.stats["context_count"] == 5
    assert engine.arm(grown)["label"] == "with expansion" and warm.counts()["events"] == 11
