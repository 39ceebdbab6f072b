import json

from gleaner import settings
from gleaner.streaming import ingest


def test_new_files_become_chunks_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"id": "a", "type": "law", "content": "Điều 1. x\n1. y\n2. z"}) + "\n", encoding="utf-8")
    run = lambda: ingest.chunk_stream(spark, f"file://{folder}", f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination(120)
    run()
    (folder / "2.json").write_text(json.dumps({"id": "b", "content": "body"}) + "\n", encoding="utf-8")
    run()
    run()
    found = spark.read.parquet(f"file://{tmp_path}/out")
    assert [r["chunk_id"] for r in found.orderBy("seq").collect()] == ["a::Điều1", "a::Điều1::Khoản1", "a::Điều1::Khoản2", "b::body"]


def test_seq_is_unique_over_batches(spark, tmp_path):
    """As many documents as made 32-bit hashes of ids collide, in two batches."""
    folder = tmp_path / "in"
    folder.mkdir()
    for part in range(2):
        (folder / f"{part}.json").write_text("".join(f'{{"id": "{part}-{i}", "content": "x"}}\n' for i in range(100_000)))
        ingest.chunk_stream(spark, f"file://{folder}", f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination(120)
    found = spark.read.parquet(f"file://{tmp_path}/out")
    assert found.count() == found.select("seq").distinct().count() == 200_000


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("GLEANER_RERANK_API_KEY='k'\n# c\nGLEANER_GENERATE_MODEL=m\n")
    monkeypatch.setenv("GLEANER_GENERATE_MODEL", "n")
    got = settings.load(str(tmp_path / ".env"))
    assert got.rerank_configured and not got.generate_configured and got.generate_model == "n"
    assert settings.healthcheck()["status"] == "ok"
