"""The model client: requests, waits, errors, and its use in tasks and in an answer."""

import json
from types import SimpleNamespace

import pytest
from pyspark import cloudpickle

from gleaner import settings
from gleaner.operators import chat, extract
from gleaner.plans import engine


class StatusError(Exception):
    def __init__(self, status):
        super().__init__(f"status {status}")
        self.status_code = status


def answer(text):
    return SimpleNamespace(choices=[SimpleNamespace(message=SimpleNamespace(content=text))])


def client(outcomes, **more):
    """A client of a service that gives these outcomes in order, and the requests that it saw."""
    seen, left = [], list(outcomes)

    def create(**request):
        seen.append(request)
        out = left.pop(0)
        if isinstance(out, Exception):
            raise out
        return answer(out)

    return chat.Chat(lambda: create, wait=0.0, **({"model": "m"} | more)), seen


def test_request_and_length_limit():
    for model, name in (("gpt-5-mini", "max_completion_tokens"), ("O3", "max_completion_tokens"), ("gpt-4o", "max_tokens")):
        ask, seen = client(["{}"], model=model, tokens=1200)
        assert ask("p") == "{}" and seen[0][name] == 1200 and sum("tokens" in k for k in seen[0]) == 1
        assert seen[0]["temperature"] == 0 and seen[0]["model"] == model
        assert [m["role"] for m in seen[0]["messages"]] == ["system", "user"] and seen[0]["messages"][1]["content"] == "p"
    ask, seen = client([None])
    assert ask("p") == "{}" and not any("tokens" in k for k in seen[0])


def test_transient_failures_are_tried_again():
    ask, seen = client([StatusError(429), ConnectionError("reset"), TimeoutError(), "done"])
    assert ask("p") == "done" and len(seen) == 4


def test_what_does_not_pass_is_an_error():
    ask, seen = client([StatusError(503)] * 9, tries=3)
    with pytest.raises(chat.UnavailableError, match="3 tries"):
        ask("p")
    assert len(seen) == 3
    for wrong in (StatusError(401), StatusError(400), KeyError("x")):
        ask, seen = client([wrong] * 3)
        with pytest.raises(type(wrong)):
            ask("p")
        assert len(seen) == 1
    assert engine.status_of(chat.UnavailableError()) == 503 and engine.UnavailableError is chat.UnavailableError


def test_waits_grow(monkeypatch):
    slept = []
    monkeypatch.setattr(chat.time, "sleep", slept.append)
    ask, _ = client([StatusError(500)] * 4 + ["x"], tries=5)
    ask.wait = 2.0
    assert ask("p") == "x"
    assert all(2.0 * 2**n <= s <= 4.0 * 2**n for n, s in enumerate(slept)) and len(slept) == 4


def test_settings_name_the_model():
    with pytest.raises(chat.UnavailableError):
        chat.from_settings(settings.Settings(generate_api_key="  "), lambda key: None)
    keys = []
    ask = chat.from_settings(settings.Settings(generate_api_key="k", generate_model="gpt-4o"), lambda key: keys.append(key) or (lambda **r: answer(r["model"])))
    assert not keys and ask("p") == "gpt-4o" and ask("p") == "gpt-4o" and keys == ["k"]


def test_a_client_goes_to_tasks(spark):
    def unsteady():
        """A connection, opened in a task, whose every other request fails."""
        calls = []

        def create(**request):
            calls.append(1)
            if len(calls) % 2:
                raise ConnectionError("reset")
            content = json.dumps({"events": [], "entities": [{"name": request["messages"][1]["content"]}]})
            return SimpleNamespace(choices=[SimpleNamespace(message=SimpleNamespace(content=content))])

        return create

    ask = chat.Chat(unsteady, "m", wait=0.0)
    ask("opened here")
    assert cloudpickle.loads(cloudpickle.dumps(ask))._create is None and ask._create is not None
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(20)], "chunk_id string, text string").repartition(3)
    none = spark.createDataFrame([], extract.parse(spark.createDataFrame([], "chunk_id string, content string")).drop("error").schema)
    got = {r["chunk_id"]: r["entities"][0]["name"] for r in extract.extract(chunks, none, ask).collect()}
    assert got == {f"c{i}": f"text {i}" for i in range(20)}
