"""A chat model behind a connection: what is asked of it, waits between tries, and errors.

A ``Chat`` is a function from a prompt to an answer's text, so it serves as ``Generate`` of an
answer and as the model of ``extract`` and ``extract_into``.  It opens its connection where it
is used first, so it can be sent to tasks.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from gleaner.settings import Settings

from .drafts import length_limit

#: What every request says before the prompt.
SYSTEM = "Output valid JSON only."
#: Statuses of a service that may answer later.
TRANSIENT = (408, 409, 425, 429, 500, 502, 503, 504)


class UnavailableError(RuntimeError):
    """The corpus, or a model that a query needs, is not there."""


def transient(error: Exception) -> bool:
    """Whether a request that failed so may do better later: by its status, or by its kind where it has none."""
    status = getattr(error, "status_code", getattr(error, "status", None))
    if isinstance(status, int):
        return status in TRANSIENT
    return isinstance(error, ConnectionError | TimeoutError) or type(error).__name__ in ("APIConnectionError", "APITimeoutError")


@dataclass
class Chat:
    """``connect`` gives a function of a request's arguments, such as a client's ``chat.completions.create``.

    A transient failure is tried again after ``wait`` seconds, then twice as long each time, with
    a random share so that tasks do not come back together.  After ``tries`` the model is
    unavailable; any other failure is raised at once.  ``tokens`` limits the answer's length
    under the name that the model's family has for it; None sets no limit.
    """

    connect: Callable[[], Callable[..., Any]]
    model: str
    tokens: int | None = None
    tries: int = 4
    wait: float = 1.0
    _create: Callable[..., Any] | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_create": None}

    def request(self, prompt: str) -> dict[str, Any]:
        messages = [{"role": "system", "content": SYSTEM}, {"role": "user", "content": prompt}]
        limit = {} if self.tokens is None else length_limit(self.model, self.tokens)
        return {"model": self.model, "messages": messages, "temperature": 0, **limit}

    def __call__(self, prompt: str) -> str:
        for n in range(self.tries):
            try:
                self._create = self._create or self.connect()
                return self._create(**self.request(prompt)).choices[0].message.content or "{}"
            except Exception as error:
                if not transient(error):
                    raise
                if n + 1 == self.tries:
                    raise UnavailableError(f"{self.model} gave no answer in {self.tries} tries: {error}") from error
                time.sleep(self.wait * 2**n * (1 + random.random()))
        raise ValueError("tries must be 1 or more")


def from_settings(settings: Settings, connect: Callable[[str], Callable[..., Any]], tokens: int | None = None) -> Chat:
    """The model that the settings name, by a connection made with their key; without a key it is unavailable."""
    if not settings.generate_configured:
        raise UnavailableError("no key of the generating model: set GLEANER_GENERATE_API_KEY")
    key = settings.generate_api_key
    return Chat(lambda: connect(key), settings.generate_model, tokens)
