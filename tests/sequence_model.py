"""A stand-in model for the tests: counts on from the last value of a prompt."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

Model = Callable[[list[str]], list[str]]


class SequenceModel:
    """Continue the subject column of an instruction prompt by counting on.

    Reads the query's ``Column:`` list (the last one in the prompt), takes
    its last value, splits off the trailing number and proposes the next
    ``n`` numbers with the same zero padding — answering after the lead
    ``["`` and cut to ``max_chars`` (a stand-in for an answer-length limit).
    A picklable factory: ``complete(prompts, SequenceModel(10, 150))``.
    """

    def __init__(self, n: int = 10, max_chars: int = 150, lead: str = '["'):
        self.n, self.max_chars, self.lead = n, max_chars, lead

    def __call__(self) -> Model:
        n, max_chars, lead = self.n, self.max_chars, self.lead
        tail_re = re.compile(r"^(.*?)(\d+)$", re.S)

        def column_values(prompt: str):
            if prompt.startswith("[{"):  # a chat: JSON messages, the last user turn holds the query
                users = [m.get("content") or "" for m in json.loads(prompt) if m.get("role") == "user"]
                text = users[-1] if users else ""
                at = text.rfind("\nColumn:\n")
                return json.loads(text[at + len("\nColumn:\n"):]) if at >= 0 else []
            at = prompt.rfind("\nColumn:\n")
            end = prompt.find(" [/INST]", at)
            return json.loads(prompt[at + len("\nColumn:\n"):end])

        def answer(prompt: str) -> str:
            chat = prompt.startswith("[{")
            try:
                values = column_values(prompt)
            except (ValueError, TypeError):
                values = []
            m = tail_re.match(values[-1]) if values and isinstance(values[-1], str) else None
            if m is None:
                return "[]" if chat else "]"  # an empty list (after the lead for instruct)
            prefix, digits = m.group(1), m.group(2)
            nxt = [prefix + str(int(digits) + i).zfill(len(digits)) for i in range(1, n + 1)]
            # a chat model answers the whole list; an instruct model continues after the lead
            return json.dumps(nxt)[:max_chars] if chat else json.dumps(nxt)[len(lead):][:max_chars]

        return lambda prompts: [answer(p) for p in prompts]
