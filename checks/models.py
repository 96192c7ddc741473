"""Models with fixed answers that depend on every character of the request, for runs without a model server."""

from __future__ import annotations

import hashlib
import sys

from pyspark import cloudpickle

from promptmill.plans.steps import Models, Settings

# Sent to executors as code, so that this module need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def number_of(system: str, user: str) -> int:
    """A number from the whole text of a request."""
    return int(hashlib.md5(f"{system}\n{user}".encode()).hexdigest()[:6], 16)


def scorer():
    """Letter and number by the text of the request; some requests always fail."""
    def answer(system: str, user: str):
        n = number_of(system, user)
        if n % 19 == 7:
            raise RuntimeError("busy")
        return f"  Of {n} the answer is ({'ABCD'[n % 4]}) ", n, n % 10
    return answer


def optimizer():
    """Rewrites, rules, merged rules and prompts by the text of what is asked."""
    def answer(system: str, user: str):
        n = number_of(system, user)
        if user.startswith("[TASK CONTEXT]"):
            count = user.count("<CASE>")
            if n % 5 == 0:
                return "nothing to add"
            return "\n".join(f"<REWRITE_BEGIN>Check part {i} of {n}</REWRITE_END>" for i in range(count - n % 2))
        if user.startswith("Correct Prompts:"):
            return "" if n % 7 == 0 else f"[Key Vocabulary]\nclarity, size {n}"
        if user.startswith("Please fill"):
            return f"[Guiding Tone]\nCalm\n\n[Key Vocabulary]\nmerged {n}"
        if n % 4 == 1:
            return "Here is nothing"
        return f"Here you are:\n1. Think about {n} things\nVerify all of the {n} parts\n\"Explain step {n}\""
    return answer


MODELS = Models(lambda: scorer(), lambda: optimizer())
SETTINGS = Settings(retry_delay=0.0)
