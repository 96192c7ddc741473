"""Models with answers varied by every character asked, for whole jobs on a few items."""

from __future__ import annotations

from zlib import crc32


def scorer():
    def answer(system, user):
        n = crc32((system + user).encode())
        if n % 13 == 7:
            raise RuntimeError("busy")
        return f"  Of {n} the answer is ({'AB'[n % 2]}) "
    return answer


def optimizer():
    def answer(system, user):
        n = crc32((system + user).encode())
        if user.startswith("[TASK CONTEXT]"):
            count = user.count("<CASE>")
            if n % 6 == 0:
                return "nothing to add"
            return "\n".join(f"<REWRITE_BEGIN>Check {n + i % 2}</REWRITE_END>" for i in range(count + n % 3 - 1))
        if user.startswith("Correct Prompts:"):
            return "" if n % 7 == 0 else f"[Key Vocabulary]\nclarity, {n}"
        if user.startswith("Please fill"):
            return f"[Guiding Tone]\nCalm\n\n[Key Vocabulary]\nmerged {n}"
        if n % 4 == 1:
            return "Here is nothing"
        return f"Here you are:\n1. Think about {n} things\nVerify all of the {n} parts\n\"Explain step {n}\""
    return answer
