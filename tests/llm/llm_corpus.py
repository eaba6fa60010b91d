"""A small random corpus and plain word functions for the tests of the llm operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed=3, n=60):
    """Random documents with copies, edited copies, shared passages, repeated rows, null and empty
    texts, one long word and one long text."""
    rnd = random.Random(seed)
    vocab = ["the", "of", "and", "Haus", "été", "ñandú", "日本", "a", "b", "c", *(f"w{k}" for k in range(60))]

    def text(n):
        return "".join(rnd.choice(vocab) + rnd.choice([" ", " ", " ", "\n", "  ", "\t", ". ", " "]) for _ in range(n))

    passage, out = text(40), []
    for k in range(n):
        t = text(rnd.choice([0, 1, 2, 5, 20, 60, 90, 200]))
        if out and rnd.random() < 0.25:
            t = rnd.choice(out)[1] or ""
            if rnd.random() < 0.6:
                w = t.split(" ")
                w[rnd.randrange(len(w))] = "changed"
                t = " ".join(w)
        if rnd.random() < 0.2:
            t += " " + passage
        out.append((k * 3 + 1, t))
    out += [(500, None), (501, ""), (502, " \n\t "), (503, "x" * 5000), (504, text(3000)), out[4], out[4]]
    return out
