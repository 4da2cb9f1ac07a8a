"""Plain versions that tests compare with."""

import re

from metadoc.llm.decontamination import LEAST_TOKENS, NEEDED, WINDOW


def words(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def plain_overlap(text, item):
    """Whether an aligned window of the two has enough equal words."""
    a, b = words(text), words(item)
    if len(b) < LEAST_TOKENS:
        return False
    size = min(WINDOW, len(b))
    need = NEEDED if len(b) >= WINDOW else size
    places = {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)
    lines = {}
    for j, w in enumerate(b):
        for i in places.get(w, ()):
            lines.setdefault(i - j, []).append(j)
    return any(
        sum(1 for k in js if j <= k < j + size) >= need for js in lines.values() if len(js) >= need for j in js)
