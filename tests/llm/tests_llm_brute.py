"""Plain versions of the operators, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(docs, window, words):
    """{doc_id: (units, removed mask)} for [(doc_id, text)], each document once."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        units = WORD.findall(text or "") if words else (text or "").encode()
        gone = [False] * len(units)
        for i in range(len(units) - window + 1):
            key = tuple(units[i : i + window]) if words else units[i : i + window]
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[doc_id] = (units, gone)
    return out


def kept(units, gone, words):
    left = [u for u, g in zip(units, gone, strict=True) if not g]
    return " ".join(left) if words else bytes(left)
