"""Plain versions that several tests compare with."""

import hashlib
import re
from collections import Counter


def windows_removed(texts, size):
    """Per document: words, words removed, and the digest of what is left, when each word in a repeated window of ``size`` words goes."""
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in texts.items()}
    count = Counter(tuple(w[i : i + size]) for w in words.values() for i in range(len(w) - size + 1))
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[k] = (len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest())
    return out
