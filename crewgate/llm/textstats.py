"""Surface counts per document, computed over a slice of texts at once."""

from __future__ import annotations

import numpy as np

from crewgate.llm import arrays as A

SYMBOLS = b"#*$%&|<>"   # fixed by the contract of the base rules


def counts(data, offsets) -> dict:
    """Counts that the base rules and the classifier share.

    ``n_words``; ``word_chars``: code points inside words; ``n_symbols``:
    characters of ``SYMBOLS``; ``n_dup_lines``: lines holding a word that equal
    an earlier line of the text; ``n_repeat_words``: words inside an 8-word
    window that occurs twice or more in the text, its first place included.
    The word arrays are returned too (``start end doc hash``).
    """
    n_docs = len(offsets) - 1
    start, end, doc = A.words(data, offsets)
    solid_heads = A.HEAD & ~A.SPACE
    out = {
        "n_words": np.bincount(doc, minlength=n_docs),
        "word_chars": A.per_doc(solid_heads[data], offsets),
        "n_symbols": A.per_doc(A.byte_class(SYMBOLS)[data], offsets),
    }
    hashes = A.segment_hash(data, start, end)
    ls, le, ldoc = A.lines(data, offsets)
    solid = np.concatenate([[0], np.cumsum(~A.SPACE[data], dtype=np.int64)])
    keep = solid[le] > solid[ls]
    ls, le, ldoc = ls[keep], le[keep], ldoc[keep]
    _, later = A.repeated(ldoc, A.segment_hash(data, ls, le))
    out["n_dup_lines"] = np.bincount(ldoc[later], minlength=n_docs)
    out["n_lines"] = np.bincount(ldoc, minlength=n_docs)
    at, eight = A.windows(hashes, doc, 8)
    both, _ = A.repeated(doc[at], eight)
    hit = A.covered(at[both], 8, len(doc))
    out["n_repeat_words"] = np.bincount(doc[hit], minlength=n_docs)
    out.update(start=start, end=end, doc=doc, hash=hashes)
    return out


def base_failed(c: dict):
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
