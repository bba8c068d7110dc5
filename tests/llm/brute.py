"""Brute-force versions of operators that SQL can't express."""

import hashlib


def remove_repeats(rows, span=100):
    """{row: (n_bytes, n_removed, n_spans, sha256)} for (doc_id, text) rows with distinct doc_id."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - span + 1):
            s = raw[i : i + span]
            if s in seen:
                gone[i : i + span] = b"\1" * span
            else:
                seen[s] = (doc_id, i)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
