"""Named queries over the test tables, and DuckDB SQL for the same rows."""

from tallyforge.plans import dialogs, documents, estimates, matching, requests, retrieval, sales, taxonomy, templates, texts

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (sales, templates, retrieval, dialogs, texts, estimates, documents, matching, taxonomy, requests):
    QUERIES |= _part.Q
    ORACLES |= _part.O
