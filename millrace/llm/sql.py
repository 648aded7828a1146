"""Oracle SQL for those queries of the sub-package that SQL can express on whole tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "p4_found": "SELECT DISTINCT candidate_id FROM pretrain_records WHERE length(text) > 3000",
    "p4_joined": "SELECT DISTINCT candidate_id, sha256(text) AS text_sha256, true AS within_limit FROM pretrain_records WHERE length(text) > 3000",
}
