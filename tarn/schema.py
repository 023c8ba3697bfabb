"""Table schemas and the fixed limits of the query surface."""

from __future__ import annotations

STAT = "struct<kind:string,dev:bigint,ino:bigint,size:bigint,mtime_ns:bigint,birthtime_ns:bigint,nlink:bigint>"
JOURNAL = (
    f"lsn bigint, wall_time_ns bigint, source string, op string, path string, stat {STAT}, "
    "content_hash string, hints_hash string, state string"
)
OBJECTS = (
    "oid bigint, kind string, dev bigint, ino bigint, birthtime_ns bigint, size bigint, mtime_ns bigint, nlink bigint, "
    "entry_paths array<string>, orphaned_at_ns bigint, content_hash string, hints_hash string, index_state string"
)
ENTRIES = "path string, oid bigint, attach_lsn bigint"
SYMBOLS = "array<struct<name:string,kind:string,line:int>>"
ATTRS = "array<struct<k:string,v:string>>"
CONTENT = (
    "content_hash string, extractor_id string, extractor_version int, hints_hash string, abi_version int, "
    f"status string, text string, attrs {ATTRS}, symbols {SYMBOLS}"
)
CONTENT_KEY = ["content_hash", "extractor_id", "extractor_version", "hints_hash", "abi_version"]
POSTINGS = "term string, oid bigint, tf int, doc_len int"
CHUNKS = "oid bigint, chunk_offset int, embedder_id string, embedder_version int, vec array<float>"

KINDS = ("file", "dir", "symlink")
OPS = ("upsert", "remove", "content")
STATUSES = (
    "complete", "partial", "encrypted", "password-required", "cloud-placeholder",
    "budget-exceeded", "unsupported", "corrupt", "quarantined",
)

#: Limits of the surfaces: hits of one query, fused and snippet results, and depths below them.
QUERY_CAP = 10_000
RESULT_CLAMP = (1, 1000)
HTTP_DEFAULT, HTTP_DEPTH = 25, 50
CLI_DEFAULT = 100
TOOL_DEFAULT = 10
HYBRID_DEPTH = 50
NESTED_SEMANTIC = 256
ALERT_THRESHOLD = 0.35


def clamp(limit: int) -> int:
    low, high = RESULT_CLAMP
    return max(low, min(high, limit))
