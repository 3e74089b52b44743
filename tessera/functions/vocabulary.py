"""Fixed values that results must agree on: lanes, states, languages, authorities, weights."""

from __future__ import annotations

#: lane, suffix, media types, worker (fixed values).
LANES: tuple[tuple[str, str, tuple[str, ...], str], ...] = (
    ("markdown", ".md", ("text/markdown", "text/plain"), "markdown_syntax"),
    ("plain_text", ".txt", ("text/plain",), "plain_text_syntax"),
    ("pdf_text", ".pdf", ("application/pdf",), "pdf_text_syntax"),
    ("docx_text", ".docx", ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",), "docx_text_syntax"),
    ("rtf_text", ".rtf", ("application/rtf", "text/rtf"), "rtf_text_syntax"),
    ("odt_text", ".odt", ("application/vnd.oasis.opendocument.text",), "odt_text_syntax"),
    ("epub_text", ".epub", ("application/epub+zip",), "epub_text_syntax"),
)

#: Limits (fixed values): characters of a block or chunk, of a heading; shards of a run; workers; seconds; bytes.
MAX_BLOCK_CHARS, MAX_HEADING_CHARS, MAX_SHARDS = 20_000, 300, 256
DEFAULT_WORKERS, HARD_WORKERS, DEADLINE_MS, MAX_SOURCE_BYTES = 4, 8, 30_000, 20 * 1024 * 1024
CACHE_TTL_DAYS, PACKAGE_TTL_SECONDS, MAX_CRAWL_BYTES = 30, 3600, 1024 * 1024

#: Default crawl policy (fixed values).
EXCLUDED_DIRS = (".git", "node_modules", "dist", "build", "target", "coverage")
EXCLUDED_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "pdf", "zip", "tar", "gz")
LOCKFILES = ("Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "poetry.lock", "Pipfile.lock", "Gemfile.lock", "composer.lock")

#: Languages by file name, then by extension (fixed values).
LANGUAGE_OF_NAME = {"cargo.toml": "toml", "pyproject.toml": "toml", "taplo.toml": "toml", "makefile": "sh", "bashrc": "sh", "zshrc": "sh"}
LANGUAGE_OF_EXTENSION = {
    "rs": "rust", "ts": "ts", "mts": "ts", "cts": "ts", "tsx": "tsx", "js": "js", "mjs": "js", "cjs": "js", "jsx": "jsx",
    "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "md": "md", "markdown": "md", "py": "py", "pyw": "py",
    "sh": "sh", "bash": "sh", "zsh": "sh", "fish": "sh",
}
#: What a comment line starts with, by language (fixed values).
COMMENT_STARTS = {
    "rust": ("//", "/*", "*"), "ts": ("//", "/*", "*"), "tsx": ("//", "/*", "*"), "js": ("//", "/*", "*"), "jsx": ("//", "/*", "*"),
    "json": ("//", "/*", "*"), "py": ("#",), "sh": ("#",), "yaml": ("#",), "toml": ("#",), "md": ("<!--",),
}

#: Signals of a claim (fixed values).
FRESHNESS = {"fresh": 1.0, "historical": 0.75, "unknown": 0.5, "stale": 0.2}
HEALTH = {"ready": 1.0, "partial_success": 0.85, "degraded": 0.7, "stale": 0.45, "denied": 0.35, "unavailable": 0.2, "not_run": 0.2}
OTHER_HEALTH = 0.5

#: Authority of a subsystem for a claim class; '*' for all its others (fixed values).
AUTHORITY: dict[str, dict[str, float]] = {
    "artifacts": {"artifact_extraction_ready": 0.95, "artifact_extraction_denied": 0.95, "artifact_admission": 0.95, "stale_artifact": 0.95, "*": 0.15},
    "crawler": {"file_presence": 0.95, "file_deleted": 0.95, "file_hash": 0.95, "parse_success": 0.95, "parse_failure": 0.95, "stale_index": 0.95, "deleted_source_residual": 0.95, "doc_presence": 0.65, "doc_parity": 0.45, "coverage_gap": 0.45, "*": 0.25},
    "verifier": {"deleted_source_residual": 0.9, "stale_artifact": 0.9, "coverage_gap": 0.9, "verification_failed": 0.9, "policy_mismatch": 0.9, "*": 0.55},
    "compiler": {"compile_validity": 0.98, "build_validity": 0.98, "test_presence": 0.98, "*": 0.1},
    "governance": {"doc_presence": 0.95, "doc_assembly_presence": 0.95, "doc_parity": 0.95, "architecture_boundary_match": 0.95, "architecture_boundary_violation": 0.95, "coverage_gap": 0.95, "*": 0.2},
}
#: authority, evidence, freshness, agreement, contradiction, required authority, by claim class (fixed values).
WEIGHTS: dict[str, tuple[float, float, float, float, float, str | None]] = {
    "file_presence": (0.42, 0.28, 0.18, 0.12, 0.55, "crawler"),
    "file_deleted": (0.44, 0.28, 0.2, 0.08, 0.6, "crawler"),
    "file_hash": (0.4, 0.34, 0.2, 0.06, 0.6, "crawler"),
    "artifact_extraction_ready": (0.45, 0.24, 0.21, 0.1, 0.65, "artifacts"),
    "artifact_extraction_denied": (0.46, 0.24, 0.2, 0.1, 0.65, "artifacts"),
    "parse_success": (0.4, 0.3, 0.18, 0.12, 0.55, "crawler"),
    "compile_validity": (0.52, 0.24, 0.18, 0.06, 0.8, "compiler"),
    "doc_presence": (0.42, 0.3, 0.18, 0.1, 0.55, "governance"),
    "doc_parity": (0.48, 0.26, 0.18, 0.08, 0.7, "governance"),
    "stale_artifact": (0.42, 0.28, 0.2, 0.1, 0.55, None),
    "deleted_source_residual": (0.44, 0.28, 0.2, 0.08, 0.55, None),
    "coverage_gap": (0.36, 0.28, 0.18, 0.18, 0.4, None),
}
DEFAULT_WEIGHTS = (0.35, 0.3, 0.2, 0.15, 0.5, None)

#: Feature patterns of component files (fixed values).
COMPONENT_PATTERNS = {
    "state": r"\$state\s*\(", "derived": r"\$derived\s*\(", "effect": r"\$effect\s*\(", "props": r"\$props\s*\(",
    "snippet": r"\{#snippet\b", "render": r"\{@render\b", "legacy_event": r"\bon:[\w-]+\s*=", "event_attribute": r"\bon[a-z][\w-]*\s*=",
    "style_block": r"(?i)<style(\s|>)", "script_instance": r"(?i)<script(?:(?!\bmodule\b)[^>])*?>", "script_module": r"(?i)<script\b[^>]*\bmodule\b[^>]*>",
}
