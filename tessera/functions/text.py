"""Column functions over text, ids and small values. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import COMPONENT_PATTERNS

#: Line ends of the extraction side, and those of the code side.
UNIVERSAL_NEWLINE = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"
CODE_NEWLINE = "\\r?\\n"
_WHITE = "(?U)[\\s\\x1C-\\x1F]"
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
HEADING = "^(#{1,8}) (.+)$"
CODE_HEADING = "(?U)^\\s*(#{1,6})\\s+(.*?)\\s*$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row: a lambda's variable is not inlined again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(s: Column) -> Column:
    """Text without white space at either end."""
    return F.btrim(s, F.lit(WHITE_SPACE))


def lines(text: Column, newline: str = UNIVERSAL_NEWLINE) -> Column:
    """STR-01: the lines of a text; one empty line behind a last line end doesn't count, nor does an empty text."""
    # nearly all texts have but plain line ends: a split by one character needs no pattern
    rare = "\\r\\n" if newline == CODE_NEWLINE else "[\\r\\x0B\\x0C\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]"
    plain = F.when(text.rlike(rare), F.regexp_replace(text, newline, "\n")).otherwise(text)
    parts = F.split(plain, "\n", -1)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def heading_level(stripped: Column) -> Column:
    """STR-02: 1 to 8, or null: # signs, one space, a title."""
    return F.when(stripped.rlike(HEADING), F.length(F.regexp_extract(stripped, HEADING, 1)))


def heading_title(stripped: Column) -> Column:
    return strip(F.regexp_extract(stripped, HEADING, 2))


def code_heading(line: Column) -> Column:
    """STR-03: level and title under the code side's grammar (up to 6 signs, any white space), or null."""
    level, title = F.length(F.regexp_extract(line, CODE_HEADING, 1)), F.regexp_extract(line, CODE_HEADING, 2)
    return F.when(line.rlike(CODE_HEADING) & (title != ""), F.struct(level.alias("level"), title.alias("title")))


def is_table_line(line: Column) -> Column:
    """STR-04: two pipes or more."""
    return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 2


def squeeze(s: Column) -> Column:
    """STR-05, STR-06: runs of white space (no-break space included) become one space; none at the ends."""
    return F.regexp_replace(strip(s), f"{_WHITE}+", " ")


def clip(s: Column, n: int) -> Column:
    """STR-07: at most n bytes, an ellipsis in place of what goes; whole characters only."""
    kept = F.aggregate(F.split(s, ""), F.struct(F.lit("").alias("t"), F.lit(True).alias("on")), lambda a, c: F.struct(F.when(a["on"] & (F.octet_length(a["t"]) + F.octet_length(c) <= n), F.concat(a["t"], c)).otherwise(a["t"]).alias("t"), (a["on"] & (F.octet_length(a["t"]) + F.octet_length(c) <= n)).alias("on")), lambda a: a["t"])
    return F.when(F.octet_length(s) > n, F.concat(kept, F.lit("..."))).otherwise(s)


def sha256_id(prefix: str, key: Column, digits: int) -> Column:
    """STR-09..11, 13, 14, 16, 17: prefix and the first hex digits of a key's SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, digits))


def source_hash(content: Column) -> Column:
    """STR-08."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def artifact_id(request_id: Column, source_ref: Column) -> Column:
    return sha256_id("extract-", F.concat_ws(":", request_id, source_ref), 16)


def package_id(request_id: Column, source_ref: Column) -> Column:
    return sha256_id("pkg-", F.concat_ws(":", request_id, source_ref, F.lit("retrieval")), 16)


def chunk_id(request_id: Column, source_ref: Column, ordinal: Column, kind: Column) -> Column:
    return sha256_id("chunk-", F.concat_ws(":", request_id, source_ref, ordinal.cast("string"), kind), 12)


def queue_item_id(intake_kind: Column, lane: Column, repo: Column, handoff: Column, issue_keys: Column) -> Column:
    """STR-16: five fields, issue keys in order, joined."""
    return sha256_id("item-", F.concat_ws("|", intake_kind, lane, repo, handoff, F.array_join(F.array_sort(issue_keys), ";")), 24)


def component_flags(source: Column) -> Column:
    """STR-19: a struct of booleans."""
    return F.struct(*[source.rlike(p).alias(k) for k, p in COMPONENT_PATTERNS.items()])


def strip_git(s: Column) -> Column:
    """STR-21."""
    return F.regexp_replace(s, "\\.git$", "")


def is_doc_path(path: Column) -> Column:
    """STR-22: a README or SYSTEM file, or one under docs, doc or DECISIONS."""
    return path.rlike("(^|/)(README|SYSTEM)\\.md$|(^|/)(docs|doc|DECISIONS)/")


def is_parse_code(code: Column) -> Column:
    """STR-23."""
    return F.contains(code, F.lit("parse")) | code.isin("invalid_json", "invalid_toml", "invalid_yaml", "syntax_error")


def strict_epoch(s: Column) -> Column:
    """STR-24: RFC 3339 of 20 or 25 characters to epoch seconds; anything else is null."""
    fine = s.rlike("^\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(Z|[+-]\\d\\d:\\d\\d)$")
    return F.when(fine, F.unix_timestamp(F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))))


def lease_expiry(claimed: Column, heartbeat: Column, own_timeout: Column, fallback: Column) -> Column:
    """STR-25: (epoch, source): the heartbeat with its own timeout, else the claim with the caller's."""
    own = heartbeat.isNotNull() & own_timeout.isNotNull()
    return F.struct(F.when(own, heartbeat + own_timeout).otherwise(claimed + fallback).alias("epoch"), F.when(own, F.lit("heartbeat")).otherwise(F.lit("claim")).alias("source"))


def iso_utc(ts: Column) -> Column:
    """STR-26."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """STR-29."""
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def lookup(key: Column, values: dict, other=None) -> Column:
    """A small fixed table as one map literal."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(other)) if other is not None else F.try_element_at(table, key)


def comma_list(items: Column, word: str = "and") -> Column:
    """STR-42: a, b, and c."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, "").when(n == 1, items[0]).when(n == 2, F.concat(items[0], F.lit(f" {word} "), items[1])).otherwise(F.concat(head, F.lit(f", {word} "), F.element_at(items, -1)))


def uuid5(name: Column, namespace_hex: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """STR-43: the name-based UUID (version 5) of a text, under the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    nibble = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(nibble, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def is_uuid(s: Column) -> Column:
    return s.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def correlation_uuid(s: Column) -> Column:
    return F.when(is_uuid(s), F.lower(s)).otherwise(uuid5(s))


def is_json(text: Column) -> Column:
    """STR-34. The parser ignores what stands behind a value; within brackets and within braces it can't."""
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.coalesce(alone, F.lit(False)) & F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull()


def severity_weight(severity: Column) -> Column:
    """STR-44."""
    return F.when(severity.isin("critical", "high", "blocking"), "blocking").when(severity == "medium", "strong").otherwise("supporting")


def shell_function(line: Column) -> Column:
    """STR-39: the name a shell line defines as a function, or null."""
    t = strip(line)
    worded = F.regexp_extract(t, "^function [\\s({]*([^\\s({]+)", 1)
    called = F.regexp_extract(t, "^([A-Za-z0-9_-]+)\\s*\\(\\)", 1)
    return F.when(t.startswith("function "), F.nullif(worded, F.lit(""))).otherwise(F.nullif(called, F.lit("")))


def failure_route(message: Column) -> Column:
    """STR-45: kind, severity, route of a failure message; the first matching word decides."""
    m = F.lower(message)
    kinds = (("timeout", "timed out|timeout|deadline"), ("parse_failure", "parse|invalid json|invalid toml|syntax"), ("missing_source", "not found|no such file|missing"), ("permission", "permission|denied"))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(kinds):
        kind = F.when(m.rlike(pattern), name).otherwise(kind)
    kind = F.coalesce(kind, F.lit("unknown_failure"))
    severity = F.when(kind.isin("permission", "missing_source"), "high").when(kind == "unknown_failure", "low").otherwise("medium")
    route = F.when(severity == "high", "operator_review").otherwise("retry_queue")
    return F.struct(kind.alias("kind"), severity.alias("severity"), route.alias("route"))
