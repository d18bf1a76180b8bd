"""URL filters: host-and-path rules, then pattern rules found by their rarest literal token.

A host rule fits its host and every subdomain when the URL's path starts with the rule's; the longest wins. URLs that no
host rule fits are judged by the pattern rules. Each pattern's whole-token literals are read off its syntax tree; the one
that the fewest URLs of the corpus contain becomes its index key. A URL's tokens fetch the candidate patterns and only
those run their regular expression, so the cost of a URL follows its own tokens and not the number of rules. Patterns
without such a literal are run on every URL.

Rules are a list held by the caller. They are sent to the executors in blocks of at most ``MAX_RULE_BYTES``, one pass in
the same job for each block, which carries along what the blocks before have found.
Nulls: a URL that is null or lacks ``://`` has an empty host and path, no host rule fits it and it is allowed. Repeated
rows are judged alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser as sre_parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULE_BYTES = 64 << 20
TOKEN = re.compile("[a-z0-9]+")

HOST_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: (pattern, verdict), matched against the lower-cased URL; an allow pattern overrides block patterns.
PATTERNS = [
    (r"://(?:[^/]*\.)?casino-[^/]*\.", "block"), (r"://(?:[^/]*[.-])?cheap-pills\.", "block"), (r"://(?:[^/]*[.-])?spam-farm\.", "block"), (r"://(?:[^/]*[.-])?free-money\.", "block"),
    (r"[/.-]adult[/.-]", "block"), (r"[?&]utm_source=spam\b", "block"), (r"/wp-login\.php\b", "block"), (r"/robots\.txt$", "allow"),
]


def literal_tokens(pattern: str) -> set[str]:
    """Tokens that any match holds whole: literal runs of the top-level sequence with a literal non-token character, or an end of the text, on both sides."""
    marked: list[str] = []
    for op, arg in sre_parser.parse(pattern):
        if op is sre.LITERAL:
            marked.append(chr(arg))
        elif op is sre.AT and arg in (sre.AT_BOUNDARY, sre.AT_BEGINNING_STRING, sre.AT_BEGINNING, sre.AT_END_STRING, sre.AT_END):
            marked.append("\0")
        elif op is sre.IN and not any(TOKEN.search(c) for c in _members(arg)):
            marked.append("\0")
        else:
            marked.append("\1")  # anything: a token that touches it is not known whole
    text = "".join(marked)
    return {m[0] for m in TOKEN.finditer(text) if text[max(0, m.start() - 1) : m.start()] not in ("", "\1") and text[m.end() : m.end() + 1] not in ("", "\1")}


def _members(arg: list) -> str:
    """The characters of a class, or a token character if it can't be listed."""
    return "".join(chr(a) for op, a in arg) if all(op is sre.LITERAL for op, _ in arg) else "a"


def index(urls: DataFrame, patterns: list[tuple[str, str]]) -> tuple[dict[str, list[int]], list[int]]:
    """Rarest literal token -> numbers of its patterns, and the patterns that have none. Token frequencies cover all URLs."""
    tokens = {i: literal_tokens(p) for i, (p, _) in enumerate(patterns)}
    wanted, often = sorted(set().union(*tokens.values())), {}
    if wanted:
        asked = urls.sparkSession.createDataFrame([(t,) for t in wanted], "t string")
        found = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("([a-z0-9]+)"), 1))).alias("t")).groupBy("t").count().join(asked, "t")
        often = {r["t"]: r["count"] for r in found.collect()}  # one row for each token of the rules at most
    at: dict[str, list[int]] = {}
    for i, own in tokens.items():
        if own:
            at.setdefault(min(own, key=lambda t: (often.get(t, 0), t)), []).append(i)
    return at, [i for i, own in tokens.items() if not own]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    rest = (url or "").partition("://")[2]
    end = min((p for p in map(rest.find, "/?#") if p >= 0), default=len(rest))
    tail = rest[end:]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), rest[:end]), re.split("[?#]", tail, maxsplit=1)[0]


def host_rule(host: str, path: str, by_host: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    fits, at = [], 0
    while host and at >= 0:
        fits += [(len(rule), rule, verdict) for rule, start, verdict in by_host.get(host[at:], ()) if path.startswith(start)]
        dot = host.find(".", at)
        at = dot + 1 if dot >= 0 else -1
    return max(fits)[1:] if fits else None


def rule_blocks(host_rules: list[tuple[str, str, str]], patterns: list[tuple[str, str]]) -> list[tuple[list, list]]:
    """The rules in order, in blocks of a bounded size; at least one."""
    out, held = [([], [])], 0
    for n, rules in enumerate((host_rules, patterns)):
        for rule in rules:
            size = sum(map(len, rule))
            if held and held + size > MAX_RULE_BYTES:
                out.append(([], []))
                held = 0
            out[-1][n].append(rule)
            held += size
    return out


def judge(pages: DataFrame, host_rules: list[tuple[str, str, str]] = HOST_RULES, patterns: list[tuple[str, str]] = PATTERNS) -> DataFrame:
    """(page_id, host, path, rule, pattern, verdict) for each row of pages(page_id, url)."""
    kind, none = pages.schema["page_id"].dataType.simpleString(), F.lit(None).cast("string")
    rows = pages.select("page_id", "url", *[none.alias(x) for x in FOUND])
    for block in rule_blocks(host_rules, patterns):
        rows = rows.mapInArrow(searched(*block, *index(pages, block[1])), f"page_id {kind}, url string, {', '.join(f'{x} string' for x in FOUND)}")
    pattern = F.when(F.col("rule").isNull(), F.coalesce("allowing", "blocking"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("allowing").isNull() & F.col("blocking").isNotNull(), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", pattern.alias("pattern"), verdict.alias("verdict"))


#: What is carried from block to block: the longest host rule with its verdict, and the first pattern of each verdict.
FOUND = ["host", "path", "rule", "rule_verdict", "allowing", "blocking"]


def searched(host_rules: list[tuple[str, str, str]], patterns: list[tuple[str, str]], by_token: dict[str, list[int]], always: list[int]):
    """The pass of one block of rules over rows (page_id, url, *FOUND)."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for host, path, verdict in host_rules:
        by_host.setdefault(host, []).append((host + path, path, verdict))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(re.compile(p), v) for p, v in patterns]
        for batch in batches:
            rows = []
            for url, rule, verdict, allowing, blocking in zip(*(batch.column(c).to_pylist() for c in ("url", "rule", "rule_verdict", "allowing", "blocking")), strict=True):
                host, path = split_url(url)
                fits = host_rule(host, path, by_host)
                if fits and (rule is None or (len(fits[0]), fits) > (len(rule), (rule, verdict))):
                    rule, verdict = fits
                if rule is None and host:
                    low = url.lower()
                    for i in sorted({*always, *(i for t in set(TOKEN.findall(low)) for i in by_token.get(t, ()))}):
                        if compiled[i][0].search(low):
                            allowing, blocking = (allowing or patterns[i][0], blocking) if patterns[i][1] == "allow" else (allowing, blocking or patterns[i][0])
                rows.append((host, path, rule, verdict, allowing, blocking))
            columns = list(zip(*rows, strict=True)) or [[]] * len(FOUND)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *(pa.array(c, pa.string()) for c in columns)], names=["page_id", "url", *FOUND])

    return run
