"""Scalar functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ALIASES

_SPACE = r"[\s\x1c-\x1f]"
_FOLD = "com.ibm.icu.lang.UCharacter"
_NFC = "com.ibm.icu.text.Normalizer"
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def normalize(x: Column) -> Column:
    """Composed, case-folded, with white space collapsed and trimmed; null is empty.

    ASCII takes a path inside generated code; other texts call ICU, which Catalyst treats as nondeterministic: project the
    result before joining on it.
    """
    ascii_only = F.is_valid_utf8(x) & (F.octet_length(x) == F.length(x))
    plain = F.when(x.rlike(_SPACE), F.btrim(F.regexp_replace(F.lower(x), f"{_SPACE}+", " "))).otherwise(F.lower(x))
    folded = F.reflect(F.lit(_FOLD), F.lit("foldCase"), F.reflect(F.lit(_NFC), F.lit("compose"), x, F.lit(False)), F.lit(True))
    other = F.trim(F.regexp_replace(folded, f"(?U){_SPACE}+", " "))
    return F.when(x.isNull(), F.lit("")).when(ascii_only, plain).otherwise(other)


def token_set(normal: Column) -> Column:
    """Words and character trigrams of a normalised text, as a set."""
    words = F.filter(F.split(normal, r"[^\p{L}\p{N}_]+"), lambda t: t != "")
    padded = F.concat(F.lit(" "), normal, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(normal)), lambda i: F.substring(padded, i, F.lit(3)))
    short = F.filter(F.array(F.trim(normal)), lambda t: t != "")
    return F.array_union(words, F.when(F.length(normal) <= 1, short).otherwise(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; both empty: 1, one empty: 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def similarity(normal_a: Column, tokens_a: Column, normal_b: Column, tokens_b: Column) -> Column:
    """1 if equal after normalisation, else the Jaccard similarity of the token sets."""
    return F.when(normal_a == normal_b, F.lit(1.0)).otherwise(jaccard(tokens_a, tokens_b))


def cosine(u: Column, v: Column) -> Column:
    """Of two vectors, clamped to 0..1; 0 if one has no length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    product = lambda p, q: F.zip_with(p, q, lambda a, b: a.cast("double") * b.cast("double"))
    norm = F.sqrt(total(product(u, u))) * F.sqrt(total(product(v, v)))
    return F.when(norm == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total(product(u, v)) / norm)))


def hash16(x: Column) -> Column:
    """First 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(x, 256), 1, 16)


def claim_id(topic: Column, s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("clm_"), hash16(F.concat_ws("|", normalize(topic), normalize(s), normalize(p), normalize(o))))


def source_id(uri: Column) -> Column:
    return F.concat(F.lit("src_"), hash16(normalize(uri)))


def source_ref(ref: Column) -> Column:
    """An id as it is, a URI hashed."""
    return F.when(ref.startswith("src_"), ref).otherwise(source_id(ref))


def evidence_id(claim: Column, source: Column, locator: Column) -> Column:
    return F.concat(F.lit("evd_"), hash16(F.concat_ws("|", claim, source, normalize(locator))))


def dependency_edge_id(child: Column, parent: Column) -> Column:
    return F.concat(F.lit("edg_dep_"), F.substring(child, 5, 1 << 20), F.lit("_"), F.substring(parent, 5, 10))


def supersession_edge_id(new: Column, old: Column) -> Column:
    return F.concat(F.lit("edg_sup_"), F.substring(new, 5, 1 << 20), F.lit("_"), F.substring(old, 5, 8))


def utc(x: Column) -> Column:
    """ISO-8601 text as a timestamp, without an offset in UTC; null if it isn't one. Empty is null."""
    t = F.trim(x)
    zoned = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & t.rlike(r"\d{2}:\d{2}")
    return F.when(t.rlike(_ISO), F.to_timestamp_ltz(F.when(zoned, t).otherwise(F.concat(F.when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00"))).otherwise(t), F.lit("Z")))))


def utc_text(t: Column) -> Column:
    """Canonical text of a timestamp; the session's time zone must be UTC."""
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def coerce(field: str, x: Column) -> Column:
    """An enum value with its near-miss spellings replaced."""
    known = ALIASES.get(field)
    if not known:
        return x
    pairs = F.create_map(*[F.lit(y) for kv in known.items() for y in kv])
    return F.coalesce(F.element_at(pairs, F.lower(F.trim(x))), x)


def score_text(x: Column) -> Column:
    return F.coalesce(F.format_string("%.2f", x), F.lit("  ? "))
