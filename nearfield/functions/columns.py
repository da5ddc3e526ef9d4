"""Column expressions over signatures, texts, tokens and logits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the stored format: the prefix of a signature, and each version's dimensions and algorithm.
PREFIX = "0din-"
ALGORITHMS = {"v0": "openai", "v1": "onnx"}
DIMENSIONS = {"v0": 1536, "v1": 1024}


def bands(signature: Column, n: int = 16) -> Column:
    """n contiguous pieces of a hex signature; null where it is shorter than n."""
    width = F.floor(F.length(signature) / n).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(signature, i * width + 1, width))
    return F.when(F.length(signature) >= n, cut)


def words64(signature: Column, n: int = 4) -> Column:
    """A hex signature of 16 * n digits as n 64-bit words."""
    return F.array(*[F.conv(F.substring(signature, 1 + 16 * i, 16), 16, -10).cast("long") for i in range(n)])


def hamming_words(a: Column, b: Column, n: int = 4) -> Column:
    """Differing bits of two signatures held as words: four population counts."""
    terms = [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(n)]
    return sum(terms[1:], terms[0]).cast("int")


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hex strings; other characters are dropped, and each digit without a partner counts 4."""
    clean = lambda c: F.regexp_replace(F.lower(c), "[^0-9a-f]", "")
    x, y = clean(a), clean(b)
    digit = lambda c: F.conv(c, 16, 10).cast("int")
    both = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.when(p.isNull() | q.isNull() | (p == "") | (q == ""), 4 * ((F.coalesce(p, F.lit("")) != "") | (F.coalesce(q, F.lit("")) != "")).cast("int")).otherwise(F.bit_count(digit(p).bitwiseXOR(digit(q)))))
    return F.aggregate(both, F.lit(0), lambda s, v: s + v)


def cosine_from_hamming(distance: Column, total_bits: int = 256) -> Column:
    return F.cos(F.lit(math.pi) * distance / F.lit(float(total_bits))) if total_bits > 0 else F.lit(0.0)


def largest_distance(threshold: float, total_bits: int = 256) -> int:
    """The largest distance whose cosine reaches the threshold, -1 if none does."""
    return max((d for d in range(total_bits + 1) if math.cos(math.pi * d / total_bits) >= threshold), default=-1)


def signature_string(version: Column, signature: Column) -> Column:
    return F.concat(F.lit(PREFIX), version, F.lit(":"), signature)


def parse_signature(text: Column) -> Column:
    """struct(version, signature); null where the text is no versioned signature."""
    pattern = "^" + PREFIX + "(v[01]):([0-9a-f]+)$"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).alias("version"), F.regexp_extract(text, pattern, 2).alias("signature")))


def version_of(dimensions: Column) -> Column:
    """Version tag of an embedding by its length; null for any other length."""
    return F.when(dimensions == 1536, "v0").when(dimensions == 1024, "v1")


def dimensions_of(version: Column) -> Column:
    """The other direction; latest is v1, and null for any other tag."""
    return F.when(version == "v0", DIMENSIONS["v0"]).when(version.isin("v1", "latest"), DIMENSIONS["v1"])


def algorithm_of(version: Column) -> Column:
    return F.when(version == "v0", ALGORITHMS["v0"]).when(version.isin("v1", "latest"), ALGORITHMS["v1"])


def is_stored(text: Column) -> Column:
    """Whether a text has the form of a stored signature: any version number and 64 digits."""
    return F.coalesce(text.rlike("^" + PREFIX + "v[0-9]+:[0-9a-f]{64}$"), F.lit(False))


def match_line(title: Column, severity: Column, boundary: Column, cosine: Column, hamming: Column) -> Column:
    """A match as a line of text."""
    return F.format_string("%s (%s, %s) - cosine: %.4f, hamming: %d", title, severity, boundary, cosine, hamming)


def preview(text: Column, limit: int = 50) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def normalise(vector: Column) -> Column:
    """Unit length; a zero vector stays."""
    wide = vector.cast("array<double>")
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(wide, lambda x: x / length)).otherwise(wide)


def embedding_sha256(vector: Column) -> Column:
    """SHA-256 of the list of values rounded to six places, written without exponents and with one digit after the point at least."""

    def fmt(x: Column) -> Column:
        n = F.round(F.abs(x.cast("double")) * 1e6).cast("long")
        sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
        fraction = F.rtrim(F.lpad((n % 1_000_000).cast("string"), 6, "0"), F.lit("0"))
        return F.concat(sign, F.floor(n / 1_000_000).cast("string"), F.lit("."), F.when(fraction == "", "0").otherwise(fraction))

    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(vector, fmt), ", "), F.lit("]")), 256)


def suspicious_probability(logits: Column) -> Column:
    """Softmax of two logits, class 1; null for fewer than two."""
    a, b = F.get(logits, F.lit(0)), F.get(logits, F.lit(1))
    m = F.greatest(a, b)
    return F.when(F.size(logits) >= 2, F.exp(b - m) / (F.exp(a - m) + F.exp(b - m)))


def checked_logits(logits: Column) -> Column:
    """logits, an error where a row has fewer than two; null stays null."""
    return F.when(logits.isNull() | (F.size(logits) >= 2), logits).otherwise(F.raise_error(F.lit("a scorer must return two logits")).cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def label(score: Column, threshold: float = 0.5) -> Column:
    return F.when(score >= threshold, "suspicious").otherwise("safe")


def response(score: Column) -> Column:
    return F.when(score >= 0.8, "block").when(score >= 0.5, "review").otherwise("allow")


def windows(tokens: Column, length: int = 510, stride: int = 460) -> Column:
    """Overlapping windows of a token array; one, maybe empty, where it fits."""
    n = F.greatest(F.lit(1), F.ceil((F.size(tokens) - length) / stride).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(tokens, i * stride + 1, length))
