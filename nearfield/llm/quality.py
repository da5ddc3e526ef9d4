"""Quality rules: counts of words, symbols, lines and repeats, then divergence from the language's fixed histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.words import GAP, words
from nearfield.scratch import materialise

#: Frequent function words by language code, counted as written.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "with", "was", "for", "by"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "dans"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"],
}
N_COMMON = 12
CLASSES = ["upper", "lower", "digit", "mark", "space"]
WINDOW = 5
#: Fewer words than this: the histogram of a text says little, and no verdict is given on it.
MIN_WORDS = 30
#: Fixed references: mean shares of the character classes (CLASSES) and of COMMON_WORDS, in their order, over the
#: texts of testdata/sf0.1 that pass the base rules and have MIN_WORDS words (en 5448, es 840, fr 1354, de 1341).
CLASS_REFERENCES = {
    "en": [0.0143, 0.7798, 0.0011, 0.0392, 0.1655],
    "es": [0.0140, 0.7828, 0.0008, 0.0427, 0.1597],
    "fr": [0.0146, 0.7801, 0.0018, 0.0384, 0.1651],
    "de": [0.0130, 0.7948, 0.0008, 0.0378, 0.1536],
}
WORD_REFERENCES = {
    "en": [0.0462, 0.0243, 0.0200, 0.0146, 0.0101, 0.0090, 0.0078, 0.0067, 0.0049, 0.0057, 0.0064, 0.0041],
    "es": [0.0464, 0.0237, 0.0187, 0.0132, 0.0117, 0.0095, 0.0084, 0.0071, 0.0061, 0.0070, 0.0055, 0.0056],
    "fr": [0.0467, 0.0252, 0.0186, 0.0136, 0.0115, 0.0106, 0.0090, 0.0080, 0.0071, 0.0061, 0.0053, 0.0043],
    "de": [0.0455, 0.0235, 0.0191, 0.0145, 0.0120, 0.0101, 0.0085, 0.0080, 0.0065, 0.0065, 0.0052, 0.0053],
}
#: Over the largest class divergence of a text labelled good on sf0.1 (0.085), under that of symbol junk (0.10 to 0.13).
MAX_CLASS_DIVERGENCE = 0.1
#: The word limit, as a share of the distance (root of the divergence) at which a text without common words lies.
MAX_WORD_DISTANCE = 0.9


def bind(value: Column, use) -> Column:
    """use(value) with value computed once, though use names it many times."""
    return F.transform(F.array(value), use)[0]


def repeated_words(w: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of ``width`` words which the array holds twice or more."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[w[i + k] for k in range(width)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def twice(s: Column) -> Column:
            same = lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i + 1 < F.size(s)) & (s[F.least(i + 1, F.size(s) - 1)]["h"] == x["h"]))
            return F.sort_array(F.transform(F.filter(s, same), lambda x: x["p"]))

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.when(i + 1 < F.size(p), F.least(F.lit(width), p[F.least(i + 1, F.size(p) - 1)] - x)).otherwise(width))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return bind(bind(pairs, twice), length)

    any_twice = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)
    return F.when(n > width, bind(hashes, any_twice)).otherwise(0).cast("long")


def base_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Null and blank texts have none of these and fail. Columns of docs of
    these names are replaced.
    """
    return _measured(docs, text, "lang" if "lang" in docs.columns else None, keep=docs.columns)


def _left(t: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(t, pattern, "")).cast("long")


def _measured(docs: DataFrame, text: str, lang: str | None, keep: list[str]) -> DataFrame:
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    keep = [c for c in keep if c not in own and not c.startswith("__")]
    t = F.coalesce(F.col(text), F.lit(""))
    table = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    common = F.element_at(table, F.coalesce(F.col(lang), F.lit(""))) if lang else F.lit(None).cast("array<string>")
    d = docs.select(*keep, t.alias("__t"), common.alias("__common"))
    d = d.withColumns({"__w": words(F.col("__t")), "__lines": F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    w, t = F.col("__w"), F.col("__t")
    found = F.when(F.col("__common").isNotNull(), F.array(*[F.size(w) - F.size(F.array_remove(w, F.col("__common")[k])) for k in range(N_COMMON)]))
    d = d.select(
        *keep, F.size(w).cast("long").alias("n_words"), _left(t, GAP).alias("word_chars"), _left(t, "[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), repeated_words(w).alias("n_repeat_words"),
        F.length(t).cast("long").alias("__chars"), _left(t, r"[^\p{Lu}]+").alias("__upper"), _left(t, r"\P{L}+").alias("__letters"), _left(t, r"[^\p{Nd}]+").alias("__digit"), found.alias("__found"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def shares(d: DataFrame) -> DataFrame:
    """The two histograms as shares that sum to 1: __c0 to __c4 over characters, __f0 to __f12 over words."""
    chars, n = F.greatest(F.col("__chars"), F.lit(1)), F.greatest(F.col("n_words"), F.lit(1))
    counts = {"upper": F.col("__upper"), "lower": F.col("__letters") - F.col("__upper"), "digit": F.col("__digit"), "mark": F.col("word_chars") - F.col("__letters") - F.col("__digit"), "space": F.col("__chars") - F.col("word_chars")}
    d = d.withColumns({f"__c{i}": counts[k] / chars for i, k in enumerate(CLASSES)} | {f"__f{k}": F.col("__found")[k] / n for k in range(N_COMMON)})
    return d.withColumns({f"__f{N_COMMON}": 1 - sum((F.col(f"__f{k}") for k in range(1, N_COMMON)), F.col("__f0"))})


def jensen_shannon(p: list[Column], q: list[Column]) -> Column:
    """Divergence in bits, 0 to 1; its square root is the distance."""
    half = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = [half(a, (a + b) / 2) + half(b, (a + b) / 2) for a, b in zip(p, q, strict=True)]
    return sum(terms[1:], terms[0]) / 2


def without_common_words(lang: str) -> float:
    """Word divergence of a text that holds none of its language's common words."""
    rest = 1 - sum(WORD_REFERENCES[lang])
    return (1 - rest + math.log2(2 / (1 + rest)) + rest * math.log2(2 * rest / (1 + rest))) / 2


def judge_quality(docs: DataFrame, text: str = "text", lang: str = "lang", min_words: int = MIN_WORDS, max_class_divergence: float = MAX_CLASS_DIVERGENCE, max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """docs without the text, with the counts, class_divergence, word_divergence and kept.

    References are fixed, so a verdict depends on the text and its language
    alone. A text is dropped if the base rules fail, or if it has
    ``min_words`` words and its Jensen-Shannon divergence (bits) from the
    reference is over a limit: max_class_divergence for characters, and for
    words ``max_word_distance`` of the distance at which a text without any
    common word lies. A language without a list, or null, has the mean of the
    class references, and a null word divergence that does not count; so have
    shorter texts. Other columns pass through; repeated rows are judged each
    for themselves, null texts fail the base rules, an empty table stays empty.
    """
    d = materialise(_measured(docs, text, lang, [c for c in docs.columns if c != text]), "quality")
    d = shares(d)
    classes, found = [f"__c{i}" for i in range(len(CLASSES))], [f"__f{k}" for k in range(N_COMMON + 1)]
    by_lang = lambda table: F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.coalesce(F.col(lang), F.lit("")))
    mean = F.array(*[F.lit(sum(x) / len(CLASS_REFERENCES)) for x in zip(*CLASS_REFERENCES.values(), strict=True)])
    whole = {k: [*v, 1 - sum(v), max_word_distance**2 * without_common_words(k)] for k, v in WORD_REFERENCES.items()}
    d = d.withColumns({"__cr": F.coalesce(by_lang(CLASS_REFERENCES), mean), "__fr": by_lang(whole)})
    apart = lambda names, r: F.when(F.col("n_words") >= min_words, jensen_shannon([F.col(b) for b in names], [F.col(r)[i] for i in range(len(names))]))
    d = d.withColumns({"class_divergence": apart(classes, "__cr"), "word_divergence": F.when(F.col("__fr").isNotNull(), apart(found, "__fr"))})
    far = (F.coalesce(F.col("class_divergence"), F.lit(0.0)) > max_class_divergence) | F.coalesce(F.col("word_divergence") > F.col("__fr")[N_COMMON + 1], F.lit(False))
    d = d.withColumn("kept", ~F.col("base_failed") & ~far)
    return d.select(*[c for c in d.columns if not c.startswith("__")])


def op6_divergence(spark, sf_dir: str) -> DataFrame:
    """All documents; nulls, ties and repeated rows as in ``judge_quality``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judge_quality(docs.select("doc_id", "lang", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _far(p: str, q: str, n: int) -> str:
    """SQL of the Jensen-Shannon divergence of two lists."""
    half = lambda a, i: f"CASE WHEN {a}[{i}] > 0 THEN {a}[{i}] * log2({a}[{i}] / (({p}[{i}] + {q}[{i}]) / 2)) ELSE 0.0::DOUBLE END"
    return "(" + " + ".join(f"({half(p, i)} + {half(q, i)})" for i in range(1, n + 1)) + ") / 2"


def _references() -> str:
    """SQL rows (lang, common words, class reference, word reference, limit); the last, of null, is for other languages."""
    rows = [f"('{k}', {COMMON_WORDS[k]}, {CLASS_REFERENCES[k]}::DOUBLE[], {[*WORD_REFERENCES[k], 1 - sum(WORD_REFERENCES[k])]}::DOUBLE[], {MAX_WORD_DISTANCE**2 * without_common_words(k)!r}::DOUBLE)" for k in COMMON_WORDS]
    mean = [sum(x) / len(CLASS_REFERENCES) for x in zip(*CLASS_REFERENCES.values(), strict=True)]
    return ",\n  ".join([*rows, f"(NULL, NULL, {mean}::DOUBLE[], NULL, NULL)"])


OP6_SQL = rf"""
WITH refs(l, common, cr, fr, most) AS (VALUES
  {_references()}),
d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN lang IN (SELECT l FROM refs WHERE l IS NOT NULL) THEN lang END AS l, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS x FROM d),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i : i + 4]) AS times FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
repeated AS (SELECT rid, count(DISTINCT i + j) AS n FROM windows, range(5) r(j) WHERE times > 1 GROUP BY rid),
n AS (
  SELECT rid, doc_id, l, w, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(x) - len(list_distinct(x)) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, length(t) AS chars,
         length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS upper, length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Nd}}]+', '', 'g')) AS digits
  FROM d JOIN lines USING (rid) LEFT JOIN repeated USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM n),
h AS (
  SELECT b.*, cr, fr, most, list_transform([upper, letters - upper, digits, word_chars - letters - digits, chars - word_chars], lambda x: x / greatest(chars, 1)::DOUBLE) AS c,
         list_transform(common, lambda x: len(list_filter(w, lambda y: y = x)) / greatest(n_words, 1)::DOUBLE) AS f
  FROM b JOIN refs ON b.l IS NOT DISTINCT FROM refs.l),
g AS (SELECT * EXCLUDE f, list_append(f, 1 - list_sum(f)) AS f FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_words >= {MIN_WORDS} AND ({_far("c", "cr", 5)} > {MAX_CLASS_DIVERGENCE} OR coalesce({_far("f", "fr", N_COMMON + 1)} > most, false))) AS kept
FROM g
"""
