"""Quality rules by divergence of character-class and common-word histograms, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, bind, words, written

SYMBOLS = "#*$%&|<>"
BLANK_RUN = r"[\x20\x09-\x0D]+"

#: Common words by language, counted for the histograms.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"),
}
CLASSES = ("lower", "upper", "digit", "blank", "point", "symbol", "other")

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8

#: Divergence (bits, 0 to 1) above which a histogram counts as foreign, and the least mass it needs to be judged.
CLASS_LIMIT, CLASS_CHARS = 0.08, 300
COMMON_LIMIT, COMMON_WORDS = 0.07, 150


def _classes(text: Column, rest: Column, word_chars: Column) -> Column:
    """Code points of each class, in the order of CLASSES; ``rest`` is the text without a-z and blanks."""
    n, left = F.length(text), F.length(rest)
    of = [left - F.length(F.regexp_replace(rest, p, "")) for p in (r"\p{Lu}+", r"[0-9]+", r"[.,;:!?'\"()-]+", r"[#*$%&|<>@^~=+_/\\{}\[\]`]+")]
    return bind(F.array(*of), lambda a: F.transform(F.concat(
        F.array(word_chars - left, a[0], a[1], n - word_chars, a[2], a[3]),
        F.array(left - a[0] - a[1] - a[2] - a[3])), lambda x: x.cast("long")))


def _listed(ws: Column, listed: tuple[str, ...]) -> Column:
    return F.filter(F.transform(ws, F.lower), lambda w: w.isin(*listed))


def _common(ws: Column, lang: Column) -> Column:
    """Counts of the common words of the row's language, all other words last; no list: one bin."""
    kept = F.lit(None).cast("array<string>")
    names = F.lit(None).cast("array<string>")
    for code, listed in COMMON.items():
        kept = F.when(lang == code, _listed(ws, listed)).otherwise(kept)
        names = F.when(lang == code, F.array(*map(F.lit, listed))).otherwise(names)
    counted = bind(F.struct(kept.alias("k"), names.alias("n"), F.size(ws).cast("long").alias("all")), lambda b: F.concat(
        F.transform(b["n"], lambda name: F.size(F.filter(b["k"], lambda w: w == name)).cast("long")),
        F.array(b["all"] - F.size(b["k"]))))
    return F.coalesce(counted, F.array(F.size(ws).cast("long")))


def _joined(span: int):
    rest = lambda a: F.greatest(F.size(a) - span, F.lit(0))
    return lambda a: F.zip_with(F.slice(a, F.lit(1), rest(a)), F.slice(a, F.lit(1 + span), rest(a)), lambda x, y: F.xxhash64(x, y))


def _repeated(ws: Column) -> Column:
    """Words inside an 8-word window that is found twice or more; sorts (window hash, place) within the row."""
    places = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    found = lambda a: F.array_sort(F.transform(F.filter(a, lambda x, i: (
        ((i > 0) & (F.get(a, i - 1)["h"] == x["h"])) | F.coalesce(F.get(a, i + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"]))
    covered = lambda at: F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda s, i: F.struct(
        (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])
    hashes, span = F.transform(ws, lambda w: F.xxhash64(w)), 1
    while span < WINDOW:  # hashes of runs of 1, 2, 4 and 8 words
        hashes, span = bind(hashes, _joined(span)), 2 * span
    counted = bind(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), bind(places(h), lambda a: bind(found(a), covered))).otherwise(0))
    return F.when(F.size(ws) > WINDOW, counted).otherwise(0).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """Counts of each document beside its language and its two histograms."""
    base = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    lines = bind(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda a: F.size(a) - F.size(F.array_distinct(a)))
    count = lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        _repeated(ws).alias("n_repeat_words"), _common(ws, F.col("lang")).alias("common"))
    marks = lambda rest: F.struct(
        (F.length(rest) - F.length(F.translate(rest, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _classes(text, rest, F.length(F.regexp_replace(text, BLANK_RUN, ""))).alias("classes"))
    row, mark = bind(words(text), count), bind(F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", ""), marks)
    return base.select("doc_id", "lang", row.alias("row"), mark.alias("mark"), lines.cast("long").alias("n_dup_lines")).select(
        "doc_id", "lang", "row.*", "mark.*", "n_dup_lines")


def references(measured: DataFrame) -> DataFrame:
    """Per language the sums of both histograms over all documents that pass the base rules."""
    good = measured.filter(~_base_failed())
    wide = [F.sum(F.get(F.col("classes"), F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    most = max(map(len, COMMON.values())) + 1
    wide += [F.sum(F.get(F.col("common"), F.lit(i))).alias(f"w{i}") for i in range(most)]
    summed = good.groupBy("lang").agg(*wide)
    return summed.select(
        F.col("lang").alias("ref_lang"), F.array(*[f"c{i}" for i in range(len(CLASSES))]).alias("ref_classes"),
        F.filter(F.array(*[f"w{i}" for i in range(most)]), lambda x: x.isNotNull()).alias("ref_common"))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def divergence(a: Column, b: Column) -> Column:
    """Jensen-Shannon divergence in bits of two histograms; NULL if one is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
    share = lambda x: bind(F.struct(x.alias("x"), total(x).alias("t")), lambda s: F.transform(
        s["x"], lambda v: F.when(s["t"] > 0, v.cast("double") / s["t"])))
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.when(p.isNotNull(), 0.0))
    terms = F.zip_with(share(a), share(b), lambda p, q: bind((p + q) / 2, lambda m: (part(p, m) + part(q, m)) / 2))
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Base counts and the verdict of the divergence from the language's own reference.

    A document's character classes and common words are compared with the sums of its language over all documents
    that pass the base rules.  A histogram is judged only with enough mass (``CLASS_CHARS`` characters,
    ``COMMON_WORDS`` words); below that the document keeps the verdict of the base rules.

    NULL text counts as empty and fails the base rules (no words); NULL language is a language of its own; a language
    without a word list has a one-bin word histogram, which never diverges; repeated rows and ids are judged one by
    one; an empty table gives an empty result.  Whole texts are measured, of any length, in one pass without a shuffle;
    only one row per language and task is shuffled.
    """
    measured = written(measures(docs), "quality-measures")
    judged = measured.join(references(measured), F.col("lang") == F.col("ref_lang"), "left")
    class_js, common_js = divergence(F.col("classes"), F.col("ref_classes")), divergence(F.col("common"), F.col("ref_common"))
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda x, y: x + y)
    judged = judged.withColumn("class_divergence", F.when(chars >= CLASS_CHARS, class_js)).withColumn(
        "common_divergence", F.when(F.col("n_words") >= COMMON_WORDS, common_js))
    foreign = (F.coalesce(F.col("class_divergence") > CLASS_LIMIT, F.lit(False))
               | F.coalesce(F.col("common_divergence") > COMMON_LIMIT, F.lit(False)))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _base_failed().alias("base_failed"),
        (~_base_failed() & ~foreign).alias("kept"), "class_divergence", "common_divergence")


def oracle() -> str:
    """DuckDB SQL for the contract columns of :func:`quality_rules`."""
    listed = " ".join(f"WHEN '{code}' THEN [{', '.join(repr(x) for x in names)}]" for code, names in COMMON.items())

    def without(text: str, pattern: str) -> str:
        return f"length(regexp_replace({text}, '{pattern}', '', 'g'))"

    def shares(name: str) -> str:
        """Divergence per row of the histogram ``name`` from that of its language."""
        half = lambda p: f"CASE WHEN {p} > 0 THEN {p} * log2({p} / ((p + q) / 2)) ELSE 0 END"
        return f"""
{name}_cells AS (SELECT r, lang, failed, generate_subscripts({name}, 1) AS k, unnest({name}) AS v FROM h),
{name}_ref AS (SELECT lang, k, CAST(sum(v) AS DOUBLE) AS v FROM {name}_cells WHERE NOT failed GROUP BY lang, k),
{name}_share AS (SELECT lang, k, v / nullif(sum(v) OVER (PARTITION BY lang), 0) AS q FROM {name}_ref),
{name}_own AS (SELECT r, lang, k, v / nullif(CAST(sum(v) OVER (PARTITION BY r) AS DOUBLE), 0) AS p, sum(v) OVER (PARTITION BY r) AS mass FROM {name}_cells),
{name}_js AS (SELECT r, max(mass) AS mass, sum(({half('p')} + {half('q')}) / 2) AS js FROM {name}_own JOIN {name}_share USING (lang, k) GROUP BY r)"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, regexp_replace(text, '[a-z\\x20\\x09-\\x0D]+', '', 'g') AS rest,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l,
  CASE lang {listed} ELSE [] END AS names FROM d),
i AS (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 8),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(list_slice(w, i, i + 7), ' ')) AS times FROM i),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (SELECT unnest(range(8)) AS k) WHERE times > 1 GROUP BY r),
m AS (SELECT w.r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST({without('text', '[\\x20\\x09-\\x0D]+')} AS BIGINT) AS word_chars,
  CAST(length(text) - {without('text', '[#*$%&|<>]')} AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, length(text) AS size, length(rest) AS more,
  length(rest) - {without('rest', chr(92) + 'p{Lu}+')} AS u, length(rest) - {without('rest', '[0-9]+')} AS g,
  length(rest) - {without('rest', '[.,;:!?' + chr(39) * 2 + '"()-]+')} AS p,
  length(rest) - {without('rest', '[#*$%&|<>@^~=+_/' + chr(92) * 2 + '{}' + chr(92) + '[' + chr(92) + ']`]+')} AS s,
  list_transform(names, lambda x: len(list_filter(w, lambda y: lower(y) = x))) AS hits FROM w LEFT JOIN c ON c.r = w.r),
h AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS failed,
  [word_chars - more, u, g, size - word_chars, p, s, more - u - g - p - s] AS classes,
  list_append(hits, n_words - coalesce(CAST(list_sum(hits) AS BIGINT), 0)) AS common FROM m),
{shares('classes')},
{shares('common')}
SELECT h.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
  NOT failed AND NOT coalesce(a.js > {CLASS_LIMIT} AND a.mass >= {CLASS_CHARS}, FALSE) AND NOT coalesce(b.js > {COMMON_LIMIT} AND n_words >= {COMMON_WORDS}, FALSE) AS kept
FROM h LEFT JOIN classes_js a ON a.r = h.r LEFT JOIN common_js b ON b.r = h.r
"""
