"""Licence scans with a positional rare-token index, in DataFrame functions only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased. The words' document frequencies come from
the whole table. A place fits a template of n words if at least m = ceil(`MATCH` n) of them stand there. Of any n - m + `AGREE` places in the template, `AGREE` are then
among the fitting ones, so the index holds just so many for each template: those of its rarest words (highest IDF).
It maps a word to postings (template, place). The postings of a file's words, minus where the words stand, give starts; a
start that `AGREE` postings share is where the template may stand, and no fitting place is missed, whatever the frequencies
are. There the template's words are held against the file's, and the mandatory key phrases of those that fit are verified last.
The index and the templates are tables that the expressions look up, so their size does not grow with the number of licences.

The base is apart from that: all places where a phrase's words stand consecutively.

Defined results: a null or empty text has no words, labels or score; the score is 1 with a base label, else the best share of a
place that fits, else 0; places that overlap all count; files are judged row by row, so
repeated rows get equal results; an empty table gives no rows. Only the id and text columns are
read, so other columns may have any name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.licence_texts import TEMPLATES

AGREE = 2
MATCH_PERCENT = 80
_START = 1 << 30
_SHIFT = 1 << 32

#: The base phrases and labels of the contract.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_in(notice: str) -> list[str]:
    """The words of a template, as the scan takes them."""
    return [w for w in re.split(_GAP, notice.translate(str.maketrans(UPPER, LOWER))) if w]


def least_fit(n: int) -> int:
    return -(-MATCH_PERCENT * n // 100)


def anchors(words: list[str], df: dict[str, int]) -> list[int]:
    """Places of the index: the rarest words, each at its first place; later places only where the words don't suffice."""
    first = {w: k for k, w in reversed(list(enumerate(words)))}
    order = sorted(range(len(words)), key=lambda k: (first[words[k]] != k, df.get(words[k], 0), words[k], k))
    return order[: min(len(words), len(words) - least_fit(len(words)) + AGREE)]


def normal(text: Column) -> Column:
    """Words with one blank before, between and after them; one blank if there are none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _GAP, " ")), F.lit(" "))


def _texts(items) -> Column:
    return F.array(*(F.lit(x) for x in items)) if items else F.array().cast("array<string>")


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each word of the (fixed, small) vocabulary stands."""
    # A regular expression would try every word at every place; the set of a text's words is built once.
    found = docs.select(F.explode(F.array_intersect(_texts(vocabulary), F.split(normal(F.col(text_col)), " "))).alias("w"))
    counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def _literal(value) -> Column:
    """A constant of nested lists, text and whole numbers."""
    return F.array(*(_literal(x) for x in value)) if isinstance(value, (list, tuple)) else F.lit(value)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row for each file: base counts and places, labels, score, and the places that fit (label, first word, share)."""
    notices = [words_in(notice) for _, notice, _ in templates]
    if any(len(words) < AGREE for words in notices):
        raise ValueError(f"a template has at least {AGREE} words")
    df = frequencies(docs, sorted({w for words in notices for w in words}), text_col)
    index: dict[str, list[tuple[int, int]]] = {}
    for t, words in enumerate(notices):
        for k in anchors(words, df):
            index.setdefault(words[k], []).append((t, k))
    rare = sorted(index)
    postings = F.create_map(*(x for w in rare for x in (F.lit(w), _literal([t * _SHIFT + _START - k for t, k in index[w]]))))
    few = AGREE if all(len({words[k] for k in anchors(words, df)}) == len(anchors(words, df)) for words in notices) else 1
    phrases = "|".join(p for p, _ in BASE)
    place = f" (?:{phrases})(?= )"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normal(F.col(text_col)).alias("t"))
    rows = rows.select("doc_id", "t", F.when(F.col("t") == "  ", 0).otherwise(_blanks(F.col("t")) - 1).cast("long").alias("n_words"), *(F.contains("t", F.lit(f" {p} ")).alias(f"b{i}") for i, (p, _) in enumerate(BASE)), F.split(F.substring("t", 2, 2147483647), " ").alias("tokens"))
    any_base = F.greatest(*(F.col(f"b{i}") for i in range(len(BASE))))
    rows = rows.select(
        "doc_id", "n_words", "t", _base_labels().alias("base"),
        F.when(any_base, F.regexp_count("t", F.lit(place))).otherwise(0).cast("long").alias("n_base"),
        F.when(any_base, _blanks(F.get(F.split("t", place, 2), F.lit(0)))).cast("long").alias("first_word"),
        F.when(any_base, _blanks(F.regexp_extract("t", f"(?s)^(.*){place}", 1))).cast("long").alias("last_word"),
        F.when(F.size(F.array_intersect(_texts(rare), "tokens")) >= few, F.col("tokens")).alias("tokens"),
    )
    # Look up: the file's rare words and where they stand; then their postings, as starts of templates.
    rows = rows.withColumn("hits", F.filter(F.transform("tokens", lambda w, i: F.when(w.isin(rare), F.struct(w.alias("w"), i.alias("p")))), lambda h: h.isNotNull()))
    rows = rows.withColumn("starts", F.array_sort(F.flatten(F.transform("hits", lambda h: F.transform(F.element_at(postings, h["w"]), lambda x: x + h["p"])))))
    # Intersect: starts that AGREE postings share.
    rows = rows.withColumn("shared", F.array_distinct(F.filter("starts", lambda x, i: x == F.get(F.col("starts"), i - (AGREE - 1)))))
    all_words, least, labels = _literal(notices), _literal([least_fit(len(words)) for words in notices]), _literal([label for label, _, _ in templates])

    def judged(x: Column) -> Column:
        t, at = F.floor(x / _SHIFT).cast("int"), (F.pmod(x, F.lit(_SHIFT)) - _START).cast("int")
        fit = F.size(F.filter(F.get(all_words, t), lambda w, k: F.get(F.col("tokens"), at + k) == w))
        return F.struct(t.alias("t"), at.alias("word"), fit.alias("fit"))

    rows = rows.withColumn("fits", F.filter(F.transform("shared", judged), lambda x: x["fit"] >= F.get(least, x["t"])))
    keys = _literal([[f" {k} " for k in needed] for _, _, needed in templates])
    rows = rows.withColumn("held", F.filter("fits", lambda x: F.forall(F.get(keys, x["t"]), lambda k: F.contains(F.col("t"), k))))
    found = F.transform("held", lambda x: F.struct(F.get(labels, x["t"]).alias("label"), x["word"].cast("long").alias("word"), (x["fit"] / F.size(F.get(all_words, x["t"]))).alias("share")))
    rows = rows.withColumn("places", F.coalesce(found, F.array().cast("array<struct<label:string,word:bigint,share:double>>")))
    own = F.transform("places", lambda x: x["label"])
    best = F.coalesce(F.array_max(F.transform("places", lambda x: x["share"])), F.lit(0.0))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_sort("base").alias("base_labels"), F.array_sort(F.array_union("base", own)).alias("labels"), F.when(F.size("base") > 0, 1.0).otherwise(best).alias("score"), F.array_sort("places").alias("places"))


def _base_labels() -> Column:
    return F.filter(F.array(*(F.when(F.col(f"b{i}"), F.lit(label)) for i, (_, label) in enumerate(BASE))), lambda x: x.isNotNull())


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


_VALUES = ", ".join(f"({t}, '{label}', '{w}', {k})" for t, (label, notice, _) in enumerate(TEMPLATES) for k, w in enumerate(words_in(notice)))
_KEYS = ", ".join(f"({t}, '{k}')" for t, (_, _, keys) in enumerate(TEMPLATES) for k in keys)
_BASES = ", ".join(f"('{p}', '{label}')" for p, label in BASE)

#: No index: every word of every template is held against every word of a text.
OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), n AS (
  SELECT doc_id, ' ' || array_to_string(ws, ' ') || ' ' AS t FROM d
), tw(t, label, w, k) AS (VALUES {_VALUES}), tk(t, key) AS (VALUES {_KEYS}), bp(phrase, blabel) AS (VALUES {_BASES}),
tn AS (
  SELECT t, count(*) AS len FROM tw GROUP BY t
), p AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM d
), fit AS (
  SELECT doc_id, t, label, p - k AS at, count(*) AS fit FROM p JOIN tw USING (w) GROUP BY 1, 2, 3, 4
), own AS (
  SELECT fit.doc_id, label, fit / CAST(len AS DOUBLE) AS score FROM fit JOIN tn USING (t) JOIN n ON n.doc_id = fit.doc_id
  WHERE 100 * fit >= {MATCH_PERCENT} * len AND NOT EXISTS (SELECT 1 FROM tk WHERE tk.t = fit.t AND NOT contains(n.t, ' ' || key || ' '))
), places AS (
  SELECT DISTINCT p.doc_id, p.p, blabel FROM p JOIN d USING (doc_id), bp
  WHERE p.w = split_part(phrase, ' ', 1) AND array_to_string(d.ws[p.p + 1 : p.p + len(string_split(phrase, ' '))], ' ') = phrase
), base AS (
  SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT blabel, ',' ORDER BY blabel) AS base_labels FROM places GROUP BY doc_id
), labels AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (
    SELECT doc_id, label FROM own UNION SELECT doc_id, blabel FROM places) GROUP BY doc_id
), best AS (
  SELECT doc_id, max(score) AS score FROM own GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(score, CAST(0 AS DOUBLE)) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN best USING (doc_id)
"""
