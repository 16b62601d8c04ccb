"""URL filters: domain rules, then a weighted vocabulary found by an Aho-Corasick automaton.

A rule is a host and the start of a path; it fits the host and all its subdomains, and of
those that fit the longest decides. Where none fits, every term of the vocabulary is looked for in the
lower-cased URL at once. A term counts where the characters before and after it are not letters or
digits, once however often it stands there. A term of weight `limit` or more is strict and blocks the URL by itself; soft terms block it when
the distinct ones weigh `limit` together, which takes at least two.

The vocabulary is a list of (term, weight) or a table of the columns term and weight. A table is gathered, and is refused beyond `MOST_TERMS` rows.

Defined results: a null URL, or one without ://, has an empty host and path and fits no rule (terms still count);
a URL of any length is searched to its end; overlapping terms count each; null or empty terms and terms without a weight are no terms, and of a term's
several weights the highest counts; without terms only rules block; repeated rows are judged alike; an empty table gives no rows. Only the id and URL columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.url_terms import LIMIT, VOCABULARY

MOST_TERMS = 1_000_000

#: The rules of the contract, as (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def cut(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    stop = min((k for k in (rest.find(c, end) for c in "?#") if k >= 0), default=len(rest))
    return rest[:end].translate(_FOLD), rest[end:stop]


class UrlJudge:
    def __init__(self, rules=RULES, terms=VOCABULARY, limit: int = LIMIT):
        import ahocorasick

        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
            self.by_host.setdefault(host, []).append((path, host + path, verdict))
        self.limit, self.weight, self.find = limit, weights(terms), ahocorasick.Automaton()
        for term in self.weight:
            self.find.add_word(term, term)
        self.find.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        at = 0
        while host and at >= 0:
            for start, name, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start):
                    if best[0] is None or len(name) > len(best[0]):
                        best = (name, verdict)
                    break
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return best

    def terms(self, url: str | None) -> tuple[int, int, int]:
        """Distinct strict and soft terms, and what they weigh."""
        text = (url or "").translate(_FOLD)
        found = set()
        for end, term in self.find.iter(text) if self.weight else ():
            start = end + 1 - len(term)
            if (start == 0 or text[start - 1] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
                found.add(term)
        strict = sum(self.weight[t] >= self.limit for t in found)
        return strict, len(found) - strict, sum(self.weight[t] for t in found)


def weights(terms) -> dict[str, int]:
    """The weight of each term."""
    out: dict[str, int] = {}
    for term, weight in terms:
        if term and weight is not None:
            term = term.translate(_FOLD)
            out[term] = max(int(weight), out.get(term, 0))
    return out


def vocabulary(table: DataFrame) -> list[tuple[str, int]]:
    """The terms of a table, if they are few enough to be held by every task."""
    rows = table.select("term", "weight").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary has at most {MOST_TERMS} terms")
    return [tuple(r) for r in rows]


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, terms=VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, the distinct strict and soft terms of each URL, and their weight."""
    terms = vocabulary(terms) if isinstance(terms, DataFrame) else terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = UrlJudge(rules, terms, limit)
        for batch in batches:
            hosts, paths, names, verdicts, hard, mild, heft = [], [], [], [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = cut(url)
                name, verdict = known.rule(host, path)
                a, b, weight = known.terms(url)
                hosts.append(host)
                paths.append(path)
                names.append(name)
                verdicts.append(verdict or ("block" if weight >= limit else "allow"))
                hard.append(a)
                mild.append(b)
                heft.append(weight)
            text, whole = pa.string(), pa.int64()
            yield pa.record_batch([batch.column(0), pa.array(hosts, text), pa.array(paths, text), pa.array(names, text), pa.array(verdicts, text), pa.array(hard, whole), pa.array(mild, whole), pa.array(heft, whole)], names=["page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms", "weight"])

    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    return narrow.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, strict_terms long, soft_terms long, weight long")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_TERMS = ", ".join(f"('{t}', {w})" for t, w in VOCABULARY)
_FITS = ", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in RULES)

OP1_SQL = f"""
WITH p AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(rh, rp, rv) AS (VALUES {_FITS}), fit AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
), terms(term, weight) AS (VALUES {_TERMS}), t AS (
  SELECT page_id, CAST(count_if(weight >= {LIMIT}) AS BIGINT) AS strict_terms, CAST(count_if(weight < {LIMIT}) AS BIGINT) AS soft_terms, CAST(sum(weight) AS BIGINT) AS weight
  FROM p JOIN terms ON contains(u, term) AND regexp_matches(u, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(rv, CASE WHEN coalesce(weight, 0) >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(strict_terms, 0) AS strict_terms, coalesce(soft_terms, 0) AS soft_terms, coalesce(weight, 0) AS weight
FROM p LEFT JOIN t USING (page_id) LEFT JOIN fit USING (page_id)
"""
