"""Answer metrics as columns: exact match, token F1 over sets, BLEU-1 over multisets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandmill.functions.text import fold, let, strip, tokens


def exact_match(prediction: Column, reference: Column) -> Column:
    return (fold(strip(prediction)) == fold(strip(reference))).cast("double")


def f1(prediction: Column, reference: Column) -> Column:
    def score(x: Column) -> Column:
        common, n, m = F.size(F.array_intersect(x["p"], x["r"])).cast("double"), F.size(x["p"]), F.size(x["r"])
        return F.when((n == 0) | (m == 0), 0.0).otherwise(let(common, lambda c: F.when(c == 0, 0.0).otherwise(2 * (c / n) * (c / m) / (c / n + c / m))))

    return let(F.struct(F.array_distinct(tokens(prediction)).alias("p"), F.array_distinct(tokens(reference)).alias("r")), score)


def _numbered(found: Column) -> Column:
    """The tokens, each with how many equal ones stand before it: then all differ. Sorted, so that equal ones are neighbours; a blank is in no token."""

    def number(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        each = lambda at: F.flatten(F.transform(at, lambda i, k: F.transform(F.slice(s, i + 1, F.coalesce(F.get(at, k + 1), F.size(s)) - i), lambda t, n: F.concat(t, F.lit(" "), n.cast("string")))))
        return F.when(F.size(s) > 0, let(starts, each)).otherwise(s)

    return let(F.array_sort(found), number)


def bleu1(prediction: Column, reference: Column) -> Column:
    # A token of both counts as often as it stands in the one that has it less often: numbered tokens are sets.
    def score(x: Column) -> Column:
        n, m = F.size(x["p"]), F.size(x["r"])
        brevity = F.when(n >= m, 1.0).otherwise(F.exp(1.0 - m / n))
        return F.when((n == 0) | (m == 0), 0.0).otherwise(brevity * F.size(F.array_intersect(x["p"], x["r"])) / n)

    return let(F.struct(_numbered(tokens(prediction)).alias("p"), _numbered(tokens(reference)).alias("r")), score)


METRICS = {"exact_match": exact_match, "f1": f1, "bleu1": bleu1}


def metric_map(names: list[str], prediction: Column, reference: Column) -> Column:
    """A map of the named metrics; an unknown name is an error."""
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise ValueError(f"unsupported metric {unknown[0]!r}; available: {', '.join(sorted(METRICS))}")
    return F.create_map(*(x for n in names for x in (F.lit(n), METRICS[n](prediction, reference)))) if names else F.create_map().cast("map<string,double>")
