"""Retrieval indexes as tables: postings and vectors are written once and read by later runs and stages. Never pickled."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.text import tokens
from strandmill.operators.ranking import Corpus, corpus_of, postings
from strandmill.sources.files import Place

PARTS = ("postings", "terms", "scopes", "documents")
SLOTS = 1 << 16


def slot(*scope: str) -> Column:
    """Where a scope stands among SLOTS places: tables in this order are read in ranges of it."""
    return F.pmod(F.xxhash64(*scope), F.lit(SLOTS)).cast("int")


def within(frame: DataFrame, slots: tuple[int, int], column: str | None, *scope: str) -> DataFrame:
    """Rows of the slots from the first number to below the second; without a column that holds the slot it is worked out."""
    place = F.col(column) if column else slot(*scope)
    return frame.where((place >= slots[0]) & (place < slots[1]))


class TextIndex:
    """A corpus for BM25 that grows: each batch of records adds its postings, records, and its own document frequencies and sizes.

    A batch counts once its commit file is there, which is written last; a batch that was lost on the way is written anew, and one that is
    committed is not added again. Statistics of several batches are sums of theirs, so an index that was appended to answers
    as one that was built from all records. Postings are in the order of terms, dealt by ranges of term and record, so a frequent term
    is in several files and a file is about few terms. With a scope they are dealt by ranges of its slots and of records, before a text is cut into terms, and a file
    is in the order of slots and terms; terms are in the order of slots, too: some scopes are read without the others."""

    def __init__(self, place: str | Place, scope: Sequence[str] = ("sample_id",), tokenise: Callable[[Column], Column] = tokens):
        self.place, self.scope, self.tokenise = Place(place), list(scope), tokenise

    def batches(self) -> list[str]:
        return (self.place / "commits").children()

    def _part(self, name: str, batch: str) -> Place:
        return self.place / name / f"batch={batch}"

    def append(self, records: DataFrame, batch: str | None = None, text: str = "text") -> str:
        """Adds records (scope, record_id, text, and pos if they have it), none of which is there yet. Gives the batch's name."""
        self._settle()
        batch = batch or uuid.uuid4().hex
        if batch in self.batches():
            return batch
        new = corpus_of(records, self.scope, self.tokenise, text)
        if self.scope:
            # Dealing postings by ranges would make them twice, as the ranges come from a sample of them; and there are many more of them than records.
            dealt = corpus_of(records.repartitionByRange(slot(*self.scope), *self.scope, "record_id"), self.scope, self.tokenise, text).postings
            ordered = dealt.withColumn("_slot", slot(*self.scope)).sortWithinPartitions("_slot", "term", *self.scope, "record_id")
        else:
            ordered = self._ordered("postings", new.postings)
        ordered.write.mode("overwrite").parquet(str(self._part("postings", batch)))
        written = records.sparkSession.read.parquet(str(self._part("postings", batch)))
        keys = ["_slot", "term", *self.scope] if self.scope else ["term"]
        # Counted where they are written, in one shuffle.
        terms = (written.select(*keys).repartitionByRange(*keys) if self.scope else written).groupBy(*keys).agg(F.count("*").alias("df"))
        (terms.sortWithinPartitions(*keys) if self.scope else terms).write.mode("overwrite").parquet(str(self._part("terms", batch)))
        for name, frame in (("scopes", new.scopes), ("documents", new.documents)):
            self._ordered(name, frame).write.mode("overwrite").parquet(str(self._part(name, batch)))
        (self.place / "commits" / batch).write_text("")
        return batch

    def _ordered(self, name: str, frame: DataFrame) -> DataFrame:
        """A part as it is written."""
        frame = frame.withColumn("_slot", slot(*self.scope)) if self.scope else frame
        keys = {"postings": ["term", *self.scope, "record_id"], "terms": ["term", *self.scope] if self.scope else []}.get(name)
        if not keys:
            return frame
        keys = ["_slot", *keys] if self.scope else keys
        return frame.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def drop(self, batch: str) -> None:
        """Takes a batch out; its commit goes first."""
        (self.place / "commits" / batch).delete()
        for name in PARTS:
            self._part(name, batch).delete()

    def _settle(self) -> None:
        """Ends a compaction that got as far as naming its batch: the others go, then it is committed like any."""
        aside = self.place / "aside"
        if not aside.exists():
            return
        new = aside.read_text()
        for batch in self.batches():
            if batch != new:
                self.drop(batch)
        (self.place / "commits" / new).write_text("")
        aside.delete()

    def compact(self) -> str:
        """All batches as one. Readers see the old ones until the new one is written whole and named, and it alone from then on."""
        self._settle()
        new, held = uuid.uuid4().hex, self.corpus(self.place.spark)
        for name in PARTS:
            self._ordered(name, getattr(held, name)).write.parquet(str(self._part(name, new)))
        (self.place / "aside").write_text(new)
        self._settle()
        return new

    def corpus(self, spark: SparkSession, slots: tuple[int, int] | None = None) -> Corpus:
        """All scopes, or those whose slot is at least the first number and below the second."""
        aside = self.place / "aside"
        batches = [aside.read_text()] if aside.exists() else self.batches()
        if not batches:
            raise FileNotFoundError(f"no index at {self.place}")
        held = {name: spark.read.parquet(*(str(self._part(name, b)) for b in batches)) for name in PARTS}
        if slots is not None:
            # Batches of before slots were written have no such column.
            known = all("_slot" in spark.read.parquet(str(self._part("scopes", b))).columns for b in batches)
            held = {name: within(frame, slots, "_slot" if known else None, *self.scope) for name, frame in held.items()}
        held = {name: frame.drop("_slot") for name, frame in held.items()}
        if len(batches) > 1:
            held["terms"] = held["terms"].groupBy(*self.scope, "term").agg(F.sum("df").alias("df"))
            held["scopes"] = held["scopes"].groupBy(*self.scope).agg(F.sum("N").alias("N"), F.sum("tokens").alias("tokens"))
        return Corpus(self.scope, held["postings"], held["terms"], held["scopes"], held["documents"])


def save_text_index(records: DataFrame, path: str, keys: tuple[str, ...] = ("sample_id", "record_id"), **options) -> None:
    """Terms of each record with their counts."""
    postings(records, list(keys), **options).write.mode("overwrite").parquet(f"{path}/postings")


def save_vector_index(records: DataFrame, path: str, keys: tuple[str, ...] = ("sample_id", "record_id"), vector: str = "vector") -> None:
    records.select(*keys, vector).write.mode("overwrite").parquet(f"{path}/vectors")


def load_index(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """postings or vectors; a missing index is an error."""
    if kind not in ("postings", "vectors"):
        raise ValueError(f"an index has postings or vectors, not {kind!r}")
    return spark.read.parquet(f"{path}/{kind}")
