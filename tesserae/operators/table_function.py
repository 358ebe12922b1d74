"""Profile search as a table function for SQL; tables are better searched with `search`, which works on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..sources.profiles import Profile
from .kernels import Kernel


def register(spark: SparkSession, profiles: Sequence[Profile], name: str = "profile_search") -> None:
    """Make name(sequence, profile_id) known to SQL: the rank, score, cycles, places and letters of each alignment.

    profile_id counts profiles from 0; the cut-off is each profile's level 0. A null sequence or profile has no rows.
    """

    class ProfileSearch:
        def __init__(self) -> None:
            self.kernels = [(Kernel(p), p.level(0)["score"]) for p in profiles]

        def eval(self, sequence: str, profile_id: int) -> Iterator[tuple]:
            if sequence is not None and profile_id is not None:
                kernel, bound = self.kernels[profile_id]
                letters = "".join(c for c in sequence if c.isascii() and c.isalpha()).upper()
                for rank, hit in enumerate(kernel.hits(letters, bound), 1):
                    yield rank, hit.score, hit.cycles, hit.seq_begin, hit.seq_end, hit.states, hit.aligned

    spark.udtf.register(name, udtf(ProfileSearch, returnType="rank int, score int, cycles int, seq_begin int, seq_end int, states string, aligned string"))


TEXTS, LETTERS = 1 << 10, 1 << 18  # rows and letters that the function on tables holds


def register_table(spark: SparkSession, profiles: Sequence[Profile], name: str = "profile_search_table") -> None:
    """Make name(TABLE(rows), profile_id) known to SQL: the rows' first column, a key, and what `register` gives of their second.

    Sequences are aligned side by side, many at once; the lateral form takes each alone.
    """

    class ProfileSearchTable:
        def __init__(self) -> None:
            self.kernels = [(Kernel(p), p.level(0)["score"]) for p in profiles]
            self.rows: list[tuple] = []
            self.profile, self.letters = None, 0

        @staticmethod
        def analyze(rows: AnalyzeArgument, profile_id: AnalyzeArgument) -> AnalyzeResult:
            first, *numbers, states, aligned = rows.dataType.fields[0], "rank", "score", "cycles", "seq_begin", "seq_end", "states", "aligned"
            schema = StructType().add(first.name, first.dataType)
            for n in numbers:
                schema = schema.add(n, IntegerType())
            return AnalyzeResult(schema.add(states, StringType()).add(aligned, StringType()))

        def eval(self, row, profile_id: int) -> Iterator[tuple]:
            if row[1] is not None and profile_id is not None:
                text = "".join(c for c in row[1] if c.isascii() and c.isalpha()).upper()
                if self.rows and profile_id != self.profile:
                    yield from self.found()
                self.profile = profile_id
                self.rows.append((row[0], text))
                self.letters += len(text)
                if len(self.rows) >= TEXTS or self.letters >= LETTERS:
                    yield from self.found()

        def found(self) -> Iterator[tuple]:
            kernel, bound = self.kernels[self.profile]
            rows, self.rows, self.letters = self.rows, [], 0
            for (key, _), hits in zip(rows, kernel.many_hits([text for _, text in rows], bound), strict=True):
                for rank, hit in enumerate(hits, 1):
                    yield key, rank, hit.score, hit.cycles, hit.seq_begin, hit.seq_end, hit.states, hit.aligned

        def terminate(self) -> Iterator[tuple]:
            if self.rows:
                yield from self.found()

    spark.udtf.register(name, udtf(ProfileSearchTable))
