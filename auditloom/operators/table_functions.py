"""Detectors as SQL table functions: a user's Python detector reads the lines of one file after another and runs where Spark has dealt them.

``SELECT * FROM name(TABLE(lines), 'HIGH')``: the function asks for its argument by file and in line order itself, so a file's lines meet in one task in order and nothing holds a whole file. Its columns and what it needs of the table are told
by its analysis, before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}

#: A detector takes the lines (number, text) of one file in order and yields (rule_id, severity, line_number, snippet).
Detector = Callable[[Iterator[tuple[int, str]]], Iterator[tuple[str, str, int, str]]]

COLUMNS = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("rule_id", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("line_number", T.IntegerType()), T.StructField("snippet", T.StringType())])


def table_function(make: Callable[[], object]):
    """A table function of a stateful detector: ``make()`` gives an object for each file, whose ``line(number, text)`` and ``end()`` yield findings (rule_id, severity, line_number, snippet).

    Arguments: a table with file_path, line_number and line, and optionally the least severity that is given out. Rows without a path are one file without a name.
    """

    class Detect:
        def __init__(self):
            self.detector = make()
            self.path = None
            self.least = 0

        @staticmethod
        def analyze(lines: AnalyzeArgument, least: AnalyzeArgument | None = None) -> AnalyzeResult:
            names = {f.name for f in lines.dataType.fields} if lines.isTable else set()
            missing = {"file_path", "line_number", "line"} - names
            if missing:
                raise ValueError(f"a table with file_path, line_number and line is needed; missing: {', '.join(sorted(missing))}")
            if least is not None and least.value not in RANK:
                raise ValueError(f"the least severity is one of {', '.join(RANK)}")
            return AnalyzeResult(COLUMNS, partitionBy=[PartitioningColumn("file_path")], orderBy=[OrderingColumn("line_number")])

        def _given(self, found):
            for rule_id, severity, number, snippet in found:
                if RANK.get(severity, 0) >= self.least:
                    yield self.path, rule_id, severity, number, snippet

        def eval(self, row, least=None):
            self.path, self.least = row["file_path"], RANK.get(least, 0)
            yield from self._given(self.detector.line(row["line_number"], row["line"] or ""))

        def terminate(self):
            yield from self._given(self.detector.end())

    return udtf(Detect)


def register(spark: SparkSession, name: str, make: Callable[[], object]) -> None:
    """Makes a detector known to SQL by ``name``."""
    spark.udtf.register(name, table_function(make))


class RepeatedLines:
    """Runs of equal lines with a word in them: one finding a run, HIGH from ``many`` lines on, at the run's first line."""

    def __init__(self, many: int = 3):
        self.many, self.first, self.text, self.n = many, 0, None, 0

    def _run(self):
        if self.text is not None and self.n > 1 and self.text.strip():
            yield "LINES-repeated", "HIGH" if self.n >= self.many else "LOW", self.first, self.text[:100]

    def line(self, number: int, text: str):
        if text == self.text:
            self.n += 1
            return
        yield from self._run()
        self.first, self.text, self.n = number, text, 1

    def end(self):
        yield from self._run()
