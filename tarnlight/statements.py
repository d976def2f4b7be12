"""Statements by name, parsed once, with what their runs cost."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from .errors import QueryError
from .operators.writes import Database
from .plans.parser import parse


@dataclass
class Named:
    text: str
    parsed: list
    runs: int = 0
    failures: int = 0
    seconds: float = 0.0
    longest: float = 0.0


@dataclass
class Statements:
    """Names of a database's statements. A name is bound once; binding the same text again changes nothing."""

    db: Database
    named: dict[str, Named] = field(default_factory=dict)

    def define(self, name: str, text: str) -> None:
        if name in self.named and self.named[name].text != text:
            raise QueryError(f"{name} is another statement already")
        self.named.setdefault(name, Named(text, parse(text)))

    def drop(self, name: str) -> None:
        self.named.pop(self._known(name))

    def run(self, name: str, *params: Any, **options: Any) -> Any:
        one = self.named[self._known(name)]
        began = time.perf_counter()
        try:
            with self.db.block():
                out = None
                for s in one.parsed:
                    out = self.db.statement(s, params, options.get("now"), options.get("policy"))
            return out
        except Exception:
            one.failures += 1
            raise
        finally:
            took = time.perf_counter() - began
            one.runs, one.seconds, one.longest = one.runs + 1, one.seconds + took, max(one.longest, took)

    def statistics(self) -> DataFrame:
        """name, text, runs, failures, seconds, longest; the dearest first. A read is planned in its run, and asked for later."""
        rows = [(n, s.text, s.runs, s.failures, s.seconds, s.longest) for n, s in self.named.items()]
        df = self.db.spark.createDataFrame(rows, "name string, text string, runs int, failures int, seconds double, longest double")
        return df.orderBy(df.seconds.desc(), "name")

    def _known(self, name: str) -> str:
        if name not in self.named:
            raise QueryError(f"no statement {name}")
        return name
