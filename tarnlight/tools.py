"""A database as tools that an assistant calls by name: search, query, get, write, remember and recall."""

from __future__ import annotations

import datetime as dt
import json
from typing import Any

from .errors import QueryError
from .operators.writes import Database
from .plans.ast import Select
from .plans.parser import parse

MEMORIES = "memories"
#: Rows of an answer: more are refused, not cut.
MOST_ROWS = 1000


class Tools:
    """call(name, arguments) answers rows as dictionaries. write and remember need leave to write."""

    def __init__(self, db: Database, writable: bool = False):
        self.db, self.writable = db, writable

    def describe(self) -> list[dict[str, Any]]:
        """Names, what they do, and their arguments."""
        return [
            {"name": "search", "about": "rows that match a text or lie near a vector", "arguments": {"collection": "text", "field": "text", "text": "text?", "vector": "[float]?", "limit": "int?"}},
            {"name": "query", "about": "a reading statement", "arguments": {"query": "text", "params": "list?"}},
            {"name": "get", "about": "a row by its id", "arguments": {"collection": "text", "id": "int"}},
            {"name": "write", "about": "writing statements, all or none", "arguments": {"query": "text", "params": "list?"}},
            {"name": "remember", "about": "keeps a text for later", "arguments": {"text": "text", "tags": "[text]?"}},
            {"name": "recall", "about": "kept texts that match", "arguments": {"text": "text", "limit": "int?"}},
        ]

    def call(self, name: str, arguments: dict[str, Any]) -> list[dict[str, Any]]:
        known = {t["name"]: t["arguments"] for t in self.describe()}
        if name not in known:
            raise QueryError(f"no tool {name}")
        if wrong := set(arguments) - set(known[name]) or {a for a, t in known[name].items() if not t.endswith("?") and a not in arguments}:
            raise QueryError(f"{name} takes {', '.join(known[name])}, not {sorted(wrong)[0]} so")
        return getattr(self, f"_{name}")(**arguments)

    def _rows(self, text: str, *params: Any) -> list[dict[str, Any]]:
        df = self.db.run(text, *params).df
        rows = df.limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise QueryError(f"the answer has more than {MOST_ROWS} rows: say a limit")
        return [json.loads(json.dumps(r.asDict(True), default=str)) for r in rows]

    def _named(self, *names: str) -> None:
        for n in names:
            if not n.isidentifier():
                raise QueryError(f"no name: {n!r}")

    def _search(self, collection: str, field: str, text: str | None = None, vector: list[float] | None = None, limit: int = 10) -> list[dict[str, Any]]:
        self._named(collection, field)
        if (text is None) == (vector is None):
            raise QueryError("a search has a text or a vector")
        by = f"match {field} $1" if text is not None else f"near {field} $1"
        return self._rows(f"get {collection} {by} limit $2", text if text is not None else vector, int(limit))

    def _query(self, query: str, params: list | None = None) -> list[dict[str, Any]]:
        if not all(isinstance(s, Select) for s in parse(query)):
            raise QueryError("query reads only; write writes")
        return self._rows(query, *(params or []))

    def _get(self, collection: str, id: int) -> list[dict[str, Any]]:
        self._named(collection)
        return self._rows(f"get {collection} where id = $1", int(id))

    def _write(self, query: str, params: list | None = None) -> list[dict[str, Any]]:
        if not self.writable:
            raise QueryError("these tools only read")
        out = self.db.run(query, *(params or []))
        return [r.asDict(True) for r in out.df.limit(MOST_ROWS).collect()] if hasattr(out, "df") else []

    def _remember(self, text: str, tags: list[str] | None = None) -> list[dict[str, Any]]:
        if not self.writable:
            raise QueryError("these tools only read")
        self.db.run(f"create collection if not exists {MEMORIES} (body text @text, tags [text], at timestamp)")
        return [r.asDict(True) for r in self.db.run(f"put {MEMORIES} {{body: $1, tags: $2, at: $3}} returning id", text, tags or [], dt.datetime.now(dt.UTC)).df.collect()]

    def _recall(self, text: str, limit: int = 10) -> list[dict[str, Any]]:
        if MEMORIES not in self.db.catalog.collections:
            return []
        return self._rows(f"get {MEMORIES} match body $1 limit $2", text, int(limit))
