"""Tokens to statements. Both the native spelling and SQL's make the same statements."""

from __future__ import annotations

from typing import Any

from ..errors import QueryError
from .ast import (
    AGGREGATES,
    Agg,
    Binary,
    Call,
    Case,
    Change,
    Exists,
    Explain,
    Facet,
    Fuse,
    InList,
    InSelect,
    Interval,
    Item,
    JoinOn,
    ListOf,
    Lit,
    Lookup,
    Match,
    Near,
    ObjectOf,
    Param,
    Path,
    Put,
    Rerank,
    Scalar,
    Schema,
    Select,
    Sort,
    Unary,
    conjoined,
    conjuncts,
)
from .lexer import Token, tokens

CLAUSES = frozenset("select from where group having order limit offset count facet lookup match near rerank fuse require join inner left right full cross on using returning union window values set".split())
DEPTH = 96


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.depth = tokens(text), 0, 0

    # tokens
    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def fail(self, wanted: str) -> QueryError:
        return QueryError(f"expected {wanted}, found {self.now.text or 'the end'!r} at {self.now.at}")

    def take(self) -> Token:
        t = self.now
        self.at += 1
        return t

    def word(self, *words: str) -> str:
        """Takes one of the words, or gives ''."""
        if self.now.word in words:
            return self.take().word
        return ""

    def op(self, *ops: str) -> str:
        if self.now.kind == "op" and self.now.text in ops:
            return self.take().text
        return ""

    def need(self, text: str) -> None:
        if not (self.op(text) or self.word(text)):
            raise self.fail(f"`{text}`")

    def name(self) -> str:
        if self.now.kind == "name" or self.now.kind == "double":
            return self.take().text
        raise self.fail("a name")

    def path(self) -> Path:
        return Path(tuple(self.name().split(".")))

    def count_of(self) -> Any:
        """A whole number or a parameter."""
        t = self.take()
        if t.kind == "param":
            return Param(int(t.text[1:]))
        if t.kind == "number" and t.text.isdigit():
            return int(t.text)
        raise QueryError(f"expected a whole number of 0 or more, found {t.text!r}")

    def listed(self, one) -> list:
        out = [one()]
        while self.op(","):
            out.append(one())
        return out

    # statements
    def statements(self) -> list:
        out = []
        while self.now.kind != "end":
            out.append(self.statement())
            if self.now.kind != "end" and not self.op(";"):
                raise self.fail("`;` or the end")
        return out

    def statement(self) -> Any:
        word = self.now.word
        if word in ("get", "select"):
            return self.select()
        if word in ("put", "insert"):
            return self.put()
        if word in ("set", "update", "del", "delete"):
            return self.change()
        if word == "explain":
            self.take()
            return Explain(self.statement())
        if word in ("create", "drop", "alter", "describe", "collections", "compact"):
            return self.schema()
        raise self.fail("a statement")

    def select(self) -> Select:
        s = Select()
        if self.word("get"):
            if self.now.word and self.now.word not in CLAUSES or self.now.kind == "double":
                s.source = self.name()
                self.alias(s)
        self.clauses(s)
        if not s.source:
            raise QueryError("a get names its collection")
        return s

    def alias(self, s: Select) -> None:
        if self.word("as") or (self.now.word and self.now.word not in CLAUSES | {"as", "asc", "desc", "required"}):
            s.alias = self.name()

    def clauses(self, s: Select) -> None:
        seen: set[str] = set()
        while True:
            word = self.now.word
            if word in seen and word not in ("facet",):
                raise QueryError(f"`{word}` is said twice")
            if word == "select":
                self.take()
                s.distinct = bool(self.word("distinct"))
                s.items = None if self.op("*") else self.listed(self.item)
            elif word == "from":
                self.take()
                s.source = self.name()
                self.alias(s)
                self.tables(s)
            elif word in ("join", "inner", "left"):
                self.tables(s)
                continue
            elif word in ("right", "full", "cross", "union", "window"):
                raise QueryError(f"`{word}` isn't offered")
            elif word == "where":
                self.take()
                s.where = conjoined([*conjuncts(s.where), self.expr()])
            elif word == "group":
                self.take()
                self.word("by")
                s.group = self.listed(self.expr)
            elif word == "having":
                self.take()
                s.having = self.expr()
            elif word == "order":
                self.take()
                self.word("by")
                s.order = self.listed(self.sort)
            elif word == "limit":
                self.take()
                s.limit = self.count_of()
            elif word == "offset":
                self.take()
                s.offset = self.count_of()
            elif word == "count":
                self.take()
                s.count = True
            elif word == "facet":
                self.take()
                s.facets += self.listed(self.facet)
            elif word == "match":
                self.take()
                field, text = self.path(), self.primary()
                fuzzy, prefix = None, False
                while option := self.word("fuzzy", "prefix"):
                    if option == "prefix":
                        prefix = True
                    else:
                        fuzzy = self.count_of() if self.now.kind == "number" else 2
                s.match = Match(field, text, fuzzy, prefix)
            elif word == "near":
                self.take()
                field, vector = self.path(), self.primary()
                ef, exact = None, False
                while option := self.word("ef", "exact"):
                    if option == "exact":
                        exact = True
                    else:
                        ef = self.count_of()
                s.near = Near(field, vector, ef, exact)
            elif word == "rerank":
                self.take()
                field, vector = self.path(), self.primary()
                s.rerank = Rerank(field, vector, self.count_of() if self.word("candidates") else 200)
            elif word == "fuse":
                self.take()
                k, candidates = 60, 20
                while option := self.word("k", "candidates"):
                    if option == "k":
                        k = self.count_of()
                    else:
                        candidates = self.count_of()
                s.fuse = Fuse(k, candidates)
            elif word == "lookup":
                self.take()
                s.lookup = self.lookup()
                return
            elif word == "require":
                s.require = self.required()
            else:
                return
            seen.add(word)

    def required(self) -> tuple[Any, Any]:
        self.need("require")
        n = self.count_of()
        return n, self.primary() if self.word("else") else None

    def tables(self, s: Select) -> None:
        while True:
            if self.op(","):
                kind = "inner"
            elif self.now.word in ("join", "inner"):
                self.word("inner")
                self.need("join")
                kind = "inner"
            elif self.now.word == "left":
                self.take()
                self.word("outer")
                self.need("join")
                kind = "left"
            else:
                return
            table = self.name()
            named = Select()
            self.alias(named)
            alias = named.alias or table
            on = None
            if self.word("on"):
                on = self.expr()
            elif self.word("using"):
                self.need("(")
                before = s.joins[-1].alias if s.joins else s.alias or s.source
                on = conjoined([Binary("=", Path((before, k)), Path((alias, k))) for k in self.listed(self.name)])
                self.need(")")
            s.joins.append(JoinOn(kind, table, alias, on))

    def lookup(self) -> Lookup:
        child = Select(source=self.name())
        self.need("on")

        def keys() -> tuple[str, ...]:
            if self.op("("):
                out = tuple(self.listed(self.name))
                self.need(")")
                return out
            return (self.name(),)

        on = keys()
        parent = keys() if self.op("=", "==") else ("id",)
        if len(on) != len(parent):
            raise QueryError("a lookup's keys pair up")
        required = bool(self.word("required"))
        self.clauses(child)
        return Lookup(child, on, parent, required)

    def item(self) -> Item:
        e = self.expr()
        if self.word("as") or (self.now.word and self.now.word not in CLAUSES):
            return Item(e, self.name())
        return Item(e)

    def sort(self) -> Sort:
        e, collate, desc = self.expr(), None, False
        while w := self.word("collate", "asc", "desc", "nulls"):
            if w == "collate":
                collate = self.name()
                if collate not in ("und", "tr"):
                    raise QueryError("a collation is `und` or `tr`")
            elif w == "nulls":
                if self.word("first", "last") != ("last" if desc else "first"):
                    raise QueryError("nulls come first, or last in a descending order")
            else:
                desc = w == "desc"
        return Sort(e, desc, collate)

    def facet(self) -> Facet:
        path, top, ranges, disjunctive = self.path(), None, None, False
        while w := self.word("top", "ranges", "disjunctive"):
            if w == "top":
                top = self.count_of()
            elif w == "ranges":
                found = self.primary()
                ranges = tuple(x.value if isinstance(x, Lit) else x for x in found.items) if isinstance(found, ListOf) else found
            else:
                disjunctive = True
        return Facet(path, top, ranges, disjunctive)

    def put(self) -> Put:
        insert = self.take().word == "insert"
        self.word("into")
        p = Put(self.name(), [], insert)
        columns = None
        if insert and self.op("("):
            columns = self.listed(self.name)
            self.need(")")
        if self.word("values"):
            rows = self.listed(self.row if columns else self.primary)
            if columns and any(len(r) != len(columns) for r in rows):
                raise QueryError("a row has as many values as the fields that are named")
            p.documents = [ObjectOf(tuple(zip(columns, r, strict=True))) for r in rows] if columns else rows
        else:
            found = self.listed(self.primary)
            p.documents = found[0] if len(found) == 1 and isinstance(found[0], Param) else [d for x in found for d in (x.items if isinstance(x, ListOf) else (x,))]
        while True:
            if self.word("if"):
                self.need("absent")
                p.if_absent = True
                if self.word("else"):
                    self.need("set")
                    p.otherwise = dict(self.object().items)
            elif self.now.word == "on":
                self.take()
                self.need("conflict")
                if self.op("("):
                    p.conflict = tuple(self.listed(self.name))
                    self.need(")")
                self.need("do")
                p.if_absent = True
                if not self.word("nothing"):
                    self.need("update")
                    self.need("set")
                    p.otherwise = self.assignments()
            elif self.word("returning"):
                p.returning = [Item(Path(("*",)))] if self.op("*") else self.listed(self.item)
            elif self.now.word == "require":
                p.require = self.required()
            else:
                return p

    def row(self) -> list:
        self.need("(")
        out = self.listed(self.expr)
        self.need(")")
        return out

    def assignments(self) -> dict:
        def one() -> tuple[str, Any]:
            name = self.name()
            self.need("=")
            return name, self.expr()

        return dict(self.listed(one))

    def change(self) -> Change:
        word = self.take().word
        if word == "delete":
            self.need("from")
        c = Change(self.name(), None)
        if word == "set":
            c.values = dict(self.object().items)
        elif word == "update":
            self.need("set")
            c.values = self.assignments()
        while True:
            if self.word("where"):
                c.where = self.expr()
            elif self.word("order"):
                self.word("by")
                c.order = self.listed(self.sort)
            elif self.word("limit"):
                c.limit = self.count_of()
            elif self.word("returning"):
                c.returning = [Item(Path(("*",)))] if self.op("*") else self.listed(self.item)
            elif self.now.word == "require":
                c.require = self.required()
            else:
                return c

    def schema(self) -> Schema:
        word = self.take().word
        if word in ("collections", "compact", "describe"):
            return Schema(word, self.name() if self.now.kind in ("name", "double") else None)
        if word == "alter":
            self.need("collection")
            s = Schema("alter", self.name())
            action = self.word("add", "drop", "rename", "alter")
            self.word("field")
            if action == "add":
                s.args = {"add": self.declared()}
            elif action == "drop":
                s.args = {"drop": self.name()}
            elif action == "rename":
                old = self.name()
                self.need("to")
                s.args = {"rename": (old, self.name())}
            elif action == "alter":
                name = self.name()
                s.args = {"alter": {"name": name, **self.marks()}}
            else:
                raise self.fail("add, drop, rename or alter")
            return s
        if self.word("index"):
            s = Schema(f"{word} index", lenient=self.lenient(word))
            self.need("on")
            s.name = self.name()
            self.need("(")
            s.fields = [(x.expr.text, x.desc) for x in self.listed(self.sort)]
            self.need(")")
            s.args = self.marks()
            return s
        self.need("collection")
        s = Schema(word, lenient=self.lenient(word))
        s.name = self.name()
        if word == "create":
            self.need("(")
            while not self.op(")"):
                if self.now.text == "@":
                    self.take()
                    kind = self.name()
                    self.need("(")
                    s.args.setdefault("keys", []).append((kind, [(x.expr.text, x.desc) for x in self.listed(self.sort)]))
                    self.need(")")
                else:
                    s.fields.append(self.declared())
                if not self.op(","):
                    self.need(")")
                    break
        return s

    def lenient(self, word: str) -> bool:
        if not self.word("if"):
            return False
        if word == "create":
            self.need("not")
        self.need("exists")
        return True

    def declared(self) -> dict:
        out: dict[str, Any] = {"name": self.name()}
        out["type"] = self.type()
        return out | self.marks()

    def type(self) -> str:
        if self.op("["):
            inner = self.type()
            self.need("]")
            return f"[{inner}]"
        name = self.name().lower()
        if name in ("vector", "sparse"):
            self.need("<")
            n = self.count_of()
            if self.op(","):
                self.name()
            self.need(">")
            return f"{name}<{n}>"
        if name not in ("bool", "int", "float", "text", "bytes", "timestamp", "json", "geo"):
            raise QueryError(f"no type {name}")
        return name

    def marks(self) -> dict:
        out: dict[str, Any] = {}
        while True:
            if self.word("required"):
                out["required"] = True
            elif self.word("nocase"):
                out["nocase"] = True
            elif self.word("collate"):
                out["collate"] = self.name()
            elif self.op("@"):
                kind = self.name().lower()
                args: list = []
                if self.op("("):
                    while not self.op(")"):
                        t = self.take()
                        key = t.text
                        if self.op("="):
                            args.append((key, self.take().text))
                        else:
                            args.append(Interval(*_interval(key)) if t.kind == "interval" else key)
                        if not self.op(","):
                            self.need(")")
                            break
                out.setdefault("indexes", []).append((kind, args))
            else:
                return out

    # expressions
    def expr(self) -> Any:
        self.depth += 1
        if self.depth > DEPTH:
            raise QueryError("the expression is nested too deeply")
        e = self.both()
        while self.word("or"):
            e = Binary("or", e, self.both())
        self.depth -= 1
        return e

    def both(self) -> Any:
        e = self.negated()
        while self.word("and"):
            e = Binary("and", e, self.negated())
        return e

    def negated(self) -> Any:
        if self.now.word == "not":
            self.take()
            return Unary("not", self.negated())
        return self.compared()

    def compared(self) -> Any:
        e = self.summed()
        if o := self.op("=", "==", "!=", "<>", "<", "<=", ">", ">=", "~"):
            return Binary({"==": "=", "<>": "!="}.get(o, o), e, self.summed())
        if o := self.op("<->", "<=>", "<#>"):
            return Call({"<->": "l2", "<=>": "cosine_distance", "<#>": "negative_dot"}[o], (e, self.summed()))
        if self.word("has"):
            return Binary("has", e, self.summed())
        if self.word("is"):
            negate = bool(self.word("not"))
            if self.word("null"):
                test: Any = Unary("is null", e)
            elif self.word("distinct"):
                self.need("from")
                test, negate = Binary("=", e, self.summed()), not negate
            elif self.word("true"):
                test = Binary("=", e, Lit(True))
            else:
                self.need("false")
                test = Binary("=", e, Lit(False))
            return Unary("not", test) if negate else test
        negate = self.now.word == "not" and self.ahead().word in ("in", "between", "like", "ilike")
        if negate:
            self.take()
        word = self.word("in", "between", "like", "ilike")
        if not word:
            return e
        if word == "in":
            if self.op("("):
                if self.now.word in ("get", "select"):
                    test = InSelect(e, self.select())
                else:
                    test = InList(e, tuple(self.listed(self.expr)))
                self.need(")")
            else:
                found = self.primary()
                test = InList(e, found.items if isinstance(found, ListOf) else (found,))
        elif word == "between":
            low = self.summed()
            self.need("and")
            test = Binary("and", Binary(">=", e, low), Binary("<=", e, self.summed()))
        else:
            args = [e, self.summed()]
            if self.word("escape"):
                args.append(self.summed())
            test = Call(word, tuple(args))
        return Unary("not", test) if negate else test

    def summed(self) -> Any:
        e = self.multiplied()
        while o := self.op("+", "-", "||"):
            e = Binary("+" if o == "||" else o, e, self.multiplied())
        return e

    def multiplied(self) -> Any:
        e = self.signed()
        while o := self.op("*", "/"):
            e = Binary(o, e, self.signed())
        return e

    def signed(self) -> Any:
        if self.op("-"):
            x = self.signed()
            return Lit(-x.value) if isinstance(x, Lit) and isinstance(x.value, int | float) and not isinstance(x.value, bool) else Unary("-", x)
        return self.primary()

    def object(self) -> ObjectOf:
        self.need("{")
        items = []
        while not self.op("}"):
            key = self.take()
            if key.kind not in ("name", "double", "single"):
                raise self.fail("a field")
            self.need(":")
            items.append((key.text, self.expr()))
            if not self.op(","):
                self.need("}")
                break
        return ObjectOf(tuple(items))

    def primary(self) -> Any:
        t = self.now
        if t.kind == "op" and t.text == "{":
            return self.object()
        if self.op("["):
            items = []
            while not self.op("]"):
                items.append(self.expr())
                if not self.op(","):
                    self.need("]")
                    break
            return ListOf(tuple(items))
        if self.op("("):
            if self.now.word in ("get", "select"):
                e: Any = Scalar(self.select())
            else:
                e = self.expr()
            self.need(")")
            return e
        self.take()
        if t.kind == "number":
            return Lit(int(t.text) if t.text.isdigit() else float(t.text))
        if t.kind in ("single", "double"):
            return Lit(t.text)
        if t.kind == "param":
            return Param(int(t.text[1:]))
        if t.kind == "interval":
            return Interval(*_interval(t.text))
        if t.kind != "name":
            self.at -= 1
            raise self.fail("a value")
        word = t.word
        if word in ("null", "true", "false"):
            return Lit({"null": None, "true": True, "false": False}[word])
        if word == "case":
            return self.case()
        if word == "exists" and self.now.text == "(":
            self.take()
            e = Exists(self.select())
            self.need(")")
            return e
        if self.now.kind == "op" and self.now.text == "(":
            self.take()
            return self.call(word)
        if word in CLAUSES - {"count", "set", "values"}:
            self.at -= 1
            raise self.fail("a value")
        return Path(tuple(t.text.split(".")))

    def call(self, name: str) -> Any:
        distinct = name in AGGREGATES and bool(self.word("distinct"))
        star = bool(name in AGGREGATES and self.op("*"))
        args = [] if star or self.now.text == ")" else self.listed(self.expr)
        by = None
        if name in ("first", "last") and self.word("by"):
            by = self.expr()
        self.need(")")
        if name not in AGGREGATES:
            return Call(name, tuple(args))
        if len(args) > 1 or (not args and name != "count"):
            raise QueryError(f"{name}() takes one argument")
        where = None
        if self.now.word == "filter" and self.ahead().text == "(":
            self.take()
            self.need("(")
            self.need("where")
            where = self.expr()
            self.need(")")
            if name not in ("count", "sum", "avg", "min", "max"):
                raise QueryError(f"{name}() takes no filter")
        return Agg(name, args[0] if args else None, by, distinct, where)

    def case(self) -> Case:
        subject = None if self.now.word == "when" else self.expr()
        whens = []
        while self.word("when"):
            test = self.expr()
            self.need("then")
            whens.append((test if subject is None else Binary("=", subject, test), self.expr()))
        otherwise = self.expr() if self.word("else") else Lit(None)
        self.need("end")
        if not whens:
            raise QueryError("a case has a `when`")
        return Case(tuple(whens), otherwise)


def _interval(text: str) -> tuple[int, str]:
    digits = text.rstrip("abcdefghijklmnopqrstuvwxyz")
    return int(digits), text[len(digits) :]


def parse(text: str) -> list:
    try:
        return Parser(text).statements()
    except RecursionError:
        raise QueryError("the statement is nested too deeply") from None


def parse_one(text: str) -> Any:
    found = parse(text)
    if len(found) != 1:
        raise QueryError("one statement is asked for")
    return found[0]
