"""The filter language: ``[target][[k=v,..]][=level|off]``, compiled to one Column.

Directives are separated by commas outside brackets and quotes.  A bare level sets the
floor for events that no directive names (INFO unless given), a bare ``off`` drops them.
A target alone means everything from TRACE up.  Directives with label conditions come
first, in their order, and hold for exactly the event they name; then the longest target
that is a whole-segment prefix decides.  Without a target, label conditions match nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.envelope import SEVERITIES

_ALIASES = {"WARNING": "WARN", "ERR": "ERROR"}
_PIECES = re.compile(r'"[^"]*"|\[(?:"[^"]*"|[^\]"])*\]|[^,]')
_SHAPE = re.compile(r"(?P<target>[\w.:\-*/]*)(?P<labels>\[.*\])?\s*(?:=\s*(?P<level>\w+))?")
_PAIR = re.compile(r'\s*([\w.\-]+)\s*=\s*("[^"]*"|[^,"\]]*?)\s*(?:,|$)')


def level(word: str) -> int | None:
    """The rank of a level's name, 0 for ``off``, None for other words."""
    name = word.strip().upper().removeprefix("SEVERITY_")
    name = _ALIASES.get(name, name)
    return 0 if name == "OFF" else SEVERITIES.index(name) + 1 if name in SEVERITIES else None


@dataclass(frozen=True)
class Directive:
    """One part of a filter; level 0 stands for off."""

    target: str
    labels: tuple[tuple[str, str], ...]
    level: int


@dataclass
class Filter:
    """A parsed filter; ``floor`` 0 drops all events that no directive names."""

    floor: int = 3
    directives: list[Directive] = field(default_factory=list)

    @property
    def dynamic(self) -> list[Directive]:
        return [d for d in self.directives if d.labels]

    @property
    def static(self) -> list[Directive]:
        """Longest target first; of equal ones the earlier."""
        return sorted((d for d in self.directives if not d.labels), key=lambda d: -len(d.target))


def _split(text: str) -> list[str]:
    parts, part = [], ""
    end = 0
    for m in _PIECES.finditer(text):
        if "," in text[end : m.start()]:
            parts.append(part)
            part = ""
        part += m[0]
        end = m.end()
    return [p.strip() for p in [*parts, part] if p.strip()]


def parse(text: str) -> Filter:
    """The filter that ``text`` writes; ValueError if it isn't one."""
    found = Filter()
    for part in _split(text):
        plain = level(part)
        if plain is not None:
            found.floor = plain
            continue
        m = _SHAPE.fullmatch(part)
        if not m or not (m["target"] or m["labels"]):
            raise ValueError(f"not a filter directive: {part!r}")
        rank = 1 if m["level"] is None else level(m["level"])
        if rank is None:
            raise ValueError(f"unknown level in {part!r}")
        inner = (m["labels"] or "[]")[1:-1]
        pairs = [(k, v.strip('"')) for k, v in _PAIR.findall(inner)]
        if inner.strip() and _PAIR.sub("", inner).strip():
            raise ValueError(f"not label conditions: {inner!r}")
        found.directives.append(Directive(m["target"], tuple(pairs), rank))
    return found


def under(name: Column, target: str) -> Column:
    """Whether ``name`` is ``target`` or lies under it at a ``.`` or ``::``."""
    return (name == target) | name.startswith(f"{target}.") | name.startswith(f"{target}::")


def _passes(rank: int, sev_rank: Column) -> Column:
    return sev_rank >= rank if rank else F.lit(False)


def allowed(rules: Filter | str, name: str = "full_name", sev_rank: str = "sev_rank", labels: str = "labels") -> Column:
    """True where the filter lets an event pass; missing labels fail a condition."""
    rules = parse(rules) if isinstance(rules, str) else rules
    n, s = F.col(name), F.col(sev_rank)
    cases = [(reduce(lambda a, b: a & b, [F.coalesce(F.col(labels)[k] == v, F.lit(False)) for k, v in d.labels], n == d.target), d.level) for d in rules.dynamic]
    cases += [(under(n, d.target), d.level) for d in rules.static]
    out = F.lit(None).cast("boolean")
    for hit, rank in cases:
        out = F.coalesce(out, F.when(hit, _passes(rank, s)))
    return F.coalesce(out, _passes(rules.floor, s), F.lit(False))


def interest(schemas: DataFrame, rules: Filter | str, name: str = "full_name", default_rank: str = "default_rank") -> DataFrame:
    """``schemas`` with ``interest``: NEVER, SOMETIMES (labels decide) or ALWAYS."""
    rules = parse(rules) if isinstance(rules, str) else rules
    static = Filter(rules.floor, [d for d in rules.directives if not d.labels])
    named = sorted({d.target for d in rules.dynamic if d.target})
    without = allowed(static, name, default_rank)
    return schemas.withColumn("interest", F.when(F.col(name).isin(named), "SOMETIMES").when(without, "ALWAYS").otherwise("NEVER"))


def label_keys(rules: Filter | str) -> list[tuple[str, str]]:
    """(event, label) that the filter's label conditions read."""
    rules = parse(rules) if isinstance(rules, str) else rules
    return sorted({(d.target, k) for d in rules.dynamic for k, _ in d.labels})
