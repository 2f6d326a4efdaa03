"""Settings as tables: what each may be, which come together and which need another."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Setting:
    """A setting's types and bounds. ``each`` holds for all items of a list or keys of a dict; ``test`` says what is wrong beyond that."""

    kinds: tuple[type, ...]
    required: bool = False
    least: float | None = None
    most: float | None = None
    above: float | None = None
    one_of: tuple = ()
    filled: bool = False
    distinct: bool = False
    pattern: str | None = None
    is_regex: bool = False
    each: Setting | None = None
    without: frozenset = frozenset()
    test: Callable[[Any], str | None] | None = None


def _wrong(value: Any, s: Setting) -> Iterator[str]:
    """What is wrong with a value, the type first."""
    # True and False are numbers to Python only.
    if not isinstance(value, s.kinds) or isinstance(value, bool) and bool not in s.kinds:
        yield f"is no {' or '.join(k.__name__ for k in s.kinds)}"
        return
    if isinstance(value, float) and not math.isfinite(value):
        yield "is not finite"
    for bad, why in ((s.least is not None and value < (s.least or 0), f"is below {s.least}"), (s.most is not None and value > (s.most or 0), f"is above {s.most}"), (s.above is not None and value <= (s.above or 0), f"is not above {s.above}")):
        if bad:
            yield why
    if s.one_of and value not in s.one_of:
        yield f"is none of {', '.join(map(str, s.one_of))}"
    if s.filled and not (value.strip() if isinstance(value, str) else value):
        yield "is empty"
    if s.distinct and len(set(value)) < len(value):
        yield "repeats an item"
    if s.pattern is not None and not re.fullmatch(s.pattern, value):
        yield "is not such a name"
    if s.is_regex:
        try:
            re.compile(value)
        except re.error as error:
            yield f"is no regular expression: {error}"
    if s.each is not None:
        yield from (f"has {x!r}, which {why}" for x in value for why in _wrong(x, s.each))
    if found := s.without & set(value if s.without else ()):
        yield f"cannot set {', '.join(sorted(found))}"
    if s.test is not None and (why := s.test(value)):
        yield why


def problems(table: dict[str, Setting], given: dict[str, Any], together: tuple[tuple[str, str], ...] = (), needs: dict[str, str] | None = None) -> Iterator[str]:
    """All that is wrong with given settings; those that are null, and 0 or empty for the last two rules, count as not given."""
    yield from (f"{name} is not known" for name in given if name not in table)
    for name, s in table.items():
        value = given.get(name)
        if value is not None:
            yield from (f"{name} {why}" for why in _wrong(value, s))
        elif s.required:
            yield f"{name} is missing"
    yield from (f"{a} and {b} are set together" for a, b in together if bool(given.get(a)) != bool(given.get(b)))
    yield from (f"{a} needs {b}" for a, b in (needs or {}).items() if given.get(a) and not given.get(b))


def refuse(prefix: str, found: Iterator[str]) -> None:
    """Raise the first problem."""
    for why in found:
        raise ValueError(f"{prefix}{why}")
