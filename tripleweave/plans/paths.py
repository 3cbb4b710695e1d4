"""Property paths: ``P("a") / P("b")``, ``P("a") | P("b")``, ``~P("a")`` and any nesting.

A path is rewritten into triple patterns over hidden variables, so that its steps are joined in
the order of the whole group and read reduced tables like any other pattern. A choice between
single properties stays one scan; other alternatives become alternative groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

# A pattern of one alternative: the property is a name, or a tuple of names to choose from.
Step = tuple[str, "str | tuple[str, ...]", str]


class Path:
    def __truediv__(self, other: Path) -> Path:
        return Sequence(self, other)

    def __or__(self, other: Path) -> Path:
        return Alternative(self, other)

    def __invert__(self) -> Path:
        return Inverse(self)

    def steps(self, sub: str, obj: str, fresh: Iterator[str]) -> list[list[Step]]:
        """The alternatives of the path from ``sub`` to ``obj``, each a list of patterns; one row per way through."""
        raise NotImplementedError

    def plain(self) -> list[str] | None:
        """The properties, when the path is just a choice between some."""
        return None


@dataclass(frozen=True)
class P(Path):
    prop: str

    def steps(self, sub, obj, fresh):
        return [[(sub, self.prop, obj)]]

    def plain(self):
        return [self.prop]


@dataclass(frozen=True)
class Sequence(Path):
    first: Path
    second: Path

    def steps(self, sub, obj, fresh):
        via = next(fresh)
        after = self.second.steps(via, obj, fresh)
        return [a + b for a in self.first.steps(sub, via, fresh) for b in after]


@dataclass(frozen=True)
class Alternative(Path):
    first: Path
    second: Path

    def plain(self):
        a, b = self.first.plain(), self.second.plain()
        # A property named twice counts twice, which one scan would not give.
        return a + b if a and b and not set(a) & set(b) else None

    def steps(self, sub, obj, fresh):
        props = self.plain()
        if props:
            return [[(sub, tuple(props), obj)]]
        return self.first.steps(sub, obj, fresh) + self.second.steps(sub, obj, fresh)


@dataclass(frozen=True)
class Inverse(Path):
    path: Path

    def steps(self, sub, obj, fresh):
        return self.path.steps(obj, sub, fresh)
