"""The seven category levels. Every column list of the taste and recommendation
operators derives from a ``Level``, so one program serves all of them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Level:
    """A category level made of one, two or three product attributes."""

    parts: tuple[str, ...]

    @property
    def name(self) -> str:
        return "_".join(self.parts)

    @property
    def columns(self) -> list[str]:
        """Id and name column of every part, in order."""
        return [c for part in self.parts for c in (f"{part}_id", part)]

    @property
    def product_columns(self) -> list[str]:
        """What identifies one category of this level."""
        return ["category", *self.columns]

    @property
    def keys(self) -> list[str]:
        """What identifies one customer's category."""
        return ["cust_id", *self.product_columns]


DIVISION = Level(("division",))
DESIGNER = Level(("designer",))
CLASS = Level(("class",))
DESIGNER_CLASS = Level(("designer", "class"))
DIVISION_CLASS = Level(("division", "class"))
DESIGNER_DIVISION = Level(("designer", "division"))
DESIGNER_DIVISION_CLASS = Level(("designer", "division", "class"))

LEVELS: dict[str, Level] = {
    level.name: level
    for level in (
        DIVISION,
        DESIGNER,
        CLASS,
        DESIGNER_CLASS,
        DIVISION_CLASS,
        DESIGNER_DIVISION,
        DESIGNER_DIVISION_CLASS,
    )
}
