"""What a panel is: the roles of its columns and the twelve levels of its two crossed hierarchies."""

from __future__ import annotations

from dataclasses import dataclass, field

# Column names and the level map that existing panels, caches and metric files use.
LEVELS: dict[int, tuple[str, ...]] = {
    1: (),
    2: ("state_id",),
    3: ("store_id",),
    4: ("cat_id",),
    5: ("dept_id",),
    6: ("state_id", "cat_id"),
    7: ("state_id", "dept_id"),
    8: ("store_id", "cat_id"),
    9: ("store_id", "dept_id"),
    10: ("item_id",),
    11: ("state_id", "item_id"),
    12: ("id",),
}
STATIC = ("item_id", "dept_id", "cat_id", "store_id", "state_id")
EVENTS = ("event_name_1", "event_type_1")
FLAGS = ("snap_CA", "snap_TX", "snap_WI")
MEANS = ("wm_yr_wk", "wday", "month", "year", "sell_price")
KNOWN_COVARIATES = ("wday", "month", "year", "snap_CA", "snap_TX", "snap_WI", "event_name_1", "event_type_1", "sell_price")
PAST_COVARIATES: tuple[str, ...] = ()


@dataclass(frozen=True)
class PanelSpec:
    """Roles of the columns of a long panel, one row for each series and date."""

    id: str = "id"
    date: str = "date"
    target: str = "sales_quantity"
    target_aliases: tuple[str, ...] = ("sold",)
    price: str = "sell_price"
    static: tuple[str, ...] = STATIC
    events: tuple[str, ...] = EVENTS
    flags: tuple[str, ...] = FLAGS
    means: tuple[str, ...] = MEANS
    levels: dict[int, tuple[str, ...]] = field(default_factory=lambda: dict(LEVELS))
    horizon: int = 28
    season: int = 7

    @property
    def covariates(self) -> tuple[str, ...]:
        return (*self.means, *self.events, *self.flags)


DEFAULT = PanelSpec()
