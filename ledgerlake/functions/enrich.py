"""Business rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Give ``label`` to a value that is in ``values`` or holds one of ``fragments``."""

    label: str
    values: tuple[str, ...] = ()
    fragments: tuple[str, ...] = ()

    def matches(self, probe: Column) -> Column:
        tests = [probe.contains(part) for part in self.fragments]
        if self.values:
            tests.append(probe.isin(*self.values))
        found = tests[0]
        for test in tests[1:]:
            found = found | test
        return found


# Sub-category names and the category each stands for.
CATEGORY_RULES = (
    Rule("Clothing", values=("Gloves", "Shorts", "Socks", "Tights", "Vests")),
    Rule("Accessories", values=("Locks", "Lights", "Headsets", "Helmets", "Pedals", "Pumps")),
    Rule("Components", values=("Wheels", "Saddles"), fragments=("Frames",)),
)

# Fixed value: what a missing colour is published as.
NO_COLOR = "N/A"


def rule_enrichment(current: Column, probe: Column, rules: Sequence[Rule]) -> Column:
    """Keep ``current``; where it is NULL take the label of the first rule that matches
    ``probe``. Case-sensitive. No match, or a NULL probe, leaves NULL."""
    labelled = F.lit(None).cast("string")
    for rule in reversed(rules):
        labelled = F.when(rule.matches(probe), F.lit(rule.label)).otherwise(labelled)
    return F.coalesce(current, labelled)


def line_total(quantity: Column, unit_price: Column, unit_discount: Column) -> Column:
    """Money on one order line. The discount is an amount per unit, and a negative
    quantity gives a credit. Typed as the stored column; an overflow is an error, with
    ANSI mode on or off. A NULL part gives NULL."""
    exact = quantity * (unit_price - unit_discount)
    total = exact.try_cast("decimal(18,6)")
    too_large = total.isNull() & exact.isNotNull()
    return F.when(too_large, F.raise_error(F.lit("line total too large"))).otherwise(total)


def exact_average(total: Column, count: Column, digits: int = 2) -> Column:
    """Average of whole numbers from their sum and count, rounded half up without
    passing through floating point."""
    quotient = total.cast("decimal(20,0)") / count.cast("decimal(20,0)")
    return F.round(quotient, digits).cast(f"decimal(38,{digits})")
