"""Registered queries over the driver's tables, each with SQL for an independent engine where SQL can say it."""

from lacuna.plans import figures, modelling, panel, pit, quality
from lacuna.plans.base import Plan


def all_plans() -> dict[str, Plan]:
    """Every query of the library by name, with its SQL."""
    return panel.PLANS | pit.PLANS | figures.PLANS | modelling.PLANS | quality.PLANS
