"""Write planning: the CTAS statement and its distribution choice."""

from ferry.plans.write_plan import WritePlan, choose_distribution, explain

__all__ = ["WritePlan", "choose_distribution", "explain"]
