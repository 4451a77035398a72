"""All registered queries by name."""

from __future__ import annotations

from wardlight.plans import governance_plans, metric_plans, stream_plans, triage_plans

_GROUPS = (triage_plans, governance_plans, metric_plans, stream_plans)

PLANS = {plan.name: plan for group in _GROUPS for plan in group.PLANS}

if len(PLANS) != sum(len(group.PLANS) for group in _GROUPS):
    raise ValueError("two queries share a name")
