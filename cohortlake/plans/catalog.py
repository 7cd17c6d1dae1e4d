"""All registered queries."""

from cohortlake.plans import (  # noqa: F401
    acute_plans, boost_plans, claim_plans, evaluation_plans, feature_plans, gram_plans, ml_plans, panel_plans, profile_plans, source_plans,
)
from cohortlake.plans.registry import ORACLES, QUERIES  # noqa: F401
