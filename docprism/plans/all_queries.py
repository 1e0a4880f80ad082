"""All registered queries of the library itself."""

from docprism.plans import contract_queries, detector_queries, evaluation_queries, prep_queries, study_queries, text_queries  # noqa: F401
from docprism.plans.registry import QUERIES, SQL  # noqa: F401
