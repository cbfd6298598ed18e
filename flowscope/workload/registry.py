"""All registered queries."""

from flowscope.workload.flow_queries import FLOWS
from flowscope.workload.model_queries import MODELS
from flowscope.workload.table_queries import TABLES

QUERIES = {**FLOWS, **TABLES, **MODELS}
