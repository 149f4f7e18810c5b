"""Declared schemas of the tables the jobs read. Names and types of the contract."""

from __future__ import annotations

TELEMETRY = (
    "timestamp string, node_id string, pressure double, flow double, demand double, "
    "leak_label int, pressure_unit string, flow_unit string, demand_unit string"
)
LEAK_METADATA = (
    "incident_id string, node_id string, start_time string, end_time string, "
    "severity string, confidence double"
)
NETWORK_NODES = "node_id string, node_type string"
NETWORK_LINKS = "link_id string, from_node string, to_node string, link_type string"
KNOWLEDGE = "id string, title string, source string, content string"
PREDICTION_LOG = (
    "latency_ms double, confidence double, score double, predicted_label int, actual_label int, "
    "detection_delay_minutes double, estimated_business_impact_usd double, status_code int, "
    "cpu_percent double, memory_percent double"
)

AUXILIARY_FILES = ("leak_metadata.csv", "net3_nodes.csv", "net3_links.csv")
EXPECTED_FILES = ("leakg3pd_sample.csv", *AUXILIARY_FILES)
CORE_COLUMNS = ("timestamp", "node_id", "pressure", "flow", "demand", "leak_label")
UNIT_DEFAULTS = {"pressure_unit": "psi", "flow_unit": "gpm", "demand_unit": "gpm"}

MODEL_FEATURES = (
    "pressure",
    "flow",
    "demand",
    "pressure_lag_1",
    "flow_lag_1",
    "demand_lag_1",
    "pressure_delta",
    "flow_delta",
    "demand_delta",
    "pressure_roll_avg_6",
    "flow_roll_avg_6",
)


def columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]
