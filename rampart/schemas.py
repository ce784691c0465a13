"""Table schemas of the lake."""

SILVER_CORE = {
    "event_uid": "string", "raw_hash": "string", "time": "bigint", "class_uid": "bigint", "category_uid": "bigint",
    "activity_id": "bigint", "type_uid": "bigint", "severity_id": "bigint", "source_type": "string", "src_ip": "string",
    "src_port": "bigint", "dst_ip": "string", "dst_port": "bigint", "protocol": "string", "action_id": "bigint",
    "bytes_in": "bigint", "bytes_out": "bigint",
}
SILVER = {**SILVER_CORE, "unmapped_json": "string", "enrichments_json": "string", "date": "string"}
RAW = (
    "event_uid string, raw binary, raw_hash string, raw_len int, ingest_time_ns bigint, source_id string, "
    "transport string, peer string"
)
DEAD_LETTER = "event_uid string, raw string, raw_hash string, reason string, stage string, detail string, ts_ns bigint"
RESOLUTION = "event_uid string, resolved_ts_ns bigint, detail string"
ANOMALY = (
    "event_uid string, src_ip string, event_time_ns bigint, source_type string, anomaly_score double, "
    "is_anomaly boolean, scored_at_ns bigint, model_trained_at string, explanation_json string"
)


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
