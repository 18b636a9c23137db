"""Database fleet health analytics as Spark DataFrame operators."""

KEYS = ["cluster_id", "snapshot_date", "node_ip"]
CLUSTER_KEYS = ["cluster_id", "snapshot_date"]
