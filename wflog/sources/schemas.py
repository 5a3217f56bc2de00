"""Declared schemas of the operational tables; nothing is inferred."""

from __future__ import annotations

#: DDL of each table, as ``spark.read.schema`` takes it.
SCHEMAS = {
    "events": "stream_id string, version bigint, event_id string, event_type string, occurred_at timestamp, payload string",
    "stream_heads": "instance_id string, stream_version bigint",
    "checkpoints": "instance_id string, stream_version bigint, content_type string, payload binary, definition_id string, definition_version int, status string, last_step_path string, error_summary string, outcome_name string, continue_as_new_generation int, runtime_state string, parent_instance_id string, root_instance_id string",
    "inbox": "event_id string, instance_id string, envelope_fingerprint string, state string, event_name string, event_contract_version int, correlation_id string, causation_event_id string, occurred_at timestamp, route_kind string, route_instance_id string, route_definition_id string, route_definition_version int, start_idempotency_key string, payload_content_type string, payload binary, route_key string, acceptance_sequence bigint, accepted_at timestamp, poison_code string, poison_detail string, handoff_failure_count int, handoff_retry_not_before timestamp",
    "fanout_targets": "event_id string, instance_id string, state string, route_key string, acceptance_sequence bigint, poison_code string, poison_detail string, handoff_failure_count int, handoff_retry_not_before timestamp",
    "start_idempotency": "idempotency_key string, instance_id string, definition_id string, definition_version int, definition_fingerprint string, input_fingerprint string",
    "pending_starts": "start_idempotency_key string, definition_id string, definition_version int, workflow_input_fingerprint string, state string, instance_id string, definition_fingerprint string, poison_code string, poison_detail string",
    "outbox": "outbox_record_id string, dag_run_owner string, recipient_host_id string, dag_run_subscription_id string, instance_id string, kind string, payload binary, state string, dispatch_attempt int, claimed_until timestamp, poison_code string, poison_detail string",
    "projections": "instance_id string, parent_instance_id string, root_instance_id string, definition_id string, definition_version int, status string, created_at timestamp, updated_at timestamp, error_summary string, outcome_name string, continue_as_new_generation int, archived_at timestamp, last_active_at timestamp, is_stuck boolean, stuck_detected_at timestamp, stream_version bigint",
    "active_waits": "wait_id string, instance_id string, event_name string, event_contract_version int, correlation_id string, registered_at timestamp, status string, mode string",
    "timers": "timer_id string, instance_id string, command_id string, fire_at timestamp, wakeup_name string, claimed boolean, claimed_until timestamp",
    "history": "history_id string, instance_id string, recorded_at timestamp, kind string, payload string",
    "pools": "partition_id string, name string, capacity int, lease_micros bigint",
    "tickets": "partition_id string, ticket_id string, pool_name string, units int, holder_instance_id string, holder_key string, acquired_at timestamp, expires_at timestamp, provider_generation bigint, review_deadline timestamp, review_marked boolean",
    "waiters": "partition_id string, waiter_id string, holder_instance_id string, holder_key string, requirements array<struct<pool_name: string, units: int>>, requested_at timestamp, expires_at timestamp",
    "dag_runs": "run_id string, creation_sequence bigint, version bigint, definition_id string, definition_version bigint, state string, is_stuck boolean, last_progress_at timestamp, created_at timestamp, completed_at timestamp",
    "dag_nodes": "run_id string, ordinal int, node_id string, state string, child_id string, output string, failure_code string, ready_at timestamp, started_at timestamp, completed_at timestamp",
    "dag_edges": "run_id string, ordinal int, dep_ordinal int",
    "governance_records": "partition_id string, version bigint, kind string, payload string, checksum string, recorded_at timestamp",
    "dag_operations": "run_id string, operation_id string, stream_version bigint, fingerprint string",
    "dag_subscriptions": "subscription_id string, run_id string, seen_version bigint, created_at timestamp, expires_at timestamp",
    "dag_leases": "run_id string, owner string, purpose string, fence bigint, acquired_at timestamp, expires_at timestamp, turn_expires_at timestamp",
    "lease_requests": "request_id string, partition_id string, holder_instance_id string, holder_key string, requirements array<struct<pool_name: string, units: int>>, requested_at timestamp, expires_at timestamp, state string",
    "dag_records": "run_id string, stream_version bigint, operation_id string, kind string, state string, changes array<struct<ordinal: int, state: string, failure_code: string>>, updated_at timestamp",
}

_AT_FIBER = ("fiber_id", "scope_id")
#: Kinds of events that change an instance, others are quarantined; with the payload fields that each must have and those that it may have: fixed values.
EVENT_FIELDS = {
    "Started": (("definition_id", "definition_version"), ("idempotency_key", "definition_fingerprint", "input_fingerprint", "input_content_type", "input_payload")),
    "ExecutionPositionChanged": ((), ()),
    "Parked": (("reason", "error", "failed_attempt_count"), ("position_stream_version",)),
    "Unparked": ((), ()),
    "ContinuationAttemptFailed": (("attempt_count", "next_eligible_at", "error"), ("position_stream_version",)),
    "ContinuationAttemptReset": ((), ()),
    "ContinuedAsNew": (("previous_stream_version", "generation"), ()),
    "StepCompleted": (("step_path",), ()),
    "StepFailed": (("step_path", "error"), ()),
    "Completed": ((), ("outcome",)),
    "CancellationRequested": ((), ()),
    "Terminal": (("status",), ("error",)),
    "WaitRegistered": (("wait_id", "event_name", "correlation_id"), (*_AT_FIBER, "wait_sequence", "event_contract_version", "mode", "branch_id", "timeout_timer_id")),
    "WaitMatched": (("wait_id", "matched_event_id"), (*_AT_FIBER, "wait_sequence", "event_name", "event_contract_version", "correlation_id", "branch_id", "payload_content_type", "event_payload")),
    "WaitCancelled": (("wait_id",), _AT_FIBER),
    "TimerScheduled": (("timer_id", "fire_at", "wakeup_name"), _AT_FIBER),
    "TimerFired": (("timer_id",), _AT_FIBER),
    "TimerCancelled": (("timer_id",), _AT_FIBER),
    "ResumeConsumed": (("wait_id",), _AT_FIBER),
    "ResourcePoolAcquired": (("holder_key", "tickets"), _AT_FIBER),
    "ResourcePoolQueued": (("wait_id", "holder_key", "requirements"), (*_AT_FIBER, "wait_sequence", "expires_at")),
    "ResourcePoolReleased": (("holder_key", "tickets"), _AT_FIBER),
}
EVENT_KINDS = tuple(EVENT_FIELDS)
#: Payload fields that every kind may have.
COMMON_FIELDS = ("command_id", "causation_id", "parent_instance_id", "root_instance_id")

_TICKET = "struct<ticket_id: string, pool_name: string, count: int, holder_instance_id: string, holder_key: string, acquired_at: timestamp, expires_at: timestamp, fiber_id: string, scope_id: string, provider_generation: bigint, review_deadline: timestamp, review_marked: boolean>"
_TYPES = {
    "definition_version": "int", "failed_attempt_count": "int", "position_stream_version": "bigint", "attempt_count": "int", "next_eligible_at": "timestamp", "previous_stream_version": "bigint", "generation": "int",
    "wait_sequence": "bigint", "event_contract_version": "int", "fire_at": "timestamp", "expires_at": "timestamp", "input_payload": "binary", "event_payload": "binary",
    "tickets": f"array<{_TICKET}>", "requirements": "array<struct<pool_name: string, count: int>>",
}
#: One wide payload for all kinds: field -> type; a kind leaves the others' fields null.
PAYLOAD = {f: _TYPES.get(f, "string") for f in dict.fromkeys([*COMMON_FIELDS, *[f for need, may in EVENT_FIELDS.values() for f in (*need, *may)]])}
