"""Dialect B's records: which updates and events are known, unknown or invalid, and why.

The kinds and their fields are a table in text; a line is decoded once and its tag's rules
are looked up. Lines are (…, status, value) as sources.jsonl.lines or the stream give them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import shape
from threadloom.functions.text import bound
from threadloom.operators.updates import CHUNKS

# The events and their fields, besides ts, a string; ? may be absent.
EVENTS = """
turn_started: session_id string, turn_number unsigned, model_id string, yolo_mode boolean, conversation_message_count unsigned, session_relationship =primary|subagent, schema_version =1.0, redirect_kind =interjection|cancel_then_send|queued_after_cancel?
phase_changed: phase =waiting_for_model|streaming_text|streaming_reasoning|tool_execution|permission_prompt
first_token:
loop_started: loop_index unsigned
tool_started: tool_name string
tool_completed: tool_name string, duration_ms unsigned, outcome =success|error|permission_rejected|permission_cancelled|followup|hook_denied|invalid_tool|cancelled, tool_call_id string?, source =workspace?
permission_requested: tool_name string
permission_resolved: tool_name string, decision =allow|deny|cancelled|followup, wait_ms unsigned
turn_ended: outcome =completed|cancelled|error, cancellation_category =hook_denied|permission_rejected|permission_cancelled|mid_turn_abort?
interjected: source =direct|queue, image_count unsigned, redirect_kind =interjection
yolo_toggled: enabled boolean
goal_auto_paused: reason =user|back_off|no_progress|verification|infra
todo_gate_fired: fires unsigned, pending unsigned, in_progress unsigned, reason string
todo_gate_exhausted: pending unsigned
laziness_classifier_fired: model_id string, category string, confidence number
laziness_nudge_fired: model_id string, category string, nudges_remaining unsigned
laziness_classifier_aborted: reason string
goal_classifier_fired: attempt unsigned, max_runs unsigned, model_id string
goal_classifier_verdict: verdict =achieved|not_achieved, attempt unsigned, latency_ms unsigned
goal_classifier_fail_open: reason string, attempt unsigned, latency_ms unsigned
goal_classifier_fail_closed: reason string, attempt unsigned
goal_classifier_cap_reached: attempt unsigned
goal_classifier_mid_turn_deferred: pending_depth unsigned
goal_classifier_dropped_after_cap: attempts_seen unsigned
goal_classifier_pending_queue_cleared: dropped unsigned
goal_planner_fired: attempt unsigned, max_runs unsigned, model_id string
goal_planner_completed: attempt unsigned, latency_ms unsigned
goal_planner_fail_closed: reason string, attempt unsigned, latency_ms unsigned
goal_strategist_fired: attempt unsigned, consecutive_failures unsigned, every unsigned, model_id string
goal_strategist_completed: attempt unsigned, consecutive_failures unsigned, latency_ms unsigned
goal_strategist_failed: reason string, attempt unsigned, consecutive_failures unsigned, latency_ms unsigned
goal_strategist_contract_restore_failed: reason string, attempt unsigned
goal_summarizer_fired: attempt unsigned, model_id string
goal_summarizer_completed: attempt unsigned, latency_ms unsigned
goal_summarizer_fail_open: reason string, attempt unsigned, latency_ms unsigned
goal_role_model_resolved: role string, skeptic_idx unsigned?, model_id string, agent_type string, source string
goal_role_model_fail_open: role string, skeptic_idx unsigned?, reason string
goal_verifier_skeptic_verdict: attempt unsigned, skeptic_idx unsigned, refuted boolean, confidence string, latency_ms unsigned
goal_verifier_aggregate_verdict: attempt unsigned, refuted_count unsigned, total unsigned, achieved boolean
goal_premature_stop_detected: pattern string
mcp_config_resolved: servers array, disabled strings
mcp_managed_config_result: server_count unsigned, error string?
mcp_oauth_discovery_timeout: server_name string, url string
mcp_server_starting: server_name string, transport string, target string, timeout_sec unsigned
mcp_server_connected: server_name string, transport string, tool_count unsigned, duration_ms unsigned, tools strings
mcp_server_failed: server_name string, transport string?, target string?, error_type =spawn_failed|timeout|handshake_failed|auth_required|client_error, error_message string, duration_ms unsigned?, timeout_sec unsigned?
mcp_tool_registration_failed: server_name string, tool_name string, error string
mcp_init_completed: total_servers unsigned, succeeded unsigned, failed unsigned, auth_required unsigned, total_tools unsigned, duration_ms unsigned, is_reinit boolean, failed_servers strings?
mcp_init_cancelled: reason string
mcp_tool_call_started: server_name string, tool_name string, call_id string, timeout_sec unsigned
mcp_tool_call_completed: server_name string, tool_name string, call_id string, duration_ms unsigned, success boolean, is_timeout boolean, error string?, reconnect_attempted boolean, auth_retry_attempted boolean
mcp_transport_error: server_name string, tool_name string, error string
mcp_transport_decode_error: server_name string, error string, sample string
mcp_transport_reconnect: server_name string, success boolean, error string?
mcp_auth_retry: server_name string, trigger string, success boolean
mcp_health_check: server_name string, healthy boolean, client_state string?
mcp_server_toggled: server_name string, enabled boolean
"""

# The updates of the first method, with the fields of params.update.
SESSION_UPDATES = """
user_message_chunk: content object, messageId string~
agent_message_chunk: content object, messageId string~
agent_thought_chunk: content object, messageId string~
tool_call: toolCallId string, title string, kind =read|edit|delete|move|search|execute|think|fetch|switch_mode|other?, status =pending|in_progress|completed|failed?, content array?, locations array?
tool_call_update: toolCallId string, title string?, kind =read|edit|delete|move|search|execute|think|fetch|switch_mode|other?, status =pending|in_progress|completed|failed?, content array?, locations array?
plan: entries array
available_commands_update: availableCommands array
current_mode_update: currentModeId string
"""
# The updates of the second method.
OWN_UPDATES = """
diff_review:
retry_state:
auto_compact_started: tokens_used unsigned, context_window unsigned, percentage unsigned, reason string
auto_compact_completed: tokens_before unsigned~, tokens_after unsigned, elapsed_ms number~, summary_preview string~
auto_compact_failed: error string
memory_flush_started:
memory_flush_completed: result string, path string~
memory_dream_completed: result string, path string~
memory_session_saved: path string
auto_compact_cancelled:
auto_continue_completed: total_tokens unsigned
feedback_request:
relay_sync_status:
auto_recovery_started: attempt unsigned, max_retries unsigned, error string, delay_ms unsigned
auto_recovery_exhausted: attempts unsigned, error string
hook_annotation: message string
hook_execution: event_name string, tool_name string~, prompt_id string~, runs array
hooks_changed: hooks array, project_trusted boolean, load_errors strings?
plugins_changed: plugins array
plugin_updates_installed: updates array
session_summary_generated: session_summary string
session_recap: summary string, auto boolean?
session_recap_unavailable:
last_turn_summary: summary string, prompt_id string~
compaction_checkpoint:
rewind_marker: target_prompt_index unsigned, created_at string
task_completed:
subagent_spawned: subagent_id string, parent_session_id string, parent_prompt_id string~, child_session_id string, subagent_type string, description string, effective_context_source string~, context_normalized boolean?, capability_mode string~, persona string~, role string~, model string~, resumed_from string~, workflow_run_id string~
subagent_progress: subagent_id string, parent_session_id string, child_session_id string, duration_ms unsigned, turn_count unsigned, tool_call_count unsigned, tokens_used unsigned, context_window_tokens unsigned, context_usage_pct unsigned, tools_used strings, error_count unsigned
subagent_finished: subagent_id string, child_session_id string, status string, error string~, tool_calls unsigned, turns unsigned, duration_ms unsigned, tokens_used unsigned?, output string~, will_wake boolean?
task_backgrounded: tool_call_id string, task_id string, command string, cwd string, output_file string, monitor_description string~, description string~
scheduled_task_created: task_id string, prompt string, human_schedule string, next_fire_at string~
scheduled_task_fired: task_id string, prompt string, human_schedule string, next_fire_at string~, subagent_id string~
scheduled_task_deleted: task_id string
monitor_event: task_id string, description string, event_text string
model_auto_switched: previous_model_id string, new_model_id string, reason string
model_changed: model_id string, reasoning_effort string~
tool_call_delta_chunk: tool_call_id string~, tool_index unsigned, name string~, arguments_delta string~
image_compressed:
image_dropped: notes strings
memory_files:
workflow_updated:
goal_updated:
pending_interaction: tool_call_id string
interaction_resolved: tool_call_id string
turn_completed: prompt_id string, stop_reason string, agent_result string~
response_started: message_id string~, model string~, input_tokens unsigned?, cache_read_input_tokens unsigned?, cache_creation_input_tokens unsigned?
reasoning_completed: signature string~
response_completed: message_id string~, stop_reason string~, signature string~, stop_sequence string~
"""
# Blocks of content, what a tool call holds, and the items of other lists.
CONTENT = {"text": {"text": "string"}, "image": {"data": "string", "mimeType": "string"}, "audio": {"data": "string", "mimeType": "string"}, "resource_link": {"name": "string", "uri": "string"}, "resource": {"resource": "object"}}
TOOL_CONTENT = {"content": {"content": "object"}, "diff": {"path": "string", "newText": "string"}, "terminal": {"terminalId": "string"}}
LISTED = {
    "locations": shape.rules({"": {"path": "string"}}, {"": {"line": "unsigned|null"}}),
    "entries": shape.rules({"": {"content": "string", "priority": "=high|medium|low", "status": "=pending|in_progress|completed"}}),
    "availableCommands": shape.rules({"": {"name": "string", "description": "string"}}),
}
METHODS = ("session/update", "_x.ai/session/update")
OBJECTS, UPDATE = ("",), "params.update"


def _string(v: Column, path: str) -> Column:
    return bound(F.try_variant_get(v, path, "variant"), lambda x: F.when(shape.kind_of(x) == "string", F.try_variant_get(x, "$", "string")))


def envelopes(lines: DataFrame) -> DataFrame:
    """lines with record_kind, tag, issues and a diagnostic, as ``events``, of updates in their envelopes.

    A tag that isn't one of its method's is unknown; an envelope without a time, a method or a
    session is invalid. Contents are checked for their type and its fields, lists for their
    items; a resource's own fields, annotations and numbers' upper bounds aren't.
    """
    head = shape.rules({"": {"timestamp": "number", "method": f"={'|'.join(METHODS)}", "params": "object"}, "params": {"sessionId": "string", "update": "object"}, UPDATE: {"sessionUpdate": "string"}})
    below = lambda table: {tag: head + [(UPDATE, key, kind, maybe) for _, key, kind, maybe in own] for tag, own in shape.rules_of_text(table).items()}
    tables = below(SESSION_UPDATES), below(OWN_UPDATES)

    def record(v: Column) -> Column:
        def told(named: Column) -> Column:
            tag = named["tag"]
            own = F.when(named["method"] == METHODS[0], shape.lookup(tables[0], tag)).when(named["method"] == METHODS[1], shape.lookup(tables[1], tag))
            at = lambda name, kind: F.try_variant_get(v, f"$.{UPDATE}.{name}", kind)
            acp = named["method"] == METHODS[0]
            chunk = F.when(acp & tag.isin(*CHUNKS), F.array(at("content", "variant")))
            call = F.when(acp & tag.isin("tool_call", "tool_call_update"), at("content", "array<variant>"))
            inner = F.coalesce(shape.items_fit(chunk, CONTENT), F.lit(True)) & F.coalesce(shape.items_fit(call, TOOL_CONTENT, {"diff": {"oldText": "string|null"}}), F.lit(True))
            for name, rules in LISTED.items():
                inner = inner & F.coalesce(shape.all_fit(F.when(own.isNotNull() & acp, at(name, "array<variant>")), rules), F.lit(True))
            kind = lambda issues: F.when((F.size(issues) > 0) | ~inner, "invalid").when(own.isNull(), "unknown").otherwise("known")
            issues = shape.issues(shape.kinds(v, ("", "params", UPDATE)), F.coalesce(own, shape.lookup({"": head}, F.lit(""))))
            return bound(issues, lambda issues: F.struct(tag.alias("tag"), issues.alias("issues"), kind(issues).alias("record_kind")))

        # a value that is no object has no fields of which an issue could tell
        whole = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
        nothing = F.struct(F.lit(None).cast("string").alias("tag"), F.expr("cast(array() as array<struct<code: string, path: string>>)").alias("issues"), F.lit("invalid").alias("record_kind"))
        return F.when(v.isNotNull(), F.when(whole, bound(F.struct(_string(v, f"$.{UPDATE}.sessionUpdate").alias("tag"), _string(v, "$.method").alias("method")), told)).otherwise(nothing))

    return with_diagnostic(lines.withColumn("_r", bound(F.when(F.col("status") == "ok", F.try_parse_json("value")), record)), lines.columns)


def events(lines: DataFrame) -> DataFrame:
    """lines with record_kind (known, unknown, invalid; null if not JSON), tag, issues and a diagnostic.

    An event of a tag that isn't known is kept; one whose fields don't fit is invalid. Blank
    lines have neither. A JSON object with a key twice is not JSON here.
    """
    table = {tag: [("", "ts", "string", False), *own] for tag, own in shape.rules_of_text(EVENTS).items()}
    server = shape.rules({"": {"name": "string", "transport": "string", "source": "string"}})

    def record(v: Column) -> Column:
        def told(tag: Column) -> Column:
            own = shape.lookup(table, tag)
            servers = F.when(tag == "mcp_config_resolved", F.try_variant_get(v, "$.servers", "array<variant>"))
            inner = F.coalesce(shape.all_fit(servers, server), F.lit(True))
            kind = lambda issues: F.when(tag.isNull() | (F.size(issues) > 0) | ~inner, "invalid").when(issues.isNull(), "unknown").otherwise("known")
            return bound(shape.issues(shape.kinds(v, OBJECTS), own), lambda issues: F.struct(tag.alias("tag"), issues.alias("issues"), kind(issues).alias("record_kind")))

        return F.when(v.isNotNull(), bound(_string(v, "$.type"), told))

    return with_diagnostic(lines.withColumn("_r", bound(F.when(F.col("status") == "ok", F.try_parse_json("value")), record)), lines.columns)


def normalised(records: DataFrame) -> DataFrame:
    """The records of ``envelopes`` or ``events`` that are known or unknown, each with its origin as an id: path, start and end."""
    return records.filter(F.col("record_kind").isin("known", "unknown")).withColumn("origin", F.concat_ws(":", "path", F.col("byte_start").cast("string"), F.col("byte_end").cast("string")))


def with_diagnostic(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with the struct _r as columns, and a diagnostic: oversized_line, invalid_json or invalid_record, null if nothing is wrong."""
    wrong = F.when(F.col("status") == "oversized", "oversized_line").when((F.col("status") == "ok") & F.col("_r").isNull(), "invalid_json").when(F.col("_r.record_kind") == "invalid", "invalid_record")
    return rows.select(*columns, "_r.*", wrong.alias("diagnostic"))


def diagnostics(records: DataFrame) -> DataFrame:
    """A row for each line that gave no record: (path, byte_start, byte_end, code, tag, detail), detail being its issues as text."""
    detail = F.array_join(F.transform("issues", lambda x: F.concat_ws(" ", x["code"], x["path"])), "; ")
    return records.filter("diagnostic is not null").select("path", "byte_start", "byte_end", F.col("diagnostic").alias("code"), "tag", F.nullif(detail, F.lit("")).alias("detail"))
